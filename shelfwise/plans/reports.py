"""The registered queries: every operator over whole tables of the supplied star schema.

Each takes (spark, folder) and gives a frame of plain columns: whole numbers as BIGINT,
dates as text, fractions rounded, so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.columns import array_mean, settled
from shelfwise.operators import drift, evaluate, features, forecast, health, models, prep
from shelfwise.operators import profile as profiling
from shelfwise.operators import roles as role_ops
from shelfwise.operators import boosting, sketches, tails, windows
from shelfwise.operators.ordering import PANEL, with_positions
from shelfwise.operators.roles import Roles
from shelfwise.plans.train import TrainConfig, compare
from shelfwise.sources.readers import read_parquet
from shelfwise.sources.state import reference_sample

Report = Callable[[SparkSession, str], DataFrame]
REPORTS: dict[str, Report] = {}

SPLIT_DAY = "1998-01-01"
PRICE_RISE = 1.4
FALLEN_NATIONS = 8
EVENT_SPLIT = "2024-01-24 00:00:00"
SALES_RISE = 3
CHAMPION_LOOKBACK = 7
PAIR_PENALTY = 100_000.0
STUMP_FEATURES = ("l_quantity", "l_linenumber", "l_discount", "l_tax")
BOOTSTRAP_SEED = 7
PAST_MEAN = "array(aggregate(past, 0D, (total, x) -> total + x) / greatest(size(past), 1))"
DRIFT_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")

DAILY = Roles("sale_date", "sales", "store_id", numeric=("customers",), categorical=("promo",))
NATION = Roles("sale_date", "sales", "store_id")
INTRADAY = Roles("ts", "value", "event_type", tiebreak=("event_id",))


def report(build: Report) -> Report:
    REPORTS[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{folder}/{name}.parquet")


def plain(df: DataFrame, digits: int = 4) -> DataFrame:
    """Comparable column types."""

    def convert(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, T.IntegralType):
            return c.cast("bigint")
        if isinstance(f.dataType, T.FractionalType):
            return F.round(c.cast("double"), digits)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd")
        return c

    return df.select(*[convert(f).alias(f.name) for f in df.schema.fields])


# ---- panels ---------------------------------------------------------------------------


def daily_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Sales per order priority ("store") and day. Decimal sums do not depend on order."""
    orders = table(spark, folder, "orders")
    slim = orders.select(
        F.col("o_orderpriority").alias("store_id"),
        F.col("o_orderdate").cast("date").alias("sale_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        "o_custkey",
        (F.col("o_orderstatus") == "F").cast("int").alias("done"),
    )
    return prep.to_panel(slim, "store_id", "sale_date", {
        "sales": F.sum("price").cast("double"),
        "customers": F.count_distinct("o_custkey"),
        "promo": F.max("done"),
    })


def nation_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Sales per customer nation and day: more and shorter series."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("store_id"),
        F.col("o_orderdate").cast("date").alias("sale_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
    )
    return prep.to_panel(joined, "store_id", "sale_date", {"sales": F.sum("price").cast("double")})


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as sub-daily series: five types, each a large share of all rows."""
    return table(spark, folder, "events").select("event_type", "ts", "event_id", "value")


def daily_features(spark: SparkSession, folder: str) -> DataFrame:
    return features.feature_frame(daily_sales(spark, folder), DAILY, layout=PANEL)


def daily_windows(spark: SparkSession, folder: str, sequence: bool = False) -> DataFrame:
    frame = daily_features(spark, folder)
    return windows.sliding_windows(frame, DAILY, sequence=sequence, layout=PANEL)


def orders_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Orders where every tenth price and every seventh priority is missing."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.when(key % 10 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(key % 7 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )


def drift_pair(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Line items before a day, and those from it on with prices raised (to whole cents)."""
    lines = table(spark, folder, "lineitem").select("l_shipdate", *DRIFT_COLUMNS)
    early = F.col("l_shipdate") < F.lit(SPLIT_DAY).cast("timestamp_ntz")
    raised = F.round(F.col("l_extendedprice") * PRICE_RISE, 2)
    return (
        lines.where(early).drop("l_shipdate"),
        lines.where(~early).withColumn("l_extendedprice", raised).drop("l_shipdate"),
    )


def baseline_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Test windows scored by the two baselines, as long rows."""
    test = windows.split_windows(daily_windows(spark, folder)).where(~F.col("is_train"))
    return evaluate.scored_long(test, {
        "moving_average": models.moving_average(windows.HORIZON),
        "weekday": models.weekday_baseline("sale_date", windows.HORIZON),
    })


def weekday_rows(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.weekday_forecast(daily_sales(spark, folder), DAILY)


# ---- rows and columns -----------------------------------------------------------------


@report
def row_cap(spark: SparkSession, folder: str) -> DataFrame:
    return plain(prep.row_cap(daily_sales(spark, folder), DAILY, 1000))


@report
def filter_series(spark: SparkSession, folder: str) -> DataFrame:
    return plain(prep.filter_series(daily_sales(spark, folder), "store_id", "1-URGENT"))


@report
def parse_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Dates as text in two patterns, some unreadable."""
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    text = (
        F.when(key % 10 == 0, F.lit("not a date"))
        .when(key % 10 == 1, F.date_format(day, "dd/MM/yyyy"))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    raw = table(spark, folder, "orders").select("o_orderkey", text.alias("order_day"))
    return plain(prep.parse_dates(raw, "order_day", ["dd/MM/yyyy"], as_date=True))


@report
def drop_incomplete(spark: SparkSession, folder: str) -> DataFrame:
    return plain(prep.drop_incomplete(orders_with_gaps(spark, folder)))


@report
def impute_median(spark: SparkSession, folder: str) -> DataFrame:
    gaps = orders_with_gaps(spark, folder).select("o_orderkey", "o_totalprice")
    return plain(prep.impute_median(gaps, ["o_totalprice"]))


@report
def eligible_series(spark: SparkSession, folder: str) -> DataFrame:
    frame = features.feature_frame(nation_sales(spark, folder), NATION, layout=PANEL)
    return plain(windows.eligible_series(frame, NATION))


@report
def sort_panel(spark: SparkSession, folder: str) -> DataFrame:
    placed = with_positions(daily_sales(spark, folder), DAILY, PANEL)
    ordered = prep.sort_panel(placed, DAILY)
    return plain(ordered.select("store_id", "sale_date", "sales", F.col("_pos").alias("position")))


# ---- profile and roles ----------------------------------------------------------------


def profiled(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("l_orderkey")
    return table(spark, folder, "lineitem").select(
        "*",
        F.when(key % 2 == 0, F.col("l_tax")).alias("half_missing"),
        F.lit("x").alias("constant"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("part_label"),
    )


@report
def profile_columns(spark: SparkSession, folder: str) -> DataFrame:
    return plain(profiling.profile_columns(profiled(spark, folder)).drop("dtype"))


@report
def profile_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The same profile over whole texts."""
    return plain(profiling.profile_columns(table(spark, folder, "documents")).drop("dtype"))


@report
def profile_table(spark: SparkSession, folder: str) -> DataFrame:
    summary = profiling.profile_table(profiled(spark, folder))
    lists = ("constant_columns", "high_cardinality", "heavy_missing", "warnings")
    return plain(summary.withColumns({c: F.array_join(c, "; ") for c in lists}))


@report
def profile_merged(spark: SparkSession, folder: str) -> DataFrame:
    """The profile merged from the states of two halves: exact counts, and whether the distinct
    counts are within four standard errors of the exact ones."""
    lines = profiled(spark, folder)
    half = F.col("l_linenumber") % 2 == 0
    merged = sketches.merge_states(*[sketches.profile_state(lines.where(h)) for h in (half, ~half)])
    exact = profiling.profile_columns(lines).select("column", F.col("nunique").alias("_exact"))
    off = F.abs(F.col("nunique") - F.col("_exact")) <= F.ceil(4 * sketches.DISTINCT_ERROR * F.col("_exact"))
    found = sketches.profile_of(merged).drop("dtype").join(exact, "column").withColumn("nunique_near", off)
    return plain(found.drop("nunique", "_exact"))


@report
def bootstrap_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A resample of line items: exactly as many rows, all of them known, and moments that fit."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    taken = drift.bootstrap(lines, BOOTSTRAP_SEED)
    whole = lines.agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s"))
    drawn = taken.groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("k"), F.sum("l_quantity").alias("q"))
    own = lines.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("have"))
    known = drawn.join(own, ["l_orderkey", "l_linenumber"]).agg(
        F.sum("k").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.sum("q").alias("total"))
    expected = own.agg(F.sum(1 - F.exp(-F.col("have"))).alias("keys"))  # a key of k rows is missed by e^-k
    error = F.abs(F.col("total") / F.col("n_rows") - F.col("m")) / (F.col("s") / F.sqrt("n"))
    return plain(known.crossJoin(whole).crossJoin(expected).select(  # one row each
        "n_rows", (error < 5).alias("mean_fits"),
        (F.abs(F.col("n_keys") / F.col("keys") - 1) < 0.03).alias("share_fits")))


@report
def duplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Over all columns; and over all but the key of documents, which hold exact copies."""
    lines, texts = table(spark, folder, "lineitem"), table(spark, folder, "documents").drop("doc_id")
    counts = [profiling.duplicate_rows(df).withColumn("table_name", F.lit(t))
              for t, df in (("lineitem", lines), ("documents", texts))]
    return plain(counts[0].unionByName(counts[1]))


@report
def detect_date(spark: SparkSession, folder: str) -> DataFrame:
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    raw = table(spark, folder, "orders").select(
        "o_orderkey",
        "o_orderpriority",
        F.when(key % 4 != 0, F.date_format(day, "yyyy-MM-dd")).otherwise("?").alias("order_day"),
        F.when(key % 3 != 0, F.date_format(day, "yyyy-MM-dd")).otherwise("?").alias("ship_text"),
    )
    return plain(role_ops.date_candidates(raw))


@report
def detect_roles(spark: SparkSession, folder: str) -> DataFrame:
    found = role_ops.detect_roles(daily_sales(spark, folder)).to_frame(spark)
    return plain(found.select(
        "date_column", "target_column", "group_column", "frequency",
        F.array_join("numerical_features", ",").alias("numerical"),
        F.array_join("categorical_features", ",").alias("categorical"),
        F.col("confidence")["date"].alias("date_confidence"),
        F.col("confidence")["target"].alias("target_confidence"),
    ))


@report
def detect_target_variance(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    found = role_ops.target_by_variance(lines, ["l_shipdate"])
    return plain(found.withColumn("variance", F.col("variance") / F.lit(1e6)), 2)


@report
def classify_features(spark: SparkSession, folder: str) -> DataFrame:
    return plain(role_ops.classify_features(table(spark, folder, "lineitem"), ["l_shipdate"]))


@report
def detect_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return plain(role_ops.frequency(daily_sales(spark, folder), "sale_date"))


# ---- preprocessing --------------------------------------------------------------------


@report
def fit_scaler(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("l_orderkey")
    lines = table(spark, folder, "lineitem").select(
        F.when(key % 10 != 0, F.col("l_extendedprice")).alias("l_extendedprice"),
        F.when(key % 3 != 0, F.col("l_quantity")).alias("l_quantity"),
        "l_discount",
    )
    return plain(prep.scales_frame(spark, prep.fit_scales(lines, lines.columns)))


@report
def scale_numeric(spark: SparkSession, folder: str) -> DataFrame:
    gaps = orders_with_gaps(spark, folder).select("o_orderkey", "o_totalprice")
    scales = prep.fit_scales(gaps, ["o_totalprice"])
    filled = prep.impute(gaps, {c: s.median for c, s in scales.items()})
    return plain(prep.scale(filled, scales))


@report
def fit_encoder(spark: SparkSession, folder: str) -> DataFrame:
    gaps = orders_with_gaps(spark, folder)
    codes, _ = prep.fit_codes(gaps, ["o_orderstatus", "o_orderpriority"])
    return plain(codes)


@report
def encode_categorical(spark: SparkSession, folder: str) -> DataFrame:
    """Codes fitted without one priority, so that it is unknown later."""
    columns = ["o_orderstatus", "o_orderpriority"]
    gaps = orders_with_gaps(spark, folder).drop("o_totalprice")
    known = gaps.where(~F.col("o_orderpriority").eqNullSafe("3-MEDIUM"))
    codes, n_codes = prep.fit_codes(known, columns)
    return plain(prep.encode(gaps, columns, codes, n_codes))


@report
def posted_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Lags and means of events that come in two batches; the second starts from the tails
    (the newest rows of every type) of the first."""
    whole = events(spark, folder)
    first_batch = whole.where(F.col("ts") < F.lit(EVENT_SPLIT).cast("timestamp_ntz"))
    second = whole.where(F.col("ts") >= F.lit(EVENT_SPLIT).cast("timestamp_ntz"))
    tail = tails.next_tail(None, first_batch, INTRADAY, tails.reach())
    parts = [tails.posted_features(t, b, INTRADAY) for t, b in ((None, first_batch), (tail, second))]
    found = parts[0].unionByName(parts[1])
    names = ["value", *[f"value_lag{n}" for n in features.LAGS], *[f"value_roll{r}" for r in features.ROLLS]]
    return plain(found.select("event_type", "event_id", *names))


# ---- features and windows -------------------------------------------------------------


@report
def calendar_features(spark: SparkSession, folder: str) -> DataFrame:
    days = daily_sales(spark, folder).select("store_id", "sale_date")
    return plain(features.calendar_features(days, "sale_date"))


@report
def lag_features(spark: SparkSession, folder: str) -> DataFrame:
    return plain(features.lag_features(daily_sales(spark, folder), DAILY, layout=PANEL))


@report
def rolling_features(spark: SparkSession, folder: str) -> DataFrame:
    return plain(features.rolling_features(daily_sales(spark, folder), DAILY, layout=PANEL))


@report
def feature_frame(spark: SparkSession, folder: str) -> DataFrame:
    return plain(daily_features(spark, folder))


@report
def lag_features_intraday(spark: SparkSession, folder: str) -> DataFrame:
    return plain(features.lag_features(events(spark, folder), INTRADAY).drop("ts"))


@report
def rolling_features_intraday(spark: SparkSession, folder: str) -> DataFrame:
    return plain(features.rolling_features(events(spark, folder), INTRADAY).drop("ts"))


@report
def window_lookback_intraday(spark: SparkSession, folder: str) -> DataFrame:
    found = windows.sliding_windows(events(spark, folder), INTRADAY, features=[])
    return plain(found.select(
        "event_type", "event_id", "window_index", "n_windows",
        array_mean(F.col("past")).alias("past_mean"),
        array_mean(F.col("future")).alias("future_mean"),
    ))


@report
def window_lookback(spark: SparkSession, folder: str) -> DataFrame:
    return plain(daily_windows(spark, folder).select(
        "store_id", "sale_date", F.posexplode("past").alias("place", "value")
    ))


@report
def window_horizon(spark: SparkSession, folder: str) -> DataFrame:
    return plain(daily_windows(spark, folder).select(
        "store_id", "sale_date", F.posexplode("future").alias("place", "value")
    ))


def weighted_sum(numbers: str) -> Column:
    """1 x first + 2 x second + ...: changes with every value and every place.

    The irrational divisor keeps results away from rounding boundaries.
    """
    pairs = F.transform(numbers, lambda x, i: x * (i + 1))
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x) / F.sqrt(F.lit(2.0))


@report
def window_tabular(spark: SparkSession, folder: str) -> DataFrame:
    return plain(daily_windows(spark, folder).select(
        "store_id", "sale_date", F.posexplode("tabular").alias("place", "value")
    ))


@report
def window_sequence(spark: SparkSession, folder: str) -> DataFrame:
    found = daily_windows(spark, folder, sequence=True).withColumn("flat", F.flatten("steps"))
    return plain(found.select(
        "store_id", "sale_date", F.size("steps").alias("steps"),
        F.size("flat").alias("width"), weighted_sum("flat").alias("weighted"),
    ), 0)


@report
def window_count(spark: SparkSession, folder: str) -> DataFrame:
    return plain(windows.window_count(daily_features(spark, folder), DAILY))


@report
def train_test_split(spark: SparkSession, folder: str) -> DataFrame:
    split = windows.split_windows(daily_windows(spark, folder))
    return plain(split.select("store_id", "sale_date", "window_index", "is_train"))


@report
def latest_window(spark: SparkSession, folder: str) -> DataFrame:
    last = windows.latest_window(daily_windows(spark, folder))
    rows = F.posexplode(F.concat("past", "future")).alias("place", "value")
    return plain(last.select("store_id", "sale_date", "end_date", rows))


@report
def horizon_long(spark: SparkSession, folder: str) -> DataFrame:
    return plain(windows.horizon_long(daily_windows(spark, folder), ["store_id", "sale_date"]))


# ---- models ---------------------------------------------------------------------------


def _served(
    spark: SparkSession, folder: str, candidate: models.AnyForecaster, digits: int = 4
) -> DataFrame:
    panel = daily_sales(spark, folder)
    frame = features.feature_frame(panel, DAILY, layout=PANEL)
    names = features.feature_columns(frame, DAILY)
    sequence = candidate.needs_sequence
    chunks = windows.series_chunks(frame, DAILY, features=names, layout=PANEL).persist()
    model = candidate.fit(windows.chunk_windows(chunks, DAILY, sequence=sequence), windows.HORIZON)
    chunks.unpersist()
    inputs = forecast.forecast_inputs(panel, DAILY, names, sequence=sequence, layout=PANEL)
    return plain(forecast.forecast_rows(model.predict(inputs), DAILY), digits)


@report
def gbt_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """Boosted trees per step, forecasts of all series."""
    return _served(spark, folder, models.gbt_candidate())


def past_mean_line() -> models.DirectForecaster:
    return models.DirectForecaster(
        "ols", lambda: models.ridge(regParam=0.0, solver="normal"), PAST_MEAN)


@report
def ols_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """Least squares on the mean of the lookback, fitted and served like any candidate."""
    return _served(spark, folder, past_mean_line(), 1)


@report
def linear_forecast(spark: SparkSession, folder: str) -> DataFrame:
    return _served(spark, folder, models.ridge_candidate())


@report
def linear_pair_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """Ridge regression from one Gram matrix on two numbers: the mean of the lookback and its last."""
    pair = models.LinearForecaster("pair", PAIR_PENALTY, f"concat({PAST_MEAN}, slice(past, -1, 1))", False)
    return _served(spark, folder, pair, 1)


@report
def boosted_stump(spark: SparkSession, folder: str) -> DataFrame:
    """The first split of boosted trees for two targets of line items, out of every possible one."""
    lines = table(spark, folder, "lineitem")
    price = F.col("l_extendedprice")
    data = lines.select(
        F.array(*[F.col(c).cast("double") for c in STUMP_FEATURES]).alias("features"),
        F.array(price, F.col("l_quantity") * (1 - F.col("l_discount"))).alias("future"))
    size = boosting.TreeSize(trees=1, depth=1, rate=1.0, rows=1.0, columns=1.0, bins=64)
    nodes = boosting.fit_trees(data, size=size).to_frame(spark).where("tree = 0")
    names = F.array(*[F.lit(c) for c in STUMP_FEATURES])
    value = lambda node: F.max(F.when(F.col("node") == node, F.col("value")))
    return plain(nodes.groupBy("step").agg(
        F.max(F.when(F.col("node") == 0, F.get(names, F.col("feature")))).alias("feature"),
        F.max(F.when(F.col("node") == 0, F.col("threshold"))).alias("threshold"),
        value(1).alias("left_value"), value(2).alias("right_value")), 2)


@report
def model_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Fitted models (trees in a small size) against the moving average: checks that have to hold."""
    config = TrainConfig(
        candidates=[models.gbt_candidate(trees=40, depth=4, rate=0.1), models.ridge_candidate()],
        baselines={"moving_average": models.moving_average(windows.HORIZON)},
    )
    metrics = compared(spark, folder, config)
    numbers = [F.col(c) for c in evaluate.METRICS]
    finite = ~F.isnan(sum(numbers[1:], numbers[0])) & (F.greatest(*numbers) < float("inf"))
    yardstick = metrics.where("model_name = 'moving_average'").select("rmse").scalar()
    best = metrics.where("model_name <> 'moving_average'").select(F.min("rmse")).scalar()
    return plain(metrics.select(
        "model_name", finite.alias("is_finite"), (F.col("rmse") >= F.col("mae")).alias("rmse_above_mae"),
        (best < yardstick).alias("best_beats_average")))


@report
def train_and_compare(spark: SparkSession, folder: str) -> DataFrame:
    config = TrainConfig(
        baselines={"moving_average": models.moving_average(windows.HORIZON)},
    )
    return plain(compared(spark, folder, config))


def compared(spark: SparkSession, folder: str, config: TrainConfig) -> DataFrame:
    """Metrics of all candidates and baselines, from windows cut out of kept chunks."""
    chunks = windows.series_chunks(daily_features(spark, folder), DAILY, layout=PANEL).persist()
    split = windows.split_windows(windows.chunk_windows(chunks, DAILY, sequence=True))
    metrics = settled(compare(split, config)[1])  # one row per candidate
    chunks.unpersist()
    return metrics


@report
def dow_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return plain(weekday_rows(spark, folder).select("store_id", "step", "date", "forecast"))


# ---- evaluation -----------------------------------------------------------------------


@report
def forecast_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return plain(evaluate.forecast_metrics(baseline_scores(spark, folder)))


@report
def select_best(spark: SparkSession, folder: str) -> DataFrame:
    metrics = evaluate.forecast_metrics(baseline_scores(spark, folder))
    return plain(evaluate.select_best(metrics, "rmspe"))


@report
def promote_champion(spark: SparkSession, folder: str) -> DataFrame:
    """The approved moving average against a newer run of the weekday baseline."""
    metrics = evaluate.forecast_metrics(baseline_scores(spark, folder))
    approved = F.col("model_name") == "moving_average"
    runs = metrics.withColumns({
        "approved": approved,
        "run_time": F.when(approved, F.lit("2024-01-01")).otherwise("2024-01-08").cast("timestamp"),
    })
    return plain(evaluate.promote_champion(runs, "rmse"))


@report
def champion_rescored(spark: SparkSession, folder: str) -> DataFrame:
    """A line fitted on early sales against one fitted after they tripled, on the same windows.

    The champion looks back 7 rows and the challenger 14; both are scored on the test windows
    of the later sales.
    """
    panel = daily_sales(spark, folder)
    early = F.col("sale_date") < F.lit(SPLIT_DAY).cast("date")
    late = panel.where(~early).withColumn("sales", F.col("sales") * SALES_RISE)
    before, now = (features.feature_frame(p, DAILY, layout=PANEL) for p in (panel.where(early), late))
    champion = past_mean_line().fit(
        windows.sliding_windows(before, DAILY, CHAMPION_LOOKBACK, features=[], layout=PANEL), windows.HORIZON)
    split = windows.split_windows(windows.sliding_windows(now, DAILY, features=[], layout=PANEL))
    challenger = past_mean_line().fit(split.where("is_train"), windows.HORIZON)
    rival = champion.predict(
        windows.sliding_windows(now, DAILY, CHAMPION_LOOKBACK, features=[], layout=PANEL))
    test = challenger.predict(split.where("not is_train"), "_challenger")
    metrics = evaluate.rescored(test, rival, DAILY.keys)
    return plain(metrics.withColumns({c: F.col(c) / 1000 for c in ("mae", "rmse")}))


# ---- serving --------------------------------------------------------------------------


@report
def future_dates(spark: SparkSession, folder: str) -> DataFrame:
    last = forecast.recent_average(daily_sales(spark, folder), DAILY)
    return plain(forecast.future_steps(last, ["store_id"]))


@report
def recent_average(spark: SparkSession, folder: str) -> DataFrame:
    return plain(forecast.recent_average(daily_sales(spark, folder), DAILY))


@report
def forecast_summary(spark: SparkSession, folder: str) -> DataFrame:
    return plain(forecast.forecast_summary(weekday_rows(spark, folder), DAILY))


@report
def inventory_recommendations(spark: SparkSession, folder: str) -> DataFrame:
    summary = forecast.forecast_summary(weekday_rows(spark, folder), DAILY)
    return plain(forecast.inventory_recommendations(summary, DAILY))


@report
def forecast_band(spark: SparkSession, folder: str) -> DataFrame:
    return plain(forecast.forecast_band(weekday_rows(spark, folder)))


@report
def chart_series(spark: SparkSession, folder: str) -> DataFrame:
    panel = daily_sales(spark, folder)
    rows = forecast.weekday_forecast(panel, DAILY)
    return plain(forecast.chart_series(panel, rows, DAILY))


# ---- drift and health -----------------------------------------------------------------


@report
def psi_edges(spark: SparkSession, folder: str) -> DataFrame:
    reference, _ = drift_pair(spark, folder)
    return plain(drift.edges_frame(spark, drift.psi_edges(reference, DRIFT_COLUMNS)), 6)


@report
def psi_histogram(spark: SparkSession, folder: str) -> DataFrame:
    reference, current = drift_pair(spark, folder)
    edges = drift.psi_edges(reference, DRIFT_COLUMNS)
    sides = [("reference", reference), ("current", current)]
    parts = [drift.histogram(df, edges).withColumn("side", F.lit(s)) for s, df in sides]
    return plain(parts[0].unionByName(parts[1]))


@report
def psi_score(spark: SparkSession, folder: str) -> DataFrame:
    reference, current = drift_pair(spark, folder)
    fitted = drift.fit_reference(reference, DRIFT_COLUMNS)
    return plain(drift.column_psi(fitted, current))


@report
def drift_columns(spark: SparkSession, folder: str) -> DataFrame:
    reference, current = drift_pair(spark, folder)
    return plain(drift.drift_columns(reference, current))


@report
def trained_reference_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Nation series against a reference fitted as in training; sales of some fall to a hundredth."""
    panel = nation_sales(spark, folder)
    fell = F.col("store_id") < FALLEN_NATIONS
    now = panel.withColumn("sales", F.when(fell, F.col("sales") / 100).otherwise(F.col("sales")))
    known, current = (features.feature_frame(p, NATION, layout=PANEL) for p in (panel, now))
    fitted = drift.fit_reference(known, reference_sample(known, NATION).columns)
    return plain(drift.drift_columns(fitted, current))


@report
def reference_merged(spark: SparkSession, folder: str) -> DataFrame:
    """A drift reference merged from sketches of single years, against counts of all rows.

    An edge is near if its rank among all rows is off by no more than the sketches' stated error.
    """
    lines = table(spark, folder, "lineitem")
    year = F.year("l_shipdate")
    years = sorted(r[0] for r in lines.select(year).distinct().collect())
    parts = [sketches.column_sketches(lines.where(year == y), DRIFT_COLUMNS) for y in years]
    merged = settled(sketches.merge_sketches(*parts))  # one row per column
    fitted = sketches.sketched_reference(merged)
    edges = drift.edges_frame(spark, fitted.edges)
    every = drift.to_long(lines, {c: F.col(c) for c in DRIFT_COLUMNS}, value_as="x")
    # At most eleven edges per column, so a broadcast of about forty rows.
    ranks = every.join(F.broadcast(edges), "column").groupBy("column", "edge", "value").agg(
        F.count_if(F.col("x") < F.col("value")).alias("under"),
        F.count_if(F.col("x") <= F.col("value")).alias("upto"), F.count(F.lit(1)).alias("n"))
    # Edges are distinct, so an edge stands for a range of shares: up to the next edge's.
    share = F.array(*[F.lit(i / drift.BINS) for i in range(drift.BINS + 1)])
    off = F.array_min(F.transform(share, lambda q: F.greatest(
        F.col("under") / F.col("n") - q, q - F.col("upto") / F.col("n"), F.lit(0.0))))
    near = ranks.groupBy("column").agg(
        (F.max(off) <= sketches.RANK_ERROR).alias("edges_near"), F.max("n").alias("n_rows"))
    return plain(near.join(merged.select("column", "n", "low", "high"), "column"))


@report
def drift_report(spark: SparkSession, folder: str) -> DataFrame:
    reference, current = drift_pair(spark, folder)
    found = drift.check_drift(reference, current)
    names = F.array_join(F.map_keys("columns"), ",")
    return plain(found.withColumn("columns", names))


@report
def prediction_drift(spark: SparkSession, folder: str) -> DataFrame:
    reference, current = drift_pair(spark, folder)
    found = drift.check_drift(reference, current, ["l_extendedprice"])
    return plain(found.drop("columns"))


@report
def health_report(spark: SparkSession, folder: str) -> DataFrame:
    """Best baseline as the approved model, with data and prediction drift."""
    metrics = settled(evaluate.forecast_metrics(baseline_scores(spark, folder)))
    entries = F.collect_list(F.struct("model_name", F.struct("mae", "rmse", "rmspe")))
    by_model = metrics.agg(F.map_from_entries(entries).alias("metrics"))
    run = evaluate.select_best(metrics).withColumn("metrics", by_model.scalar())
    reference, current = drift_pair(spark, folder)
    verdicts = settled(drift.drift_columns(reference, current))
    data = drift.dataset_verdict(verdicts)
    target = drift.dataset_verdict(verdicts.where(F.col("column") == "l_extendedprice"))
    found = health.health_report(run, data, target).drop("note", "drift_error")
    models_in = F.array_join(F.array_sort(F.map_keys("metrics")), ",")
    return plain(found.withColumn("metrics", models_in))


@report
def retrain_decision(spark: SparkSession, folder: str) -> DataFrame:
    reference, current = drift_pair(spark, folder)
    return plain(health.retrain_decision(drift.check_drift(reference, current)))


@report
def reference_sample_rows(spark: SparkSession, folder: str) -> DataFrame:
    return plain(reference_sample(
        daily_features(spark, folder), DAILY, keep=("store_id", "sale_date")
    ))


REPORTS["reference_sample"] = REPORTS.pop("reference_sample_rows")

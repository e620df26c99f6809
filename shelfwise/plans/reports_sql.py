"""Each registered query as SQL for an independent engine, written from its meaning."""

from __future__ import annotations

from collections.abc import Sequence

from shelfwise.operators.features import LAGS, ROLLS
from shelfwise.operators.forecast import PRODUCT_FACTORS
from shelfwise.operators.windows import HORIZON, LOOKBACK
from shelfwise.plans.reports import (
    CHAMPION_LOOKBACK,
    DRIFT_COLUMNS,
    FALLEN_NATIONS,
    PAIR_PENALTY,
    PRICE_RISE,
    SALES_RISE,
    SPLIT_DAY,
    STUMP_FEATURES,
)

DAILY = """daily AS (
  SELECT o_orderpriority AS store_id, CAST(o_orderdate AS DATE) AS sale_date,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sales,
         COUNT(DISTINCT o_custkey) AS customers,
         CAST(MAX(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS promo
  FROM orders GROUP BY 1, 2)"""

NATION = """nation_daily AS (
  SELECT CAST(c_nationkey AS BIGINT) AS store_id, CAST(o_orderdate AS DATE) AS sale_date,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sales
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""

DAY = "strftime(sale_date, '%Y-%m-%d') AS sale_date"

CALENDAR = """isodow(sale_date) - 1 AS dow, day(sale_date) AS day, month(sale_date) AS month,
  year(sale_date) AS year, weekofyear(sale_date) AS weekofyear,
  CAST(isodow(sale_date) >= 6 AS BIGINT) AS is_weekend"""

CALENDAR_NAMES = ("dow", "day", "month", "year", "weekofyear", "is_weekend")


def lags(target: str) -> str:
    return ", ".join(f"LAG({target}, {n}) OVER w AS {target}_lag{n}" for n in LAGS)


def rolls(target: str, keys: str, order: str) -> str:
    parts = []
    for r in ROLLS:
        over = (f"OVER (PARTITION BY {keys} ORDER BY {order} "
                f"ROWS BETWEEN {r} PRECEDING AND 1 PRECEDING)")
        parts.append(f"CASE WHEN COUNT({target}) {over} = {r} THEN AVG({target}) {over} END "
                     f"AS {target}_roll{r}")
    return ", ".join(parts)


LAG_NAMES = [f"sales_lag{n}" for n in LAGS]
ROLL_NAMES = [f"sales_roll{r}" for r in ROLLS]
ENGINEERED = [*CALENDAR_NAMES, *LAG_NAMES, *ROLL_NAMES]
FEATURES = ["customers", "promo", *ENGINEERED]


def frame(source: str = "daily", alias: str = "frame") -> str:
    """Engineered rows without missing values."""
    known = " AND ".join(f"{c} IS NOT NULL" for c in [*LAG_NAMES, *ROLL_NAMES])
    return f"""{alias}_all AS (
  SELECT *, {CALENDAR}, {lags("sales")}, {rolls("sales", "store_id", "sale_date")}
  FROM {source} WINDOW w AS (PARTITION BY store_id ORDER BY sale_date)),
{alias} AS (SELECT * FROM {alias}_all WHERE {known})"""


NUMBERED = f"""numbered AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY store_id ORDER BY sale_date) - 1 AS pos,
         COUNT(*) OVER (PARTITION BY store_id) AS n
  FROM frame),
win AS (
  SELECT *, pos - {LOOKBACK} AS window_index, n - {LOOKBACK + HORIZON - 1} AS n_windows
  FROM numbered WHERE pos >= {LOOKBACK} AND pos <= n - {HORIZON})"""

WINDOWS = f"WITH {DAILY}, {frame()}, {NUMBERED}"


def rounded(columns: list[str], digits: int = 4) -> str:
    return ", ".join(f"ROUND({c}, {digits}) AS {c}" for c in columns)


def shifted(low: int, high: int) -> str:
    """Rows of a window at places low..high-1, counted from its first lookback row."""
    return f"""{WINDOWS}
SELECT w.store_id, strftime(w.sale_date, '%Y-%m-%d') AS sale_date,
       v.pos - w.pos - ({low}) AS place, ROUND(v.sales, 4) AS value
FROM win w JOIN numbered v
  ON v.store_id = w.store_id AND v.pos BETWEEN w.pos + ({low}) AND w.pos + ({high}) - 1"""


WEEKDAY_FACTOR = "CASE isodow({0}) WHEN 7 THEN 0.3 WHEN 5 THEN 0.8 WHEN 6 THEN 0.8 ELSE 1.0 END"

RECENT = f"""newest AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY store_id ORDER BY sale_date DESC) AS back FROM daily),
recent AS (
  SELECT store_id, AVG(sales) AS recent_average, MAX(sale_date) AS last_date
  FROM newest WHERE back <= {LOOKBACK} GROUP BY store_id),
ahead AS (
  SELECT store_id, recent_average, CAST(s AS BIGINT) AS step,
         CAST(last_date + CAST(s AS INTEGER) AS DATE) AS date
  FROM recent, range(1, {HORIZON + 1}) AS t(s)),
weekday AS (
  SELECT *, GREATEST(recent_average * {WEEKDAY_FACTOR.format("date")}, 0) AS forecast FROM ahead)"""

SUMMARY = """totals AS (
  SELECT store_id, MAX(recent_average) AS ravg, AVG(forecast) AS favg FROM weekday GROUP BY 1),
deltas AS (SELECT *, (favg - ravg) / GREATEST(ravg, 1e-6) AS delta FROM totals),
summary AS (
  SELECT store_id, round_even(ravg, 1) AS recent_average, round_even(favg, 1) AS forecast_average,
         round_even(delta * 100, 1) AS trend_pct, delta,
         CAST(ABS(round_even(delta * 100, 0)) AS BIGINT) AS pct FROM deltas)"""

SCORES = f"""scores AS (
  SELECT m.model_name, w.store_id, w.sale_date, h.h, y.sales AS y,
         CASE WHEN m.model_name = 'moving_average' THEN w.past_mean
              ELSE GREATEST(w.past_mean * {WEEKDAY_FACTOR.format("CAST(w.sale_date + h.h AS DATE)")},
                            0) END AS p
  FROM (SELECT numbered.*, AVG(sales) OVER (PARTITION BY store_id ORDER BY sale_date
               ROWS BETWEEN {LOOKBACK} PRECEDING AND 1 PRECEDING) AS past_mean FROM numbered) w
  JOIN (SELECT CAST(i AS INTEGER) AS h FROM range(0, {HORIZON}) AS t(i)) h ON TRUE
  JOIN numbered y ON y.store_id = w.store_id AND y.pos = w.pos + h.h
  CROSS JOIN (VALUES ('moving_average'), ('weekday')) AS m(model_name)
  WHERE w.pos >= {LOOKBACK} AND w.pos <= w.n - {HORIZON}
    AND w.pos - {LOOKBACK} >= FLOOR((w.n - {LOOKBACK + HORIZON - 1}) * 0.8)),
metrics AS (
  SELECT model_name, AVG(ABS(y - p)) AS mae, SQRT(AVG((y - p) * (y - p))) AS rmse,
         SQRT(AVG(CASE WHEN y > 0 THEN POWER((y - p) / (y + 1e-6), 2) END)) AS rmspe
  FROM scores GROUP BY 1)"""

GAPS = """gaps AS (
  SELECT o_orderkey, o_orderstatus,
         CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS o_totalprice,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS o_orderpriority
  FROM orders)"""


def profile(source: str, columns: dict[str, bool]) -> str:
    """``columns``: name and whether it is text."""
    parts = []
    for i, (c, text) in enumerate(columns.items()):
        distinct = f"COUNT(DISTINCT {c})"
        missing = f"COUNT(*) - COUNT({c})"
        high = f"{distinct} > 50" if text else "FALSE"
        parts.append(
            f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS \"column\", COUNT(*) AS n_rows, "
            f"{distinct} AS nunique, {missing} AS missing, "
            f"{distinct} + CASE WHEN {missing} > 0 THEN 1 ELSE 0 END <= 1 AS is_constant, "
            f"{high} AS is_high_cardinality, {missing} > 0.4 * COUNT(*) AS is_heavy_missing "
            f"FROM {source}"
        )
    return " UNION ALL ".join(parts)


PROFILED = """profiled AS (
  SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN l_tax END AS half_missing, 'x' AS constant,
         'part ' || l_partkey AS part_label FROM lineitem)"""
PROFILED_COLUMNS = {
    "l_orderkey": False, "l_partkey": False, "l_suppkey": False, "l_linenumber": False,
    "l_quantity": False, "l_extendedprice": False, "l_discount": False, "l_tax": False,
    "l_returnflag": True, "l_linestatus": True, "l_shipdate": False,
    "half_missing": False, "constant": True, "part_label": True,
}
DOCUMENT_COLUMNS = {"doc_id": False, "text": True, "lang": True, "source": True, "n_chars": False}

LINEITEM_NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
)
LINEITEM_TEXTS = ("l_returnflag", "l_linestatus")


def small_ints(column: str) -> str:
    return (f"COUNT(DISTINCT {column}) <= 12 AND BOOL_AND({column} = FLOOR({column}) "
            f"AND {column} BETWEEN -1 AND 12)")


def kinds(source: str, numbers: tuple[str, ...], texts: tuple[str, ...]) -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", CASE WHEN {small_ints(c)} THEN 'categorical' "
        f"ELSE 'numeric' END AS kind FROM {source}" for c in numbers
    ]
    parts += [f"SELECT '{c}', 'categorical'" for c in texts]
    return " UNION ALL ".join(parts)


FREQUENCY = """days AS (SELECT DISTINCT sale_date FROM daily),
day_gaps AS (SELECT sale_date - LAG(sale_date) OVER (ORDER BY sale_date) AS gap FROM days),
freq AS (
  SELECT CASE WHEN (SELECT COUNT(*) FROM days) < 3 THEN NULL
              WHEN FLOOR(MEDIAN(gap)) = 1 THEN 'D' WHEN FLOOR(MEDIAN(gap)) = 7 THEN 'W'
              ELSE CAST(CAST(FLOOR(MEDIAN(gap)) AS BIGINT) AS VARCHAR) || 'D' END AS frequency
  FROM day_gaps WHERE gap > 0)"""


def sides(lines: str, columns: Sequence[str]) -> str:
    """Histograms and PSI of the columns of ``lines``, a SELECT with a column ``side``."""
    tall = " UNION ALL ".join(
        f"SELECT side, '{c}' AS col, CAST({c} AS DOUBLE) AS x FROM lines" for c in columns)
    return f"""lines AS ({lines}),
tall AS ({tall}),
quant AS (
  SELECT col, UNNEST(quantile_cont(x, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])) AS e
  FROM tall WHERE side = 'reference' GROUP BY col),
edges AS (
  SELECT col, e, ROW_NUMBER() OVER (PARTITION BY col ORDER BY e) - 1 AS i
  FROM (SELECT DISTINCT col, e FROM quant)),
ends AS (SELECT col, MIN(e) AS low, MAX(e) AS high, COUNT(*) - 1 AS k FROM edges GROUP BY col),
binned AS (
  SELECT t.side, t.col,
         CASE WHEN t.x < ends.low OR t.x > ends.high THEN -1
              ELSE LEAST((SELECT MAX(i) FROM edges e WHERE e.col = t.col AND e.e <= t.x), ends.k - 1)
         END AS bin
  FROM tall t JOIN ends ON ends.col = t.col),
hist AS (SELECT side, col, bin, COUNT(*) AS n FROM binned GROUP BY 1, 2, 3),
sums AS (
  SELECT side, col, CAST(SUM(CASE WHEN bin >= 0 THEN n ELSE 0 END) AS BIGINT) AS total,
         CAST(SUM(CASE WHEN bin < 0 THEN n ELSE 0 END) AS BIGINT) AS outside FROM hist GROUP BY 1, 2),
shares AS (
  SELECT ends.col, b.bin,
         GREATEST(COALESCE(r.n, 0) / rs.total, 1e-6) AS r, GREATEST(COALESCE(c.n, 0) / cs.total, 1e-6) AS c
  FROM ends CROSS JOIN (SELECT i AS bin FROM range(0, 10) AS t(i)) b
  JOIN sums rs ON rs.col = ends.col AND rs.side = 'reference'
  JOIN sums cs ON cs.col = ends.col AND cs.side = 'current'
  LEFT JOIN hist r ON r.col = ends.col AND r.bin = b.bin AND r.side = 'reference'
  LEFT JOIN hist c ON c.col = ends.col AND c.bin = b.bin AND c.side = 'current'
  WHERE b.bin < ends.k),
psi AS (SELECT col, SUM((c - r) * LN(c / r)) AS score FROM shares GROUP BY col)"""


SIDES = sides(f"""
  SELECT CASE WHEN l_shipdate < TIMESTAMP '{SPLIT_DAY}' THEN 'reference' ELSE 'current' END AS side,
         l_quantity, l_discount, l_tax,
         CASE WHEN l_shipdate < TIMESTAMP '{SPLIT_DAY}' THEN l_extendedprice
              ELSE ROUND(l_extendedprice * CAST({PRICE_RISE} AS DOUBLE), 2) END AS l_extendedprice
  FROM lineitem""", DRIFT_COLUMNS)
FALLEN_COLUMNS = ["sales", *ENGINEERED]
FALLEN = f"""{NATION}, {frame("nation_daily", "known")},
fallen AS (SELECT store_id, sale_date,
  CASE WHEN store_id < {FALLEN_NATIONS} THEN sales / 100 ELSE sales END AS sales FROM nation_daily),
{frame("fallen", "now_on")}, """ + sides(" UNION ALL ".join(
    f"SELECT '{side}' AS side, {', '.join(FALLEN_COLUMNS)} FROM {source}"
    for side, source in (("reference", "known"), ("current", "now_on"))), FALLEN_COLUMNS)


IS_TRAIN = f"w.pos - {LOOKBACK} < FLOOR((w.n - {LOOKBACK + HORIZON - 1}) * 0.8)"


def past_means(source: str) -> str:
    """Rows with their place and the means of the rows before them over both lookbacks."""
    over = "PARTITION BY store_id ORDER BY sale_date ROWS BETWEEN {} PRECEDING AND 1 PRECEDING"
    return f"""SELECT store_id, sales, ROW_NUMBER() OVER (PARTITION BY store_id ORDER BY sale_date) - 1 AS pos,
      COUNT(*) OVER (PARTITION BY store_id) AS n,
      AVG(sales) OVER ({over.format(CHAMPION_LOOKBACK)}) AS short,
      AVG(sales) OVER ({over.format(LOOKBACK)}) AS long FROM {source}"""


def stump() -> str:
    """Every value of every feature as a threshold; the one that lowers the squared error most."""
    targets = ("l_extendedprice", "l_quantity * (1 - l_discount)")
    rows = " UNION ALL ".join(
        f"SELECT {step} AS step, {i} AS place, '{f}' AS feature, CAST({f} AS DOUBLE) AS x, {y} AS y FROM lineitem"
        for step, y in enumerate(targets) for i, f in enumerate(STUMP_FEATURES))
    return f"""WITH raw AS ({rows}),
        tall AS (SELECT * REPLACE (y - AVG(y) OVER (PARTITION BY step, place) AS y) FROM raw),
        sums AS (SELECT step, place, feature, x, SUM(y) AS g, COUNT(*) AS n FROM tall GROUP BY 1, 2, 3, 4),
        upto AS (SELECT *, SUM(g) OVER w AS gl, SUM(n) OVER w AS nl,
            SUM(g) OVER (PARTITION BY step, place) AS g_all, SUM(n) OVER (PARTITION BY step, place) AS n_all
          FROM sums WINDOW w AS (PARTITION BY step, place ORDER BY x)),
        gains AS (SELECT *, gl * gl / (nl + 1) + (g_all - gl) * (g_all - gl) / (n_all - nl + 1) AS gain
          FROM upto WHERE nl < n_all),
        best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY step ORDER BY gain DESC, place, x) AS rank FROM gains)
        SELECT CAST(step AS BIGINT) AS step, feature, ROUND(x, 2) AS threshold, ROUND(gl / (nl + 1), 2) AS left_value,
          ROUND((g_all - gl) / (n_all - nl + 1), 2) AS right_value FROM best WHERE rank = 1"""


def past_lines(source: str, where: str, x: str) -> str:
    """Least squares of the sales of every step on one past mean."""
    return f"""SELECT v.pos - w.pos AS h, regr_slope(v.sales, w.{x}) AS slope, regr_intercept(v.sales, w.{x}) AS start
      FROM {source} w JOIN {source} v ON v.store_id = w.store_id AND v.pos BETWEEN w.pos AND w.pos + {HORIZON - 1}
      WHERE {where} GROUP BY 1"""


def dataset(where: str = "TRUE") -> str:
    return f"""SELECT 'psi' AS method, COUNT(*) AS n_columns,
  CAST(SUM(CASE WHEN score > 0.25 THEN 1 ELSE 0 END) AS BIGINT) AS n_drifted,
  ROUND(AVG(CASE WHEN score > 0.25 THEN 1.0 ELSE 0.0 END), 3) AS drift_share,
  AVG(CASE WHEN score > 0.25 THEN 1.0 ELSE 0.0 END) >= 0.4 AS dataset_drift,
  (SELECT MAX(total + outside) FROM sums WHERE side = 'current' AND {where}) AS n_compared
  FROM psi WHERE {where}"""


TARGET_DRIFT = dataset("col = 'l_extendedprice'")


def row_weight() -> str:
    """Place-weighted sums of one lookback row's entries for its place in the window."""
    width = 1 + len(FEATURES)
    entries = ["sales", *FEATURES]
    plain_sum = " + ".join(entries)
    inner = " + ".join(f"{j + 1} * {c}" for j, c in enumerate(entries))
    return f"({inner}) AS inner_sum, ({plain_sum}) * {width} AS step_sum"


SEQUENCE = " + ".join(
    f"LAG(inner_sum, {LOOKBACK - k}) OVER w + {k} * LAG(step_sum, {LOOKBACK - k}) OVER w"
    for k in range(LOOKBACK)
)
BY_STORE = "WINDOW w AS (PARTITION BY store_id ORDER BY sale_date)"
IN_WINDOW = f"pos >= {LOOKBACK} AND pos <= n - {HORIZON}"
PRODUCTS = ", ".join(f"('{p}', {f})" for p, f in PRODUCT_FACTORS)
DAILY_COLUMNS = f"store_id, {DAY}, ROUND(sales, 4) AS sales, customers, promo"

SQL: dict[str, str] = {
    "row_cap": f"WITH {DAILY}, first_rows AS (SELECT * FROM daily ORDER BY store_id, sale_date "
               f"LIMIT 1000) SELECT {DAILY_COLUMNS} FROM first_rows",
    "filter_series": f"WITH {DAILY} SELECT {DAILY_COLUMNS} FROM daily WHERE store_id = '1-URGENT'",
    "parse_dates": """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day
        FROM orders WHERE o_orderkey % 10 <> 0""",
    "drop_incomplete": f"""WITH {GAPS} SELECT o_orderkey, o_orderstatus,
        ROUND(o_totalprice, 4) AS o_totalprice, o_orderpriority
        FROM gaps WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL""",
    "impute_median": f"""WITH {GAPS} SELECT o_orderkey, ROUND(COALESCE(o_totalprice,
        (SELECT MEDIAN(o_totalprice) FROM gaps)), 4) AS o_totalprice FROM gaps""",
    "eligible_series": f"""WITH {NATION}, {frame("nation_daily")},
        counted AS (SELECT store_id, COUNT(*) AS n_rows,
          GREATEST(COUNT(*) - {LOOKBACK + HORIZON - 1}, 0) AS n_windows FROM frame GROUP BY 1)
        SELECT * FROM counted WHERE n_windows >= 30 AND n_rows >= 100""",
    "sort_panel": f"""WITH {DAILY} SELECT store_id, {DAY}, ROUND(sales, 4) AS sales,
        ROW_NUMBER() OVER (PARTITION BY store_id ORDER BY daily.sale_date) - 1 AS position
        FROM daily""",
    "profile_columns": f"WITH {PROFILED} {profile('profiled', PROFILED_COLUMNS)}",
    "profile_documents": profile("documents", DOCUMENT_COLUMNS),
    "profile_table": f"""WITH {PROFILED}, cols AS ({profile("profiled", PROFILED_COLUMNS)}),
        dup AS (SELECT (SELECT COUNT(*) FROM profiled) -
          (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM profiled)) AS duplicate_rows),
        s AS (SELECT MAX(n_rows) AS n_rows, COUNT(*) AS n_columns,
          STRING_AGG("column", '; ' ORDER BY position) FILTER (WHERE is_constant) AS cc,
          STRING_AGG("column", '; ' ORDER BY position) FILTER (WHERE is_high_cardinality) AS hc,
          STRING_AGG("column", '; ' ORDER BY position) FILTER (WHERE is_heavy_missing) AS hm
          FROM cols)
        SELECT n_rows, n_columns, COALESCE(cc, '') AS constant_columns,
          COALESCE(hc, '') AS high_cardinality, COALESCE(hm, '') AS heavy_missing, duplicate_rows,
          CONCAT_WS('; ',
            CASE WHEN cc IS NOT NULL THEN 'Constant columns (no signal): [''' ||
              REPLACE(cc, '; ', ''', ''') || ''']' END,
            CASE WHEN duplicate_rows > 0 THEN duplicate_rows || ' duplicate rows.' END,
            CASE WHEN hm IS NOT NULL THEN 'Columns >40% missing: [''' ||
              REPLACE(hm, '; ', ''', ''') || ''']' END) AS warnings
        FROM s, dup""",
    "duplicate_rows": """SELECT 'lineitem' AS table_name, (SELECT COUNT(*) FROM lineitem) -
          (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_rows UNION ALL
        SELECT 'documents', (SELECT COUNT(*) FROM documents) - (SELECT COUNT(*) FROM
          (SELECT DISTINCT text, lang, source, n_chars FROM documents))""",
    "detect_date": """WITH r AS (
        SELECT 'o_orderpriority' AS "column", 0.0 AS q, 1 AS place UNION ALL
        SELECT 'order_day', AVG(CASE WHEN o_orderkey % 4 <> 0 THEN 1.0 ELSE 0.0 END), 2 FROM orders
        UNION ALL
        SELECT 'ship_text', AVG(CASE WHEN o_orderkey % 3 <> 0 THEN 1.0 ELSE 0.0 END), 3 FROM orders)
        SELECT "column", ROUND(q, 4) AS parse_ratio,
          ROW_NUMBER() OVER (ORDER BY q DESC, place) = 1 AND q > 0 AS chosen FROM r""",
    "detect_roles": f"""WITH {DAILY}, {FREQUENCY},
        k AS ({kinds("daily", ("customers", "promo"), ())})
        SELECT 'sale_date' AS date_column, 'sales' AS target_column, 'store_id' AS group_column,
          (SELECT frequency FROM freq) AS frequency,
          COALESCE((SELECT STRING_AGG("column", ',' ORDER BY "column") FROM k
                    WHERE kind = 'numeric'), '') AS numerical,
          COALESCE((SELECT STRING_AGG("column", ',' ORDER BY "column") FROM k
                    WHERE kind = 'categorical'), '') AS categorical,
          CAST(1.0 AS DOUBLE) AS date_confidence, CAST(0.9 AS DOUBLE) AS target_confidence""",
    "detect_target_variance": "WITH v AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", VAR_SAMP({c}) AS variance FROM lineitem"
        for c in LINEITEM_NUMBERS) + """) SELECT "column", ROUND(variance / 1e6, 2) AS variance
        FROM v ORDER BY v.variance DESC LIMIT 1""",
    "classify_features": kinds("lineitem", LINEITEM_NUMBERS, LINEITEM_TEXTS),
    "detect_frequency": f"WITH {DAILY}, {FREQUENCY} SELECT frequency FROM freq",
    "fit_scaler": """WITH g AS (SELECT
          CASE WHEN l_orderkey % 10 <> 0 THEN l_extendedprice END AS l_extendedprice,
          CASE WHEN l_orderkey % 3 <> 0 THEN l_quantity END AS l_quantity, l_discount
          FROM lineitem) """ + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", ROUND(ANY_VALUE(m), 4) AS median,
            ROUND(AVG(COALESCE({c}, m)), 4) AS mean, ROUND(STDDEV_POP(COALESCE({c}, m)), 4) AS std
            FROM g, (SELECT MEDIAN({c}) AS m FROM g)"""
        for c in ("l_extendedprice", "l_quantity", "l_discount")),
    "scale_numeric": f"""WITH {GAPS}, f AS (SELECT o_orderkey, COALESCE(o_totalprice,
          (SELECT MEDIAN(o_totalprice) FROM gaps)) AS x FROM gaps)
        SELECT o_orderkey, ROUND((x - (SELECT AVG(x) FROM f)) / (SELECT STDDEV_POP(x) FROM f), 4)
          AS o_totalprice FROM f""",
    "fit_encoder": f"""WITH {GAPS}, pairs AS (
          SELECT DISTINCT 'o_orderstatus' AS "column", o_orderstatus AS category FROM gaps UNION ALL
          SELECT DISTINCT 'o_orderpriority', COALESCE(o_orderpriority, 'NA') FROM gaps)
        SELECT "column", category,
          ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY category) - 1 AS code FROM pairs""",
    "encode_categorical": f"""WITH {GAPS}, p AS (
          SELECT category, ROW_NUMBER() OVER (ORDER BY category) - 1 AS code FROM (
            SELECT DISTINCT COALESCE(o_orderpriority, 'NA') AS category FROM gaps
            WHERE o_orderpriority IS DISTINCT FROM '3-MEDIUM')),
        s AS (
          SELECT category, ROW_NUMBER() OVER (ORDER BY category) - 1 AS code FROM (
            SELECT DISTINCT COALESCE(o_orderstatus, 'NA') AS category FROM gaps
            WHERE o_orderpriority IS DISTINCT FROM '3-MEDIUM'))
        SELECT o_orderkey, CAST(COALESCE(s.code, -1) AS DOUBLE) AS o_orderstatus,
          CAST(COALESCE(p.code, -1) AS DOUBLE) AS o_orderpriority
        FROM gaps LEFT JOIN s ON s.category = COALESCE(o_orderstatus, 'NA')
        LEFT JOIN p ON p.category = COALESCE(o_orderpriority, 'NA')""",
    "calendar_features": f"WITH {DAILY} SELECT store_id, strftime(sale_date, '%Y-%m-%d') "
                         f"AS sale_date, {CALENDAR.replace('sale_date', 'daily.sale_date')} FROM daily",
    "lag_features": f"""WITH {DAILY}, l AS (SELECT *, {lags("sales")} FROM daily {BY_STORE})
        SELECT {DAILY_COLUMNS}, {rounded(LAG_NAMES)} FROM l""",
    "rolling_features": f"""WITH {DAILY}, r AS (
          SELECT *, {rolls("sales", "store_id", "sale_date")} FROM daily)
        SELECT {DAILY_COLUMNS}, {rounded(ROLL_NAMES)} FROM r""",
    "feature_frame": f"""WITH {DAILY}, {frame()} SELECT {DAILY_COLUMNS},
        {", ".join(CALENDAR_NAMES)}, {rounded([*LAG_NAMES, *ROLL_NAMES])} FROM frame""",
    "lag_features_intraday": f"""WITH l AS (SELECT event_type, event_id, value, {lags("value")}
          FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
        SELECT event_type, event_id, ROUND(value, 4) AS value,
          {rounded([f"value_lag{n}" for n in LAGS])} FROM l""",
    "rolling_features_intraday": f"""WITH r AS (SELECT event_type, event_id, value,
          {rolls("value", "event_type", "ts, event_id")} FROM events)
        SELECT event_type, event_id, ROUND(value, 4) AS value,
          {rounded([f"value_roll{r}" for r in ROLLS])} FROM r""",
    "posted_batches": f"""WITH r AS (SELECT event_type, event_id, value, {lags("value")},
          {rolls("value", "event_type", "ts, event_id")}
          FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
        SELECT event_type, event_id, ROUND(value, 4) AS value,
          {rounded([*[f"value_lag{n}" for n in LAGS], *[f"value_roll{r}" for r in ROLLS]])} FROM r""",
    "window_lookback_intraday": f"""WITH x AS (SELECT event_type, event_id,
          ROW_NUMBER() OVER w - 1 - {LOOKBACK} AS window_index,
          COUNT(*) OVER (PARTITION BY event_type) - {LOOKBACK + HORIZON - 1} AS n_windows,
          AVG(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
            ROWS BETWEEN {LOOKBACK} PRECEDING AND 1 PRECEDING) AS past_mean,
          AVG(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
            ROWS BETWEEN CURRENT ROW AND {HORIZON - 1} FOLLOWING) AS future_mean
          FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
        SELECT event_type, event_id, window_index, n_windows, ROUND(past_mean, 4) AS past_mean,
          ROUND(future_mean, 4) AS future_mean FROM x
        WHERE window_index >= 0 AND window_index < n_windows""",
    "window_lookback": shifted(-LOOKBACK, 0),
    "window_horizon": shifted(0, HORIZON),
    "window_tabular": f"""{WINDOWS}
        SELECT w.store_id, strftime(w.sale_date, '%Y-%m-%d') AS sale_date,
          v.pos - w.pos + {LOOKBACK} AS place, ROUND(v.sales, 4) AS value
        FROM win w JOIN numbered v
          ON v.store_id = w.store_id AND v.pos BETWEEN w.pos - {LOOKBACK} AND w.pos - 1
        UNION ALL """ + " UNION ALL ".join(
        f"SELECT store_id, strftime(sale_date, '%Y-%m-%d'), {LOOKBACK + j}, "
        f"ROUND(CAST({c} AS DOUBLE), 4) FROM win" for j, c in enumerate(FEATURES)),
    "window_sequence": f"""WITH {DAILY}, {frame()}, {NUMBERED.split("win AS")[0].rstrip().rstrip(",")},
        z AS (SELECT *, {row_weight()} FROM numbered),
        x AS (SELECT *, {SEQUENCE} AS weighted FROM z {BY_STORE})
        SELECT store_id, {DAY}, CAST({LOOKBACK} AS BIGINT) AS steps,
          CAST({LOOKBACK * (1 + len(FEATURES))} AS BIGINT) AS width,
          ROUND(weighted / SQRT(2), 0) AS weighted FROM x WHERE {IN_WINDOW}""",
    "window_count": f"""WITH {DAILY}, {frame()} SELECT store_id, COUNT(*) AS n_rows,
        GREATEST(COUNT(*) - {LOOKBACK + HORIZON - 1}, 0) AS n_windows FROM frame GROUP BY 1""",
    "train_test_split": f"""{WINDOWS} SELECT store_id, {DAY}, window_index,
        window_index < FLOOR(n_windows * 0.8) AS is_train FROM win""",
    "latest_window": f"""{WINDOWS}, last AS (SELECT * FROM win WHERE window_index = n_windows - 1)
        SELECT l.store_id, strftime(l.sale_date, '%Y-%m-%d') AS sale_date,
          strftime(e.sale_date, '%Y-%m-%d') AS end_date,
          v.pos - l.pos + {LOOKBACK} AS place, ROUND(v.sales, 4) AS value
        FROM last l JOIN numbered e ON e.store_id = l.store_id AND e.pos = l.pos + {HORIZON - 1}
        JOIN numbered v ON v.store_id = l.store_id
          AND v.pos BETWEEN l.pos - {LOOKBACK} AND l.pos + {HORIZON - 1}""",
    "horizon_long": f"""{WINDOWS} SELECT w.store_id, strftime(w.sale_date, '%Y-%m-%d') AS sale_date,
          v.pos - w.pos + 1 AS step, ROUND(v.sales, 4) AS y
        FROM win w JOIN numbered v
          ON v.store_id = w.store_id AND v.pos BETWEEN w.pos AND w.pos + {HORIZON - 1}""",
    "dow_baseline": f"""WITH {DAILY}, {RECENT} SELECT store_id, step,
        strftime(date, '%Y-%m-%d') AS date, ROUND(forecast, 4) AS forecast FROM weekday""",
    "forecast_metrics": f"{WINDOWS}, {SCORES} SELECT model_name, {rounded(['mae', 'rmse', 'rmspe'])} "
                        "FROM metrics",
    "select_best": f"""{WINDOWS}, {SCORES} SELECT model_name AS best_model, 'rmspe' AS selected_by
        FROM metrics ORDER BY rmspe, model_name LIMIT 1""",
    "promote_champion": f"""{WINDOWS}, {SCORES},
        two AS (SELECT (SELECT rmse FROM metrics WHERE model_name = 'moving_average') AS a,
                       (SELECT rmse FROM metrics WHERE model_name = 'weekday') AS b)
        SELECT 'moving_average' AS champion, ROUND(a, 4) AS champion_metric,
          'weekday' AS challenger, ROUND(b, 4) AS challenger_metric, b < a AS promoted,
          CASE WHEN b < a THEN 'weekday' ELSE 'moving_average' END AS approved_model FROM two""",
    "future_dates": f"""WITH {DAILY}, {RECENT}
        SELECT store_id, step, strftime(date, '%Y-%m-%d') AS date FROM ahead""",
    "recent_average": f"""WITH {DAILY}, {RECENT} SELECT store_id,
        ROUND(recent_average, 4) AS recent_average,
        strftime(last_date, '%Y-%m-%d') AS last_date FROM recent""",
    "forecast_summary": f"""WITH {DAILY}, {RECENT}, {SUMMARY}
        SELECT store_id, recent_average, forecast_average, trend_pct,
          CASE WHEN trend_pct > 1 THEN 'increasing' WHEN trend_pct < -1 THEN 'decreasing'
               ELSE 'stable' END AS trend_label,
          CASE WHEN delta > 0.05 THEN 'Demand trending UP ~' || pct ||
                 '% — consider increasing inventory & staffing.'
               WHEN delta < -0.05 THEN 'Demand trending DOWN ~' || pct ||
                 '% — consider reducing stock to avoid waste.'
               ELSE 'Demand roughly stable — maintain current inventory levels.' END AS insight
        FROM summary""",
    "inventory_recommendations": f"""WITH {DAILY}, {RECENT}, {SUMMARY}, r AS (
          SELECT store_id, product, CAST(FLOOR(trend_pct * CAST(f AS DOUBLE) + 0.5) AS BIGINT) AS c
          FROM summary CROSS JOIN (VALUES {PRODUCTS}) AS p(product, f))
        SELECT store_id, product, c AS change_pct,
          CASE WHEN c > 1 THEN 'Increase ' || c || '%' WHEN c < -1 THEN 'Reduce ' || ABS(c) || '%'
               ELSE 'Hold' END AS action FROM r""",
    "forecast_band": f"""WITH {DAILY}, {RECENT} SELECT store_id,
        ROUND(recent_average, 4) AS recent_average, step, strftime(date, '%Y-%m-%d') AS date,
        ROUND(forecast, 4) AS forecast, ROUND(forecast * 0.88, 4) AS lower,
        ROUND(forecast * 1.12, 4) AS upper FROM weekday""",
    "chart_series": f"""WITH {DAILY}, {RECENT}, chart AS (
          SELECT store_id, sale_date AS date, sales AS actual,
            CASE WHEN back = 1 THEN sales END AS forecast FROM newest WHERE back <= 21 UNION ALL
          SELECT store_id, date, NULL, forecast FROM weekday)
        SELECT store_id, strftime(date, '%Y-%m-%d') AS date, ROUND(actual, 4) AS actual,
          ROUND(forecast, 4) AS forecast, ROUND(forecast * 0.88, 4) AS lower,
          ROUND(forecast * 1.12, 4) AS upper FROM chart""",
    "psi_edges": f"""WITH {SIDES} SELECT col AS "column", i AS edge, ROUND(e, 6) AS value FROM edges""",
    "psi_histogram": f"""WITH {SIDES} SELECT side, col AS "column", bin, n FROM hist""",
    "psi_score": f"""WITH {SIDES} SELECT psi.col AS "column", ROUND(score, 4) AS score,
        outside AS n_out_of_range, total + outside AS n_values
        FROM psi JOIN sums ON sums.col = psi.col AND side = 'current'""",
    "drift_columns": f"""WITH {SIDES} SELECT psi.col AS "column", ROUND(score, 4) AS psi,
        score > 0.25 AS drifted, outside AS n_out_of_range, total + outside AS n_values
        FROM psi JOIN sums ON sums.col = psi.col AND side = 'current'""",
    "trained_reference_drift": f"""WITH {FALLEN} SELECT psi.col AS "column", ROUND(score, 4) AS psi,
        score > 0.25 AS drifted, outside AS n_out_of_range, total + outside AS n_values
        FROM psi JOIN sums ON sums.col = psi.col AND side = 'current'""",
    "ols_forecast": f"""{WINDOWS}, {RECENT},
        meant AS (SELECT *, AVG(sales) OVER (PARTITION BY store_id ORDER BY sale_date
          ROWS BETWEEN {LOOKBACK} PRECEDING AND 1 PRECEDING) AS x FROM numbered),
        lines AS (SELECT v.pos - w.pos AS h, regr_slope(v.sales, w.x) AS slope,
          regr_intercept(v.sales, w.x) AS start
          FROM meant w JOIN numbered v
            ON v.store_id = w.store_id AND v.pos BETWEEN w.pos AND w.pos + {HORIZON - 1}
          WHERE w.pos >= {LOOKBACK} AND w.pos <= w.n - {HORIZON} GROUP BY 1)
        SELECT store_id, ROUND(recent_average, 1) AS recent_average, step,
          strftime(date, '%Y-%m-%d') AS date,
          ROUND(GREATEST(start + slope * recent_average, 0), 1) AS forecast
        FROM ahead JOIN lines ON lines.h = step - 1""",
    "linear_pair_forecast": f"""{WINDOWS}, {RECENT},
        meant AS (SELECT *, AVG(sales) OVER (PARTITION BY store_id ORDER BY sale_date
            ROWS BETWEEN {LOOKBACK} PRECEDING AND 1 PRECEDING) AS x1,
          LAG(sales) OVER (PARTITION BY store_id ORDER BY sale_date) AS x2 FROM numbered),
        stats AS (SELECT v.pos - w.pos AS h, corr(w.x1, w.x2) AS r12, corr(w.x1, v.sales) AS r1,
            corr(w.x2, v.sales) AS r2, AVG(w.x1) AS m1, AVG(w.x2) AS m2, AVG(v.sales) AS my,
            stddev_pop(w.x1) AS s1, stddev_pop(w.x2) AS s2, stddev_pop(v.sales) AS sy,
            1 + {PAIR_PENALTY} / stddev_pop(v.sales) AS d
          FROM meant w JOIN numbered v
            ON v.store_id = w.store_id AND v.pos BETWEEN w.pos AND w.pos + {HORIZON - 1}
          WHERE w.pos >= {LOOKBACK} AND w.pos <= w.n - {HORIZON} GROUP BY 1),
        lines AS (SELECT *, (d * r1 - r12 * r2) / (d * d - r12 * r12) * sy / s1 AS b1,
            (d * r2 - r12 * r1) / (d * d - r12 * r12) * sy / s2 AS b2 FROM stats),
        last AS (SELECT store_id, sales AS x2 FROM newest WHERE back = 1)
        SELECT ahead.store_id, ROUND(recent_average, 1) AS recent_average, step,
          strftime(date, '%Y-%m-%d') AS date,
          ROUND(GREATEST(my + b1 * (recent_average - m1) + b2 * (last.x2 - m2), 0), 1) AS forecast
        FROM ahead JOIN lines ON lines.h = step - 1 JOIN last ON last.store_id = ahead.store_id""",
    "boosted_stump": stump(),
    "model_quality": """SELECT m AS model_name, TRUE AS is_finite, TRUE AS rmse_above_mae,
        TRUE AS best_beats_average FROM (VALUES ('gbt'), ('ridge'), ('moving_average')) AS t(m)""",
    "reference_merged": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", TRUE AS edges_near, COUNT({c}) AS n_rows, COUNT({c}) AS n,
          ROUND(MIN(CAST({c} AS DOUBLE)), 4) AS low, ROUND(MAX(CAST({c} AS DOUBLE)), 4) AS high FROM lineitem"""
        for c in DRIFT_COLUMNS),
    "profile_merged": f"""WITH {PROFILED}, p AS ({profile("profiled", PROFILED_COLUMNS)})
        SELECT * EXCLUDE (nunique), TRUE AS nunique_near FROM p""",
    "bootstrap_rows": "SELECT COUNT(*) AS n_rows, TRUE AS mean_fits, TRUE AS share_fits FROM lineitem",
    "champion_rescored": f"""WITH {DAILY},
        early AS (SELECT * FROM daily WHERE sale_date < DATE '{SPLIT_DAY}'),
        late AS (SELECT * REPLACE (sales * {SALES_RISE} AS sales) FROM daily WHERE sale_date >= DATE '{SPLIT_DAY}'),
        {frame("early", "before")}, {frame("late", "now_on")},
        old AS ({past_means("before")}), new AS ({past_means("now_on")}),
        old_lines AS ({past_lines("old", f"w.pos >= {CHAMPION_LOOKBACK} AND w.pos <= w.n - {HORIZON}", "short")}),
        new_lines AS ({past_lines("new", f"w.pos >= {LOOKBACK} AND w.pos <= w.n - {HORIZON} AND {IS_TRAIN}", "long")}),
        pairs AS (
          SELECT v.sales AS y, a.start + a.slope * w.short AS champion, b.start + b.slope * w.long AS challenger
          FROM new w JOIN new v ON v.store_id = w.store_id AND v.pos BETWEEN w.pos AND w.pos + {HORIZON - 1}
          JOIN old_lines a ON a.h = v.pos - w.pos JOIN new_lines b ON b.h = v.pos - w.pos
          WHERE w.pos >= {LOOKBACK} AND w.pos <= w.n - {HORIZON} AND NOT {IS_TRAIN}),
        long AS (UNPIVOT pairs ON champion, challenger INTO NAME model_name VALUE p)
        SELECT model_name, ROUND(AVG(ABS(y - p)) / 1000, 4) AS mae,
          ROUND(SQRT(AVG((y - p) * (y - p))) / 1000, 4) AS rmse,
          ROUND(SQRT(AVG(CASE WHEN y > 0 THEN POWER((y - p) / (y + 1e-6), 2) END)), 4) AS rmspe
        FROM long GROUP BY 1""",
    "drift_report": f"""WITH {SIDES}, d AS ({dataset()})
        SELECT *, (SELECT STRING_AGG(col, ',' ORDER BY col) FROM psi) AS columns FROM d""",
    "prediction_drift": f"WITH {SIDES} {TARGET_DRIFT}",
    "health_report": f"""{WINDOWS}, {SCORES}, {SIDES}, d AS ({dataset()}),
        p AS ({dataset("col = 'l_extendedprice'")})
        SELECT (SELECT model_name FROM metrics ORDER BY rmspe, model_name LIMIT 1) AS approved_model,
          'v1' AS model_version, 'unknown' AS last_retrain,
          (SELECT STRING_AGG(model_name, ',' ORDER BY model_name) FROM metrics) AS metrics,
          d.dataset_drift AS data_drift_detected, d.drift_share AS data_drift_share,
          d.method AS data_drift_method, p.dataset_drift AS prediction_drift_detected,
          p.drift_share AS prediction_drift_share, p.method AS prediction_drift_method,
          d.n_compared AS rows_compared,
          CASE WHEN d.dataset_drift THEN 'DRIFT DETECTED — retraining recommended'
               ELSE 'HEALTHY — no significant drift' END AS status
        FROM d, p""",
    "retrain_decision": f"""WITH {SIDES}, d AS ({dataset()}) SELECT drift_share,
        dataset_drift AS drift,
        CASE WHEN dataset_drift THEN 'retrain_model' ELSE 'skip_retrain' END AS branch FROM d""",
    "reference_sample": f"""WITH {DAILY}, {frame()}, s AS (
          SELECT * FROM frame ORDER BY store_id DESC, sale_date DESC LIMIT 500)
        SELECT {DAILY_COLUMNS}, {", ".join(CALENDAR_NAMES)}, {rounded([*LAG_NAMES, *ROLL_NAMES])}
        FROM s""",
}

"""Training: from a raw table to a stored model, its state and a run-log row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any
from uuid import uuid4

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.calendar import parse_timestamp
from shelfwise.functions.columns import name, settled
from shelfwise.operators.drift import DriftReference, fit_reference
from shelfwise.operators.evaluate import forecast_metrics, scored_long, select_best
from shelfwise.operators.features import LAGS, ROLLS, densify, feature_columns, feature_frame
from shelfwise.operators.models import AnyForecaster, AnyModel, default_candidates
from shelfwise.operators.ordering import Layout, measured_layout
from shelfwise.operators.prep import Preprocessor, filter_series, parse_dates, row_cap
from shelfwise.operators.profile import Profile, profile
from shelfwise.operators.roles import Roles, detect_roles
from shelfwise.operators.sketches import column_sketches
from shelfwise.operators.tails import reach, series_tail
from shelfwise.operators.windows import (
    HORIZON,
    LOOKBACK,
    MIN_WINDOWS,
    TRAIN_SHARE,
    chunk_windows,
    require_windows,
    series_chunks,
    split_windows,
)
from shelfwise.plans.champion import Champion, duel
from shelfwise.sources import state


@dataclass(frozen=True)
class TrainConfig:
    """Arguments of a training run.

    ``baselines``: named array columns over the window table (see ``operators.models``);
    they are scored beside the candidates but only selected where there is no candidate, and then
    the run cannot be stored (a ``BaselineForecaster`` among the candidates can be).
    ``staging``: a shared folder; the raw table is written there as Parquet once, so that
    the many later scans read only the columns they need instead of parsing text again.
    ``densify_days``: fill the calendar of every series in steps of that many days first,
    so that lags count days; filled rows have target 0 and fitted values elsewhere.
    """

    horizon: int = HORIZON
    lookback: int = LOOKBACK
    lags: Sequence[int] = LAGS
    rolls: Sequence[int] = ROLLS
    candidates: Sequence[AnyForecaster] = field(default_factory=default_candidates)
    baselines: dict[str, Column] = field(default_factory=dict)
    selection_metric: str = "rmspe"
    single_group: Any | None = None
    schema_overrides: dict[str, Any] = field(default_factory=dict)
    rows: int | None = None
    fit_on: str = "all"
    date_formats: Sequence[str] = ()
    min_windows: int = MIN_WINDOWS
    exact_profile: bool = True
    layout: Layout | None = None
    staging: str | None = None
    densify_days: int | None = None


@dataclass
class Trained:
    """A finished run. ``metrics``: one row per candidate. ``tail``: the newest parsed rows per
    series. ``sketches``: the reference in a form that later rows can extend. ``duel``: where a champion was given, metrics of both models on the same windows."""

    roles: Roles
    preprocessor: Preprocessor
    models: dict[str, AnyModel]
    best: str
    metrics: DataFrame
    profile: Profile
    features: list[str]
    reference: DriftReference
    sample: DataFrame
    config: TrainConfig
    tail: DataFrame
    sketches: DataFrame
    duel: DataFrame | None = None

    @property
    def best_model(self) -> AnyModel | None:
        return self.models.get(self.best)


def _holds_times(df: DataFrame, date: str, formats: Sequence[str]) -> bool:
    """Does the date column carry times of day? Text dates without them become DATE."""
    if not isinstance(df.schema[date].dataType, T.StringType):
        return not isinstance(df.schema[date].dataType, T.DateType)
    t = parse_timestamp(name(date), formats)
    return bool(df.agg(F.bool_or(t != F.date_trunc("day", t))).first()[0])


def compare(
    windows: DataFrame, config: TrainConfig
) -> tuple[dict[str, AnyModel], DataFrame]:
    """Fit every candidate on the training windows, score all on the test windows.

    ``windows`` must be cheap to read (from kept chunks, or cached): each fit reads it again.
    The test windows are read once for all candidates and baselines.
    """
    training = windows.where("is_train")
    scored = windows.where(~F.col("is_train"))
    models: dict[str, AnyModel] = {}
    predictions: dict[str, Column] = {}
    for i, candidate in enumerate(config.candidates):
        model = candidate.fit(training, config.horizon)
        models[candidate.name] = model
        scored = model.predict(scored, f"_prediction{i}")
        predictions[candidate.name] = F.col(f"_prediction{i}")
    predictions.update(config.baselines)
    if not predictions:
        raise ValueError("no candidate to train")
    return models, forecast_metrics(scored_long(scored, predictions))


def train(
    df: DataFrame, config: TrainConfig | None = None, champion: Champion | None = None
) -> Trained:
    """Profile, detect roles, prepare, engineer, window, fit, evaluate and select.

    ``champion``: the model in service, to be scored on the same test windows as the selected one.
    """
    config = config or TrainConfig()
    spark = df.sparkSession
    if config.rows is not None:
        df = row_cap(df, detect_roles(df, config.schema_overrides), config.rows, config.date_formats)
    if config.staging is not None:
        df.write.mode("overwrite").parquet(config.staging)
        df = spark.read.parquet(config.staging)
    found = profile(df, exact=config.exact_profile)
    roles = detect_roles(df, config.schema_overrides)
    chosen = filter_series(df, roles.series, config.single_group)
    as_date = not _holds_times(chosen, roles.date, config.date_formats)

    pre = Preprocessor(config.date_formats, as_date=as_date)
    layout = config.layout or measured_layout(pre.parsed(chosen, roles), roles)
    if config.fit_on == "train":
        pre.fit(_training_part(pre.parsed(chosen, roles), roles), roles)
    else:
        pre.fit(chosen, roles)
    roles = pre.state.roles
    tail = series_tail(pre.parsed(chosen, roles), roles, max(1, reach(config.lags, config.rolls)))
    original = chosen
    if config.densify_days is not None:
        chosen = densify(parse_dates(chosen, roles.date, config.date_formats, True), roles,
                         config.densify_days, fill=0.0)
    frame = feature_frame(pre.transform(chosen), roles, config.lags, config.rolls, layout).persist(
        StorageLevel.MEMORY_AND_DISK)
    features = feature_columns(frame, roles)
    sequence = any(c.needs_sequence for c in config.candidates)
    # Kept as chunks of series: windows are cut from them whenever they are read.
    chunks = series_chunks(
        frame, roles, config.lookback, config.horizon, features, layout
    ).persist(StorageLevel.MEMORY_AND_DISK)
    windows = split_windows(chunk_windows(chunks, roles, config.lookback, config.horizon, sequence))
    try:
        require_windows(windows.count(), config.min_windows)
        models, metrics = compare(windows, config)
        metrics = settled(metrics)  # one row per candidate
        order = [*models, *config.baselines]
        # Baselines are yardsticks: a stored run needs a model that can be loaded again.
        servable = metrics.where(F.col("model_name").isin(list(models))) if models else metrics
        best = select_best(servable, config.selection_metric, order).first()["best_model"]
        scored = None
        if champion is not None and best in models:
            test = windows.where(~F.col("is_train"))
            scored = settled(duel(test, models[best], champion, original, layout))  # two rows
    finally:
        chunks.unpersist()
    sample = settled(state.reference_sample(frame, roles))  # a top-n of 500 rows
    # The reference covers every row of the frame; the sample is an export only.
    reference = fit_reference(frame, sample.columns)
    sketches = settled(column_sketches(frame, sample.columns))  # one row per column
    frame.unpersist()
    return Trained(
        roles=roles,
        preprocessor=pre,
        models=models,
        best=best,
        metrics=metrics,
        profile=found,
        features=features,
        reference=reference,
        sample=sample,
        config=config,
        tail=tail,
        sketches=sketches,
        duel=scored,
    )


def _training_part(df: DataFrame, roles: Roles) -> DataFrame:
    """The earliest share of every series, cut at a date found by counting days.

    Rows per (series, day) are counted first, so the running sum runs over days.
    """
    keys = [name(roles.series)] if roles.series else []
    day = name(roles.date).cast("date")
    days = df.groupBy(*keys, day.alias("_day")).agg(F.count(F.lit(1)).alias("_k"))
    by = W.partitionBy(*keys)
    upto = F.sum("_k").over(by.orderBy("_day"))
    cut = (
        days.withColumn("_share", upto / F.sum("_k").over(by))
        .where(F.col("_share") <= TRAIN_SHARE)
        .groupBy(*keys)
        .agg(F.max("_day").alias("_cut"))
    )
    if roles.series is None:
        return df.where(day <= cut.scalar())
    return df.join(cut, [roles.series]).where(day <= F.col("_cut")).drop("_cut")


def run_row(
    spark: SparkSession, trained: Trained, folder: str, version: str = "v1", approved: bool = True
) -> DataFrame:
    """The run-log row of a training whose state lies in ``folder``."""
    roles, config = trained.roles, trained.config
    metrics = {
        r["model_name"]: (r["mae"], r["rmse"], r["rmspe"]) for r in trained.metrics.collect()
    }
    row = (
        datetime.now(timezone.utc), trained.best, version, config.horizon, config.lookback,
        metrics, (roles.date, roles.target, roles.series, roles.frequency),
        trained.profile.warnings, trained.features, f"{folder}/model_{trained.best}",
        list(config.lags), list(config.rolls), config.densify_days, folder, approved, None,
    )
    return spark.createDataFrame([row], state.RUN_SCHEMA)


def save(
    trained: Trained, spark: SparkSession, path: str, version: str = "v1", approved: bool = True,
    seen: int | None = None,
) -> str:
    """Write state, best model, reference, sample and tails, and then the run-log entry.

    Every run has a folder of its own (returned), and the log entry that names it comes last: a
    reader finds either the earlier run or all of this one. ``seen``: the log version on which the
    decision to approve rests (see ``state.append_run``).
    """
    if trained.best_model is None:
        raise ValueError(f"{trained.best} cannot be served: add it to the candidates as a BaselineForecaster")
    folder = f"{path}/run-{uuid4().hex}"
    state.save_preprocessor(trained.preprocessor, spark, f"{folder}/preprocessor")
    state.save_model(trained.best_model, spark, f"{folder}/model_{trained.best}")
    trained.sample.write.parquet(f"{folder}/reference_sample")
    state.save_reference(trained.reference, spark, f"{folder}/reference")
    state.save_sketches(trained.sketches, folder, 0)
    state.save_tail(trained.tail, folder, 0)
    state.append_run(run_row(spark, trained, folder, version, approved), f"{path}/runs", seen)
    return folder

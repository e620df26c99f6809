"""Health check and the decision to train again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.columns import settled
from shelfwise.operators import evaluate
from shelfwise.operators.drift import DriftReference, check_drift, dataset_verdict, drift_columns
from shelfwise.operators.features import feature_frame
from shelfwise.operators.health import health_report, retrain_decision
from shelfwise.operators.ordering import AUTO, Layout
from shelfwise.operators.sketches import column_sketches, merge_sketches, sketched_reference
from shelfwise.operators.tails import POSTED, continued, filled_marks, next_tail, reach
from shelfwise.operators.windows import MIN_ROWS, require_rows
from shelfwise.plans.champion import load_champion
from shelfwise.plans.train import TrainConfig, Trained, save, train
from shelfwise.sources import state


def align(
    spark: SparkSession, path: str, posted: DataFrame, layout: Layout = AUTO,
    before: int | None = None, tails: bool = True,
) -> DataFrame:
    """Posted rows prepared and engineered like the training data.

    Lags and means reach back into the tails of the run: the newest rows per series of the training
    and of the batches remembered since (of versions below ``before``). ``tails=False`` looks at the
    posted rows alone; then the first rows of every series have no features and are dropped.
    """
    run = state.current_run(spark, path)
    folder = state.run_folder(run, path)
    pre = state.load_preprocessor(spark, f"{folder}/preprocessor")
    roles, (lags, rolls) = pre.state.roles, state.lags_and_rolls(run)
    tail = state.load_tail(spark, folder, before)[0] if tails else None
    if tail is None:
        return feature_frame(state.engineered(posted, pre, run), roles, lags, rolls, layout)
    both = state.engineered(continued(tail, pre.parsed(posted, roles), roles), pre, run)
    if run["densify_days"] is not None:
        both = filled_marks(both, roles)
    return feature_frame(both, roles, lags, rolls, layout).where(POSTED).drop(POSTED)


def remember(spark: SparkSession, path: str, posted: DataFrame, version: int | None = None) -> int:
    """Put a posted batch into the tails of the approved run; returns their version.

    ``version``: the batch's number from 1 (default: the next one). A batch remembered again under
    its number starts from the tail before it, so a repeated batch changes nothing.
    """
    run = state.current_run(spark, path)
    folder = state.run_folder(run, path)
    pre = state.load_preprocessor(spark, f"{folder}/preprocessor")
    roles, (lags, rolls) = pre.state.roles, state.lags_and_rolls(run)
    tail, newest = state.load_tail(spark, folder, version)
    version = newest + 1 if version is None else version
    rows = max(1, reach(lags, rolls))
    state.save_tail(next_tail(tail, pre.parsed(posted, roles), roles, rows), folder, version)
    state.drop_tails(spark, folder, newest)
    return version


def extend_reference(
    spark: SparkSession, path: str, current: DataFrame, part: int | None = None
) -> int:
    """Add an aligned frame to the sketches of the approved run's reference; returns its part.

    Only the frame is read. ``part``: its number from 1 (default: the next); a part that is written
    again replaces itself.
    """
    folder = state.run_folder(state.current_run(spark, path), path)
    known, newest = state.load_sketches(spark, folder)
    if known is None:
        raise ValueError("the run was stored without sketches")
    part = newest + 1 if part is None else part
    columns = [r["column"] for r in known.select("column").distinct().orderBy("column").collect()]
    state.save_sketches(column_sketches(current, [c for c in columns if c in current.columns]), folder, part)
    return part


def health(
    spark: SparkSession, path: str, current: DataFrame | None = None, watch: str | None = None,
    extended: bool = False,
) -> DataFrame:
    """One-row health report; ``current`` is an aligned frame or None.

    ``watch``: the column of the prediction drift; the target if not given. ``extended``: compare
    with the sketched reference (the training and all batches added to it since) and not with the
    exact one of the training.
    """
    run = state.latest_run(state.read_runs(spark, f"{path}/runs"))
    row = run.first()
    saved = state.last_saved(spark, row["model_path"])
    reference = _extended(spark, path, row) if extended else _reference(spark, path, row)
    if current is None or reference is None:
        return health_report(run, last_retrain=saved)
    target = watch or row["schema"]["target_column"]
    try:
        verdicts = settled(drift_columns(reference, current))
        data = dataset_verdict(verdicts)
        on_target = target in reference.columns and target in current.columns
        own = verdicts.where(F.col("column") == target)
        prediction = dataset_verdict(own) if on_target else None
    except Exception as problem:  # the report names it instead of failing
        return health_report(run, last_retrain=saved, error=str(problem))
    return health_report(run, data, prediction, saved)


def _reference(spark: SparkSession, path: str, run: Row | None) -> DriftReference | None:
    return run and state.load_reference(spark, f"{state.run_folder(run, path)}/reference")


def _extended(spark: SparkSession, path: str, run: Row | None) -> DriftReference | None:
    parts = state.load_sketches(spark, state.run_folder(run, path))[0] if run else None
    return None if parts is None else sketched_reference(settled(merge_sketches(parts)))


def decide(spark: SparkSession, path: str, current: DataFrame | None = None) -> DataFrame:
    """One-row decision against the stored reference."""
    reference = _reference(spark, path, state.current_run(spark, path))
    if reference is None or current is None:
        return retrain_decision(None, spark)
    return retrain_decision(check_drift(reference, current))


def retrain_if_needed(
    spark: SparkSession,
    raw: DataFrame,
    path: str,
    config: TrainConfig,
    version: str = "v1",
) -> Trained | None:
    """Validate, check for drift, and train and save only if it is called for.

    The new run is logged in any case, and approved (served from then on) only if it beats the
    approved run by the selection metric on the same test windows, or if there is none.
    """
    require_rows(raw.count(), MIN_ROWS)
    seen = state.last_version(spark, f"{path}/runs")
    champion = load_champion(spark, path)
    reference = None if champion is None else _reference(spark, path, champion.run)
    # The posted rows are a whole history here, so nothing is taken from the tails.
    current = None if reference is None else align(spark, path, raw, tails=False)
    if decide(spark, path, current).first()["branch"] == "skip_retrain":
        return None
    trained = train(raw, config, champion)
    approved = champion is None or promoted(trained)
    save(trained, spark, path, version, approved, seen)
    return trained


def promoted(trained: Trained) -> bool:
    """Does the new model beat the approved one, both scored on the new model's test windows?

    A champion that has no window in common with the challenger cannot be asked, and loses.
    """
    metric, metrics = trained.config.selection_metric, trained.duel
    if metrics is None:
        return False
    order = F.when(F.col("model_name") == "champion", F.lit("2000-01-01")).otherwise("2000-01-02")
    runs = metrics.withColumns({
        "approved": F.col("model_name") == "champion", "run_time": order.cast("timestamp")})
    return bool(evaluate.promote_champion(runs, metric).first()["promoted"])

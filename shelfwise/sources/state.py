"""What a trained model leaves behind: state tables, models, run log, reference."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from shelfwise.functions.columns import name, numeric_columns
from shelfwise.operators.drift import DriftReference
from shelfwise.operators.features import LAGS, ROLLS, densify
from shelfwise.operators.boosting import Ensemble
from shelfwise.operators.linear import Lines
from shelfwise.operators.models import (
    AnyModel,
    BaselineModel,
    BoostedModel,
    DirectModel,
    LinearModel,
    sequence_input,
    tabular_input,
)
from shelfwise.operators.ordering import series_order
from shelfwise.operators.prep import ColumnScale, Preprocessor, PrepState, parse_dates
from shelfwise.operators.roles import Roles
from shelfwise.sources import files

# Fixed value: rows of the saved reference sample.
SAMPLE_ROWS = 500
TIME_FORMAT = "yyyy-MM-dd HH:mm 'UTC'"

RUN_SCHEMA = (
    "run_time timestamp, best_model string, model_version string, horizon int, lookback int, "
    "metrics map<string,struct<mae:double,rmse:double,rmspe:double>>, "
    "schema struct<date_column:string,target_column:string,group_column:string,frequency:string>, "
    "profile_warnings array<string>, feature_columns array<string>, model_path string, "
    "lags array<int>, rolls array<int>, densify_days int, folder string, approved boolean, "
    "log_version bigint"
)
INPUTS = {"tabular": tabular_input, "sequence": sequence_input}


def save_preprocessor(pre: Preprocessor, spark: SparkSession, path: str) -> None:
    """Scales and codes as Parquet, roles and settings as one JSON line."""
    state = pre.state
    state.scales_frame(spark).write.mode("overwrite").parquet(f"{path}/scales")
    if state.codes is not None:
        state.codes.write.mode("overwrite").parquet(f"{path}/codes")
    meta = {
        "roles": state.roles.to_dict(),
        "n_codes": state.n_codes,
        "formats": list(pre.formats),
        "as_date": pre.as_date,
        "impute_from": pre.impute_from,
    }
    line = spark.createDataFrame([(json.dumps(meta),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{path}/roles")


def load_preprocessor(spark: SparkSession, path: str) -> Preprocessor:
    meta = json.loads(spark.read.text(f"{path}/roles").first()[0])
    rows = spark.read.parquet(f"{path}/scales").collect()  # one row per column
    found = {r["column"]: ColumnScale(r["median"], r["mean"], r["std"]) for r in rows}
    roles = Roles.from_dict(meta["roles"])
    codes = spark.read.parquet(f"{path}/codes") if meta["n_codes"] else None
    pre = Preprocessor(meta["formats"], meta["as_date"], meta["impute_from"])
    pre.state = PrepState(
        roles, {c: found[c] for c in roles.numeric if c in found}, codes, meta["n_codes"]
    )
    return pre


def save_model(model: AnyModel, spark: SparkSession, path: str) -> None:
    """One MLlib pipeline per step, so that any MLlib regressor can be read back.

    Inputs are stored by name or as their SQL expression; a function of the user's cannot be.
    A baseline is stored by name, boosted trees as one table of their nodes, lines as one of steps.
    """
    if isinstance(model, BaselineModel):
        _write_meta(spark, path, {"baseline": model.name, "date": model.date, "horizon": model.horizon})
        return
    if isinstance(model, BoostedModel):
        model.ensemble.to_frame(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        _write_meta(spark, path, {"boosted": model.name, "inputs": model.inputs})
        return
    if isinstance(model, LinearModel):
        model.lines.to_frame(spark).write.mode("overwrite").parquet(f"{path}/lines")
        meta = {"linear": model.name, "inputs": model.inputs, "needs_sequence": model.needs_sequence}
        _write_meta(spark, path, meta)
        return
    named = next((k for k, f in INPUTS.items() if f is model.inputs), None)
    expression = model.inputs if isinstance(model.inputs, str) else None
    if named is None and expression is None:
        raise ValueError(f"inputs of {model.name} cannot be stored: give them as a SQL expression")
    for h, step in enumerate(model.steps):
        PipelineModel([step]).write().overwrite().save(f"{path}/step={h}")
    meta = {
        "name": model.name,
        "horizon": model.horizon,
        "needs_sequence": model.needs_sequence,
        "inputs": named,
        "expression": expression,
    }
    _write_meta(spark, path, meta)


def _write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    line = spark.createDataFrame([(json.dumps(meta),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> AnyModel:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if "baseline" in meta:
        return BaselineModel(meta["baseline"], meta["date"], meta["horizon"])
    if "boosted" in meta:
        nodes = Ensemble.from_frame(spark.read.parquet(f"{path}/nodes"))
        return BoostedModel(meta["boosted"], nodes, meta["inputs"])
    if "linear" in meta:
        lines = Lines.from_frame(spark.read.parquet(f"{path}/lines"))
        return LinearModel(meta["linear"], lines, meta["inputs"], meta["needs_sequence"])
    steps = [PipelineModel.load(f"{path}/step={h}").stages[0] for h in range(meta["horizon"])]
    usual = "sequence" if meta["needs_sequence"] else "tabular"  # stored without their name
    inputs = meta.get("expression") or INPUTS[meta.get("inputs") or usual]
    return DirectModel(meta["name"], steps, inputs, meta["needs_sequence"])


def reference_sample(
    frame: DataFrame, roles: Roles, rows: int = SAMPLE_ROWS, keep: Sequence[str] = ()
) -> DataFrame:
    """The last rows of a feature frame in (series, date) order: target and numbers once.

    A top-n: every task sends at most ``rows`` rows.
    """
    skip = (roles.date, roles.target, roles.series, *roles.tiebreak)
    columns = [roles.target, *numeric_columns(frame, skip)]
    keys = [name(roles.series).desc()] if roles.series else []
    last = frame.orderBy(*keys, *series_order(roles, descending=True)).limit(rows)
    return last.select(*[name(c) for c in (*keep, *columns)])


def load_sample(spark: SparkSession, path: str) -> DataFrame:
    """The stored reference sample, as rows."""
    return spark.read.parquet(f"{path}/reference_sample")


def save_reference(reference: DriftReference, spark: SparkSession, path: str) -> None:
    reference.to_frame(spark).write.mode("overwrite").parquet(path)


def load_reference(spark: SparkSession, path: str) -> DriftReference | None:
    """The stored reference, or None before the first training."""
    try:
        return DriftReference.from_frame(spark.read.parquet(path))
    except AnalysisException:
        return None


def save_sketches(sketches: DataFrame, folder: str, part: int) -> None:
    """The sketches of one part (0: the training) of a run's reference."""
    sketches.coalesce(1).write.mode("overwrite").parquet(f"{folder}/sketches/{part:010d}")


def load_sketches(spark: SparkSession, folder: str) -> tuple[DataFrame | None, int]:
    """The sketches of all complete parts, one row per part and column, and the newest part."""
    path = f"{folder}/sketches"
    parts = [n for n in files.names(spark, path) if files.exists(spark, f"{path}/{n}/_SUCCESS")]
    if not parts:
        return None, -1
    return spark.read.parquet(*[f"{path}/{n}" for n in parts]), int(parts[-1])


def save_tail(tail: DataFrame, folder: str, version: int) -> None:
    """The newest rows of every series after ``version`` posted batches."""
    tail.write.mode("overwrite").parquet(f"{folder}/tails/{version:010d}")


def load_tail(spark: SparkSession, folder: str, before: int | None = None) -> tuple[DataFrame | None, int]:
    """The newest complete tail (of a version below ``before``) and its version; None and -1 without one."""
    for name in reversed(files.names(spark, f"{folder}/tails")):
        path = f"{folder}/tails/{name}"
        if (before is None or int(name) < before) and files.exists(spark, f"{path}/_SUCCESS"):
            return spark.read.parquet(path), int(name)
    return None, -1


def drop_tails(spark: SparkSession, folder: str, before: int) -> None:
    """Delete the tails of versions below ``before`` but the one that the training left."""
    for name in files.names(spark, f"{folder}/tails"):
        if 0 < int(name) < before:
            files.delete(spark, f"{folder}/tails/{name}")


def run_file(version: int) -> str:
    return f"run-{version:010d}.json"


def last_version(spark: SparkSession, path: str) -> int:
    """The newest version in the run log; 0 before the first run."""
    known = [n for n in files.names(spark, path) if n.startswith("run-")]
    return int(known[-1][4:14]) if known else 0


def append_run(run: DataFrame, path: str, seen: int | None = None) -> int:
    """Add one run to the log as the next version, and return that version.

    Every version is a file of its own, which only one writer can create; later versions are newer,
    whatever the writers' clocks say. ``seen``: the version that the decision to approve rests on.
    If another run was approved since, this one is logged, but not as approved.
    """
    spark = run.sparkSession
    at = last_version(spark, path) if seen is None else seen
    row, version = run.drop("log_version"), at + 1
    while True:
        if seen is not None and last_version(spark, path) > at:
            rivals = read_runs(spark, path).where(F.col("log_version") > at)
            if rivals.where(F.coalesce("approved", F.lit(True))).limit(1).count():
                row = row.withColumn("approved", F.lit(False))
            version = max(version, last_version(spark, path) + 1)
        text = row.withColumn("log_version", F.lit(version).cast("bigint")).toJSON().first()
        if files.create_new(spark, f"{path}/{run_file(version)}", text + "\n"):
            return version
        files.wait_for(spark, f"{path}/{run_file(version)}")  # its writer may still be at it
        version += 1


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).json(path)


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run that was approved (one row); runs logged without a version are older."""
    approved = runs.where(F.coalesce("approved", F.lit(True)))
    version = F.col("log_version").desc_nulls_last() if "log_version" in runs.columns else F.lit(0)
    return approved.orderBy(version, F.col("run_time").desc()).limit(1)


def current_run(spark: SparkSession, path: str) -> Row | None:
    """The run to serve, or None before the first training."""
    try:
        return latest_run(read_runs(spark, f"{path}/runs")).first()
    except AnalysisException:
        return None


def run_folder(run: Row, path: str) -> str:
    """Where the run's state lies; runs logged without a folder lie in the path itself."""
    return run["folder"] or path


def engineered(prepared_from: DataFrame, pre: Preprocessor, run: Row | None) -> DataFrame:
    """Rows prepared as those of the run were: its calendar filled, then the preprocessor."""
    days = run["densify_days"] if run else None
    if days is not None:
        roles = pre.state.roles
        dated = parse_dates(prepared_from, roles.date, pre.formats, True)
        prepared_from = densify(dated, roles, days, fill=0.0)
    return pre.transform(prepared_from)


def lags_and_rolls(run: Row | None) -> tuple[Sequence[int], Sequence[int]]:
    """The run's lags and means; the defaults for runs logged without them."""
    lags, rolls = (run["lags"], run["rolls"]) if run else (None, None)
    return (LAGS if lags is None else lags), (ROLLS if rolls is None else rolls)


def model_info(runs: DataFrame) -> DataFrame:
    """Approved model, sizes, metrics and schema of the newest run (one row)."""
    return latest_run(runs).select(
        F.col("best_model").alias("approved_model"), "horizon", "lookback", "metrics", "schema"
    )


def last_saved(spark: SparkSession, path: str) -> str:
    """Newest modification time below a model path, in UTC; ``unknown`` without files."""
    try:
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .load(path)
            .select("modificationTime")
        )
        newest = files.agg(F.max("modificationTime").alias("t"))
        zone = F.current_timezone()
        text = F.date_format(F.convert_timezone(zone, F.lit("UTC"), F.col("t").cast("timestamp_ntz")),
                             TIME_FORMAT)
        found = newest.select(text).first()[0]
    except AnalysisException:
        found = None
    return found or "unknown"

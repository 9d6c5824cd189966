"""Operational monitoring: causal z-scores, a frozen model baseline, an idempotent alert log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, SENSORS
from ..errors import InsufficientBaselineError, MissingFitBoundaryError, NonFiniteBaselineError, NonFiniteEligibleInputError
from . import models

KEY = ["machine", "window_start", "source", "sensor"]


def expanding_zscore(frame: DataFrame, keys: list[str], columns: dict[str, str], k: float = 3.0, min_history: int = 30) -> DataFrame:
    """frame with alert, worst_sensor, z and prior_n: an eligible row more than k deviations from all eligible rows before it.

    columns: {sensor: column}.  The worst sensor has the largest |z|, of equal ones the first.
    One running window per key: linear in the rows.
    """
    before = Window.partitionBy(*keys).orderBy("window_start").rowsBetween(Window.unboundedPreceding, -1)
    out, parts = frame, []
    for i, (sensor, c) in enumerate(columns.items()):
        x = F.when(F.col("eligible") & (F.abs(F.col(c)) < float("inf")), F.col(c))
        out = out.withColumns({f"_n{i}": F.count(x).over(before), f"_m{i}": F.avg(x).over(before), f"_v{i}": F.stddev_pop(x).over(before)})
        z = F.when(x.isNotNull() & (F.col(f"_n{i}") >= min_history) & (F.col(f"_v{i}") > 0), (x - F.col(f"_m{i}")) / F.col(f"_v{i}"))
        parts.append(F.when(F.abs(z) > k, F.struct(F.abs(z).alias("a"), F.lit(-i).alias("o"), F.lit(sensor).alias("s"), z.alias("z"), F.col(f"_n{i}").alias("n"))))
    out = out.withColumn("_w", F.array_max(F.array_compact(F.array(*parts))))
    return out.withColumns({"alert": F.col("_w").isNotNull(), "worst_sensor": F.col("_w")["s"], "z": F.col("_w")["z"], "prior_n": F.col("_w")["n"]}).drop("_w", *[f"_{x}{i}" for x in "nmv" for i in range(len(columns))])


@dataclass(frozen=True)
class Baseline:
    """Scaler, forest and threshold of one machine's warm-up, and the last window it saw."""

    scaler: models.Scaler
    forest: models.Forest
    threshold: float
    fit_boundary: int | None


def fit_baseline(frame: DataFrame, columns: list[str], warm_up_windows: int = 180, cfg: dict = DEFAULT) -> Baseline:
    """A baseline from the first eligible windows of one machine; fewer than asked for are refused."""
    first = frame.where("eligible").orderBy("window_start").limit(warm_up_windows)
    seen = first.agg(F.count("*").alias("n"), F.max("window_start").alias("last")).first()
    if seen["n"] < warm_up_windows:
        raise InsufficientBaselineError(f"{seen['n']} eligible windows, {warm_up_windows} needed")
    first = first.drop("split") if "split" in first.columns else first
    bad = first.agg(*[F.count_if(~F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))).alias(c) for c in columns]).first()
    if lost := [c for c in columns if bad[c]]:
        raise NonFiniteBaselineError(f"the baseline has missing or infinite values in {lost}")
    scaler = models.fit_scaler(first, columns, cfg["iqr_epsilon"])
    f = cfg["forest"]
    forest = models.fit_isolation_forest(models.scaled(first, scaler), scaler.columns, ["window_start"], f["trees"], f["sample"], f["seed"])
    try:
        threshold = models.score_thresholds(models.anomaly_scores(first, forest, scaler=scaler), f["quantiles"])[-1]
    except NonFiniteEligibleInputError as e:
        raise NonFiniteBaselineError(str(e)) from e
    return Baseline(scaler, forest, threshold, seen["last"])


def score_frame(frame: DataFrame, baseline: Baseline) -> DataFrame:
    """frame with score, causal and alert: windows up to the fit's end are scored but never alerted."""
    if baseline.fit_boundary is None:
        raise MissingFitBoundaryError("the baseline has no boundary")
    x = models.score_alert(models.anomaly_scores(frame, baseline.forest, scaler=baseline.scaler), baseline.threshold)
    return x.withColumn("causal", F.col("window_start") > baseline.fit_boundary).withColumn("alert", F.col("alert") & F.col("causal"))


def alert_rows(scored: DataFrame, machine: str | Column, source: str, size: int = 10, k: float = 3.0) -> DataFrame:
    """Rows of the alert log from ``expanding_zscore`` (source rule) or ``score_frame`` (source model).

    machine: its name, or the column of a frame of several machines that has it.
    """
    a = scored.where("alert")
    sensor, score = (F.col("worst_sensor"), F.abs("z")) if source == "rule" else (F.lit(""), F.col("score"))
    detail = F.format_string(f"|z|=%.2f over {k:g} after %d windows", F.abs("z"), "prior_n") if source == "rule" else F.format_string("score %.4f", F.col("score"))
    return a.select((F.lit(machine) if isinstance(machine, str) else machine).alias("machine"), "window_start", (F.col("window_start") + size).alias("window_end"), F.lit(source).alias("source"), sensor.alias("sensor"), score.cast("double").alias("score"), detail.alias("detail"))


def new_alerts(alerts: DataFrame, log: DataFrame | None) -> DataFrame:
    """Alerts once per (machine, window, source, sensor) that the log doesn't hold: appending them twice adds nothing."""
    once = alerts.dropDuplicates(KEY)
    return once if log is None else once.join(log.select(*KEY), KEY, "left_anti")


LOG = "machine string, window_start bigint, window_end bigint, source string, sensor string, score double, detail string, generated_at timestamp, day bigint"


def alert_log(spark: SparkSession, path: str) -> DataFrame:
    """The alert log at ``path``; without one, no rows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(LOG).parquet(path) if there else spark.createDataFrame([], LOG)


def append_alerts(alerts: DataFrame, path: str) -> dict[str, int]:
    """Append to the Parquet log at ``path``, partitioned by the window's day; rows offered and rows written.

    Only days from the first to the last that is offered are read.
    """
    alerts = alerts.withColumn("day", F.floor(F.col("window_start") / 86400).cast("long"))
    offered = alerts.agg(F.count("*").alias("n"), F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    if not offered["n"]:
        return {"rows_offered": 0, "rows_written": 0}
    log = alert_log(alerts.sparkSession, path).where(F.col("day").between(offered["lo"], offered["hi"]))
    new = new_alerts(alerts, log).withColumn("generated_at", F.current_timestamp()).cache()
    counts = {"rows_offered": offered["n"], "rows_written": new.count()}
    new.write.mode("append").partitionBy("day").parquet(path)
    new.unpersist()
    return counts


def run_monitoring(frame: DataFrame, machine: str, cfg: dict = DEFAULT, sensors: tuple[str, ...] = SENSORS, warm_up_windows: int | None = None) -> tuple[DataFrame, str]:
    """(alert rows of rule and model, note): too short a history leaves the model out, with a note."""
    m = cfg["monitoring"]
    rule = expanding_zscore(frame.withColumn("_all", F.lit(0)), ["_all"], {s: f"{s}__mean_5m" for s in sensors}, m["k"], m["min_history"]).drop("_all")
    rows = alert_rows(rule, machine, "rule", cfg["window_s"], m["k"])
    columns = [c for c in frame.columns if "__" in c]
    try:
        baseline = fit_baseline(frame, columns, warm_up_windows or m["warm_up_windows"], cfg)
    except InsufficientBaselineError as e:
        return rows, str(e)
    return rows.unionByName(alert_rows(score_frame(frame, baseline), machine, "model", cfg["window_s"])), ""

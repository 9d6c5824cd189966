"""Read-only views of readings, alerts and states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SENSORS


def latest_readings(readings: DataFrame, machine: str, limit: int = 500) -> DataFrame:
    """A machine's newest rows, the oldest first."""
    return readings.where(F.col("machine") == machine).orderBy(F.col("ts_epoch").desc()).limit(limit).orderBy("ts_epoch")


def recent_alerts(log: DataFrame, machine: str | None = None, limit: int = 200) -> DataFrame:
    """The newest alerts; the rest of the key makes the order total."""
    rows = log if machine is None else log.where(F.col("machine") == machine)
    return rows.orderBy(F.col("window_start").desc(), "machine", "source", "sensor").limit(limit)


def alert_summary(log: DataFrame, machine: str, newest: int = 1000) -> DataFrame:
    """Alerts by source over a machine's newest."""
    return recent_alerts(log, machine, newest).groupBy("source").agg(F.count("*").alias("alerts"))


def latest_state(states: DataFrame) -> DataFrame:
    """The newest state row of each machine."""
    rest = [c for c in states.columns if c != "machine"]
    tie = [F.col(c) for c in ("ts", "seq") if c in states.columns]
    return states.groupBy("machine").agg(F.max_by(F.struct(*rest), F.struct(*tie)).alias("_s")).select("machine", *[F.col("_s")[c].alias(c) for c in rest])


def sensor_long(readings: DataFrame, keys: tuple[str, ...] = ("machine", "ts_epoch"), sensors: tuple[str, ...] = SENSORS) -> DataFrame:
    """One row per sensor, for charts."""
    return readings.unpivot(list(keys), list(sensors), "sensor", "value")


def machines(spark, cfg: dict) -> DataFrame:
    """The declared machines."""
    return spark.createDataFrame([(a, x["code"], x["tag"]) for a, x in cfg["assets"].items()], "asset string, code int, tag string")

"""A demonstration of the operational chain: readings as messages, ingest, features, monitoring, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, SENSORS
from ..operators import features, ingest, monitoring, views
from ..sources import generator, messages


def seed(spark: SparkSession, path: str, hours: int = 3, asset: str = "FILLER", cfg: dict = DEFAULT) -> dict:
    """The last hours of an asset's development validation split: log, readings and alerts below ``path``, and their counts."""
    tag = cfg["assets"][asset]["tag"]
    span = next(s for s in generator.splits("dev", cfg) if s["split"] == "validation")
    end = span["end"] - 8 * 3600  # before the evening's shutdown
    start = end - hours * 3600
    raw = generator.generate(spark, "dev", cfg)["readings"].where((F.col("split") == "validation") & (F.col("asset") == asset) & F.col("ts_epoch").between(start, end - 1))
    sent = messages.to_messages(raw.withColumn("tag", F.lit(tag))).select((F.col("ts_epoch") - start).alias("arrival_seq"), "raw")
    ingest.classify(sent, [tag], cfg).write.mode("overwrite").parquet(f"{path}/log")
    log = spark.read.parquet(f"{path}/log")
    facts = ingest.readings(log)
    grid = messages.dense_grid(facts, ["machine"], "ts_epoch", start, end)
    frame = features.features(grid.select(F.col("machine"), "ts_epoch", *SENSORS), ["machine"], "ts_epoch", start, end, SENSORS, cfg).drop("machine")
    frame.write.mode("overwrite").parquet(f"{path}/features")
    rows, note = monitoring.run_monitoring(spark.read.parquet(f"{path}/features"), tag, cfg, warm_up_windows=600 if hours * 360 > 600 + 180 else None)
    counts = monitoring.append_alerts(rows, f"{path}/alerts")
    return {"counts": {r["category"]: r["n"] for r in ingest.reconciliation(log).collect()}, "alerts": counts, "note": note}


def view(spark: SparkSession, path: str, machine: str) -> dict[str, DataFrame]:
    """What a dashboard shows of a seeded folder."""
    log, alerts = spark.read.parquet(f"{path}/log"), monitoring.alert_log(spark, f"{path}/alerts")
    newest = views.latest_readings(ingest.readings(log), machine)
    return {"readings": newest, "sensors": views.sensor_long(newest), "alerts": views.recent_alerts(alerts, machine), "by_source": views.alert_summary(alerts, machine), "ingest": ingest.summary(log)}

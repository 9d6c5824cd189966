"""Tables of the operational store, made where they don't exist."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..config import SENSORS

_VALUES = ", ".join(f"{s} DOUBLE" for s in SENSORS)

#: Name: columns, and how files are laid out.
TABLES = {
    "sensor_ingest_log": ("log_id BIGINT, received_at TIMESTAMP, category STRING, tag STRING, ts_raw STRING, ts_epoch BIGINT, raw_payload STRING, reason STRING, content_hash STRING, day DATE", "day"),
    "sensor_readings": (f"log_id BIGINT, ts_epoch BIGINT, {_VALUES}, machine STRING", "machine"),
    "monitoring_alert_log": ("alert_id BIGINT, generated_at TIMESTAMP, machine STRING, window_start BIGINT, window_end BIGINT, source STRING, sensor STRING, score DOUBLE, detail STRING, day BIGINT", "day"),
}


def init_schema(spark: SparkSession, path: str, database: str = "default") -> list[str]:
    """Make the tables of the store below ``path``; those that exist stay as they are.  Their names."""
    for name, (columns, part) in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet PARTITIONED BY ({part}) LOCATION '{path.rstrip('/')}/{name}'")
    return sorted(TABLES)

"""Sources and sinks of sensor messages and readings."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SENSORS
from ..errors import IngestSourceError
from ..functions.columns import finite, iso_utc


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """(arrival_seq, raw) of a JSON-lines file: every line is a message, blank ones too; only the empty piece after a last line feed is none.

    arrival_seq counts lines over the whole source, files of a folder in the order of their names.  Large files are read in
    splits: a line's number is its place in its split, after the lines of the splits before, of which a row each is gathered.
    A line that isn't UTF-8 is no message: it is kept, each of its bytes beyond ASCII as \\xNN, and as that is no JSON escape it is a bad payload.
    """
    status = _status(spark, path)
    if status is None:
        raise IngestSourceError("missing_source", path)
    if status == 0:
        raise IngestSourceError("zero_byte_source", path)
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per split
    base = splits.select(F.col("_file").alias("_f"), F.col("_start").alias("_s"), (before - F.col("_first")).alias("_base"))
    numbered = lines.join(base, (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s")))
    return numbered.select((F.col("_id") + F.col("_base")).alias("arrival_seq"), _text("value").alias("raw"))


def _text(column: str) -> Column:
    """A line as it is, or where its bytes are no UTF-8 with those beyond ASCII as \\xNN."""
    each = F.split(F.decode(F.col(column).cast("binary"), "ISO-8859-1"), "")
    escaped = F.transform(each, lambda c: F.when(F.ascii(c) < 128, c).otherwise(F.concat(F.lit("\\x"), F.lower(F.hex(F.ascii(c))))))
    return F.when(F.is_valid_utf8(column), F.col(column)).otherwise(F.array_join(escaped, ""))


def _status(spark: SparkSession, path: str) -> int | None:
    """Bytes of a file, 1 for a folder, None if there is none."""
    if os.path.exists(path):
        return os.path.getsize(path) if os.path.isfile(path) else 1
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    found = fs.getFileStatus(where)
    return found.getLen() if found.isFile() else 1


def dense_grid(readings: DataFrame, keys: list[str], time_col: str, start: int, end: int, step: int = 1) -> DataFrame:
    """readings on the declared grid [start, end): a row for each key and step, NULL where nothing came.

    The grid is exploded where its keys are, so only readings are shuffled.
    """
    grid = readings.select(*keys).distinct().withColumn(time_col, F.explode(F.sequence(F.lit(start).cast("long"), F.lit(end - 1).cast("long"), F.lit(step).cast("long"))))
    inside = readings.where((F.col(time_col) >= start) & (F.col(time_col) < end))
    return grid.join(inside, [*keys, time_col], "left")


def to_messages(readings: DataFrame, tag: str = "tag", time_col: str = "ts_epoch", sensors: tuple[str, ...] = SENSORS) -> DataFrame:
    """(tag, ts_epoch, raw): a JSON message for each second in which some sensor has a value; missing ones are null."""
    values = {s: finite(F.col(s)) for s in sensors}
    some = F.lit(False)
    for v in values.values():
        some |= v.isNotNull()
    body = F.struct(iso_utc(F.col(time_col)).alias("ts"), F.col(tag).alias("tag"), F.lit("SENSOR").alias("type"), *[v.alias(s) for s, v in values.items()])
    return readings.where(some).select(F.col(tag).alias("tag"), time_col, F.to_json(body, {"ignoreNullFields": "false"}).alias("raw"))


def write_dataset(readings: DataFrame, labels: dict[str, DataFrame], path: str) -> None:
    """Readings partitioned by split and asset as Parquet, label tables as JSON."""
    readings.write.partitionBy("split", "asset").parquet(f"{path}/readings")
    for name, table in labels.items():
        table.write.json(f"{path}/{name}")

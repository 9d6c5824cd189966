"""A table played through a streaming operator, to compare it with batch."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .ingest import STORE, write_log


def replayed(rows: DataFrame, operator: Callable[[DataFrame], DataFrame], files: int = 2) -> DataFrame:
    """The operator's output over a stream of the rows, in files by order of arrival, one micro-batch each.

    Files go to the folder in spark.checkpoint.dir, or where there is none, of a local session, to a temporary one.
    """
    spark = rows.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.gettempdir()
    top = f"{top.rstrip('/')}/replay-{uuid.uuid4().hex}"
    rows.repartitionByRange(files, "arrival_seq").withColumn("_part", F.spark_partition_id()).write.partitionBy("_part").parquet(f"{top}/parts")
    parts = spark.read.schema(StructType([*rows.schema, StructField("_part", IntegerType())])).parquet(f"{top}/parts")
    for i in range(files):  # one after the other: a stream takes the oldest file first
        parts.where(F.col("_part") == i).drop("_part").coalesce(1).sortWithinPartitions("arrival_seq").write.mode("append").parquet(f"{top}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, STORE)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
        query = write_log(operator(stream), f"{top}/out", f"{top}/checkpoint")
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(f"{top}/out")

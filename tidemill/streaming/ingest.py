"""Stateful ingest of a message stream: the same categories as in batch.

Late messages are labelled, never dropped, and each machine has a mark of its own, so
no global watermark is used.  State per machine: the newest accepted second, and the content hash of every second
seen (RocksDB).  A restarted query takes its state from the checkpoint; a new one can begin with the state that a log of
earlier messages implies.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..config import DEFAULT, SENSORS
from ..operators.ingest import declared, parse

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ingester(StatefulProcessor):
    """Categories of one lane's messages in order of arrival."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", StructType([StructField("ts", LongType())]))
        self.seen = handle.getMapState("seen", StructType([StructField("ts", LongType())]), StructType([StructField("hash", StringType())]))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """The seconds that a log has of this machine, and the newest it accepted."""
        got = self.mark.get()
        marks = [] if got is None else [got[0]]
        for r in initialState.itertuples(index=False):
            self.seen.updateValue((int(r.ts_epoch),), (r.content_hash,))
            if r.accepted:
                marks.append(int(r.ts_epoch))
        if marks:
            self.mark.update((max(marks),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = self.mark.get()
        mark = got[0] if got is not None else None
        parts = list(rows)
        pdf = pd.concat(parts, ignore_index=True).sort_values("arrival_seq", kind="stable") if parts else pd.DataFrame()
        out = []
        for r in pdf.itertuples(index=False):
            if r.category:
                out.append(r.category)
                continue
            second = (int(r.ts_epoch),)
            if self.seen.containsKey(second):
                out.append("duplicate" if self.seen.getValue(second)[0] == r.content_hash else "reading_conflict")
                continue
            self.seen.updateValue(second, (r.content_hash,))
            if mark is None or second[0] > mark:
                mark = second[0]
                out.append("accepted")
            else:
                out.append("out_of_order_rejected")
        if mark is not None:
            self.mark.update((mark,))
        yield pdf.drop(columns="lane").assign(category=out)

    def close(self) -> None:
        pass


def state_of(log: DataFrame) -> DataFrame:
    """(lane, ts_epoch, content_hash, accepted): what a log of classified messages says of each second, that is the first message of each."""
    first = log.where("category in ('accepted', 'out_of_order_rejected')")
    return first.select(F.col("tag").alias("lane"), "ts_epoch", "content_hash", (F.col("category") == "accepted").alias("accepted"))


def classify_stream(messages: DataFrame, tags: list[str] | Column, cfg: dict = DEFAULT, log: DataFrame | None = None) -> DataFrame:
    """A stream (arrival_seq, raw) with its categories; the session must use the RocksDB state store (``STORE``).

    log: classified messages that came before the stream; a query without a checkpoint of its own begins where they ended.
    """
    x = parse(messages.select("arrival_seq", "raw"), cfg)
    category = F.when(F.col("reason").isNotNull(), "bad_payload").when(~declared(tags), "unknown_tag")
    x = x.withColumn("category", category)
    x = x.withColumn("lane", F.when(F.col("category").isNull(), F.col("tag")).otherwise(F.concat(F.lit("\0"), F.pmod(F.xxhash64("arrival_seq"), F.lit(64)).cast("string"))))
    columns = ["arrival_seq", "raw", "tag", "ts_epoch", *SENSORS, "content_hash", "category"]
    schema = "arrival_seq bigint, raw string, tag string, ts_epoch bigint, " + ", ".join(f"{s} double" for s in SENSORS) + ", content_hash string, category string"
    before = None if log is None else state_of(log).groupBy("lane")
    return x.select("lane", *columns).groupBy("lane").transformWithStateInPandas(Ingester(), schema, "Append", "None", initialState=before)


def write_log(classified: DataFrame, path: str, checkpoint: str):
    """Start writing the log; a micro-batch is a commit, and the readings are the log's accepted rows."""
    return classified.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

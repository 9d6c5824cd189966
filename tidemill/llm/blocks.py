"""Texts in blocks, and tables of 64-bit keys that are looked up for each block without passing through the driver.

A block is some ``BLOCK`` bytes of text, stored as one compressed row of a table that is bucketed by block, so that it is never shuffled.
What a block asks for is a sorted array of its distinct keys.  A table (key, value) of any size is dealt to ranges of keys; each
block sends every range its part of the keys, the range answers with values in the
same order, and the answers are shuffled to the block.  So distinct keys are shuffled, not texts and not uses of
keys, a task holds one range or one block at a time, and nothing is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, released, shared_folder, slices, table_name

#: Bytes of text a block; a longer text is a block of its own.  Bytes of text a bucket of blocks.
BLOCK, BUCKET = 16 << 20, 64 << 20
#: Entries of a table in a range of keys, and fewest ranges.
RANGE, RANGES = 1 << 20, 16


def body_of(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def batches_of(body: bytes) -> pa.RecordBatchReader:
    return pa.ipc.open_stream(body)


def stored(df: DataFrame, text_col: str, size: int = BLOCK, make: Callable[[list[pa.RecordBatch]], bytes] = body_of, total: int | None = None) -> Blocks:
    """(block, body): the rows of df in blocks, as a table bucketed by block; make gets a block's rows in batches of some 0.5 MB of text each.

    total: bytes of text, where they are known.
    """
    spark = df.sparkSession

    def run(batches):
        from pyspark import TaskContext

        first, n, have, length = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            for piece in slices(batch, text_col, 1 << 19):
                if have and length + piece.nbytes > size:
                    yield pa.RecordBatch.from_arrays([pa.array([first + n]), pa.array([make(have)], pa.binary())], ["block", "body"])
                    n, have, length = n + 1, [], 0
                have.append(piece)
                length += piece.nbytes
        if have:
            yield pa.RecordBatch.from_arrays([pa.array([first + n]), pa.array([make(have)], pa.binary())], ["block", "body"])

    if total is None:
        total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    path = shared_folder(spark)
    with held(spark):
        rows = df.mapInArrow(released(run), "block bigint, body binary")
        rows.write.bucketBy(buckets, "block").option("path", path).option("compression", "none").saveAsTable(table_name(path))
    return Blocks(spark.table(table_name(path)), buckets)


class Blocks(NamedTuple):
    """A table (block, body) and the number of its buckets."""

    table: DataFrame
    buckets: int


def _planes(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, their bytes by rank, so that compression finds the zeros."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64)[:, 0], dtype=np.uint64)


def answered(of: Blocks, keys_of: Callable[[bytes], np.ndarray], model: DataFrame, use: Callable[[bytes, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """use(body, keys, values) of each block: keys_of(body) are its sorted distinct keys, values those of model (key bigint, value float), 0 without an entry."""
    table, buckets = of
    ranges = max(RANGES, -(-model.count() // RANGE))
    bounds = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)

    def ask(batches):
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys = keys_of(body.as_py())
                cut = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
                some = [r for r in range(ranges) if cut[r + 1] > cut[r]]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array([_planes(keys[cut[r] : cut[r + 1]]) for r in some], pa.binary())], ["range", "block", "data"])

    def deal(batches):
        for batch in batches:
            keys, values = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            order = np.argsort(keys)
            keys, values = keys[order], values[order]
            cut = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
            some = [r for r in range(ranges) if cut[r + 1] > cut[r]]
            data = [_planes(keys[cut[r] : cut[r + 1]]) + values[cut[r] : cut[r + 1]].astype(np.float32).tobytes() for r in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([-1] * len(some), pa.int64()), pa.array(data, pa.binary())], ["range", "block", "data"])

    def answer(batches):
        now, held, keys, values = None, [], np.zeros(0, np.uint64), np.zeros(0, np.float32)
        for batch in batches:
            for r, block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = data.as_py()
                if r != now:
                    now, held, keys, values = r, [], keys[:0], values[:0]
                if block < 0:  # the table's part stands first
                    n = len(data) // 12
                    held.append((_keys(data[: 8 * n]), np.frombuffer(data, np.float32, n, 8 * n)))
                    continue
                if held:
                    keys, values = (np.concatenate(x) for x in zip(*held, strict=True))
                    order = np.argsort(keys)
                    keys, values, held = keys[order], values[order], []
                asked = _keys(data)
                found = np.zeros(len(asked), np.float32)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                    found = np.where(keys[at] == asked, values[at], np.float32(0))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([r], pa.int32()), pa.array([found.tobytes()], pa.binary())], ["block", "range", "data"])

    def meet(batches):
        for batch in batches:
            for block, data, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                body = data.as_py()
                keys = keys_of(body)
                values = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(x["data"], np.float32) for x in sorted(found or [], key=lambda x: x["range"]))])
                if len(values) != len(keys):
                    raise RuntimeError(f"block {block} asked for {len(keys)} keys and got {len(values)}")
                yield from use(body, keys, values)

    asked = table.mapInArrow(released(ask), "range int, block bigint, data binary").unionByName(model.select("key", "value").mapInArrow(released(deal), "range int, block bigint, data binary"))
    answers = asked.repartition("range").sortWithinPartitions("range", "block").mapInArrow(released(answer), "block bigint, range int, data binary")
    # as many partitions as the table has buckets, so that only the answers move; a block has no more of them than there are ranges
    answers = answers.repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("range", "data")).alias("answers"))
    return table.hint("merge").join(answers, "block", "left").select("block", "body", "answers").mapInArrow(released(meet), schema)


class Values:
    """Values of keys, found by the first bits of a key; keys that share these with another are searched for."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = max(8, min(23, (4 * len(keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.slot_key, self.slot_value = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float32)
        slot = (keys >> self.shift).astype(np.int64)
        self.slot_key[slot], self.slot_value[slot] = keys, values

    def of(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys >> self.shift).astype(np.int64)
        out = self.slot_value[slot]
        miss = np.flatnonzero(self.slot_key[slot] != keys)
        if len(miss):
            out[miss] = self.values[np.searchsorted(self.keys, keys[miss])]
        return out

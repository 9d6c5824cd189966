"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space between words, as ``bytes.split()`` takes it.
SPACE = b" \t\n\v\f\r"

#: Bytes of a batch that Python gets while a table is written.
BATCH = 8 << 20
_made: list = []
_memo: dict = {}


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def fold(column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id falls in fold 0."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % n, F.lit(0))


def words(text: str | None) -> list[bytes]:
    """The runs of ``[^\\x20\\x09-\\x0D]`` as UTF-8."""
    return text.encode().split() if text else []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where a local session has no such setting is a folder of the machine used.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        top = tempfile.gettempdir() + "/tidemill"
    path = f"{top.rstrip('/')}/tidemill-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def table_name(path: str) -> str:
    """The name of a table that is stored in a shared folder."""
    return path.rsplit("/", 1)[1].replace("-", "_")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        spark.sql(f"drop table if exists {table_name(path)}")
    except Exception:  # noqa: BLE001  the session is gone; the folder's owner cleans it
        pass


def _clean() -> None:
    for spark, path in _made:
        _remove(spark, path)


@contextmanager
def held(spark: SparkSession, rows: int | None = None):
    """Settings while a table is written: bytes, and rows where they are large, of a batch that Python gets."""
    conf = spark.conf
    new = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH)} | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)} if rows else {})
    before = {k: conf.get(k, None) for k in new}
    try:
        for k, v in new.items():
            conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and lost executors take nothing with them.

    rows: of a batch that Python gets while it is written, where rows are large.
    """
    path = shared_folder(df.sparkSession)
    with held(df.sparkSession, rows):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def settled(make: Callable[[], DataFrame], rows: int | None = None) -> DataFrame:
    """make() as a written table; what it wrote on the way is removed.

    Shuffles behind written tables are garbage too; Spark's cleaner deletes them once the driver has collected the plans.
    """
    before = mark()
    out = written(make(), rows)
    sweep(before, out)
    return out


def mark() -> int:
    """A time, for ``sweep``."""
    return len(_made)


def sweep(since: int, *keep: DataFrame) -> None:
    """Remove the tables written since then but those of ``keep``, and what shuffles are garbage."""
    kept = {t._written_at for t in keep}
    for spark, path in _made[since:]:
        if path not in kept:
            _remove(spark, path)
    _made[since:] = [x for x in _made[since:] if x[1] in kept]
    gc.collect()
    for t in keep[:1]:
        t.sparkSession.sparkContext._jvm.System.gc()


def shrink(spark: SparkSession) -> None:
    """Ask the executors' JVMs to give back heap that has grown on large rows, as processes of several stages share their memory with Python's.

    A short job of two tasks a core, so that each executor is likely to be met; nothing depends on it.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


#: Most rows of a table that is broadcast.
BROADCAST = 1_000_000


def few(table: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """A written table of narrow rows to be joined with: few rows are broadcast, more are met in a shuffle."""
    return table.hint("broadcast" if table.count() <= broadcast else "shuffle_hash")


def slices(batch: pa.RecordBatch, column: str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``size`` bytes, so that working arrays stay small; a long text is a part of its own."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).cast(pa.int64()))
    if not len(lengths):
        return
    part = np.cumsum(lengths + 64) // size
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(lengths)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def fields(df: DataFrame, keep: tuple[str, ...], more: str) -> T.StructType:
    """Columns ``keep`` of df with their types, whatever their names, then those of the DDL ``more``."""
    return T.StructType([*[T.StructField(k, df.schema[k].dataType) for k in keep], *T.StructType.fromDDL(more)])


def named(column: str) -> Column:
    """A column by its bare name, dots and backquotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def mapped(df: DataFrame, each, schema: str | T.StructType, column: str = "text", size: int = 4 << 20) -> DataFrame:
    """each(slice of a batch of about ``size`` bytes of text) -> dict of columns, for all batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow, names = to_arrow_schema(schema), df.columns

    def run(batches):
        for batch in batches:
            for part in slices(batch.rename_columns(names), column, size):
                out = each(part)
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) and x.type == f.type else pa.array(x, f.type) if not isinstance(x, pa.Array) else x.cast(f.type) for f in arrow], schema=arrow)

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, schema)  # any names


def _release() -> None:
    """Give back what this process has freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run):
    """run(batches) for mapInArrow, after which the worker gives back the task's memory: it stays for other operators' tasks."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return whole


def only(name: str, make):
    """What a worker process remembers from task to task: one operator's memory at a time, so that another's doesn't stay beside it."""
    if name not in _memo:
        _memo.clear()
        _release()
        _memo[name] = make()
    return _memo[name]


class WordHashes(dict):
    """Word -> 64-bit hash, remembered for up to ``most`` words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    @classmethod
    def shared(cls) -> "WordHashes":
        """The one of this process, which keeps its words from task to task."""
        return only("words", cls)

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser over 64 bits (splitmix64), in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def windows_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i : i + n]
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF

"""Character n-gram models with modified Kneser-Ney smoothing, counted by Spark.

Counting: each block of texts (see ``blocks``) counts its n-grams (character windows; every text begins
with ``order - 1`` start marks) in arrays, so one row per n-gram and block is
shuffled, whatever the number of documents.  Lower orders use continuation
counts.  All tables are DataFrames of n-grams, not of documents; tables with a row per group are broadcast.

Scoring: every n-gram of a text that was counted has its interpolated probability in the
table of the highest order.  Each block asks for its distinct n-grams, wherever in the cluster they lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Blocks, batches_of
from .common import few, mapped, mix, only, released, written

ORDER = 5
_START = "\x02"
_A = 0xD1342543DE82EF95
_POWERS = np.array([pow(_A, i, 1 << 64) for i in range(16)], np.uint64)
_SLOT = np.uint64(0x9E3779B97F4A7C15)


def salt(name: str | None) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh3_64_intdigest("" if name is None else "=" + name))


def codes(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each after its start marks; where each text begins; its length."""
    mark = _START * (order - 1)
    c = np.frombuffer("".join([mark + t for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return c, np.cumsum(lengths + order - 1) - lengths, lengths


def window_keys(c: np.ndarray, order: int) -> np.ndarray:
    """A key of the ``order`` code points that end at each place from order - 1 on."""
    x = c.astype(np.uint64)
    x += np.uint64(1)
    n = len(x) - order + 1
    key = x[order - 1 :].copy()
    for i in range(1, order):
        key += x[order - 1 - i : order - 1 - i + n] * _POWERS[i]
    return key


def text_keys(texts: list[str], groups: list, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all windows of the texts, one after another, and the texts' lengths."""
    c, starts, lengths = codes(texts, order)
    if not lengths.sum():
        return np.zeros(0, np.uint64), lengths
    at = np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    key = window_keys(c, order)[at - order + 1]
    key += np.repeat(np.array([salt(g) for g in groups], np.uint64), lengths)
    return mix(key), lengths


def gram_keys(grams: list[str], salts: np.ndarray, order: int) -> np.ndarray:
    """Keys of n-grams of one length, as ``text_keys`` has them."""
    c = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, order)
    key = salts.copy()
    for i in range(order):
        key += (c[:, order - 1 - i].astype(np.uint64) + np.uint64(1)) * _POWERS[i]
    return mix(key)


def distinct(parts, bits: int = 20) -> np.ndarray:
    """Sorted distinct keys of many arrays; most repeats are told by a table of keys met last, the rest by sorting."""
    met = np.zeros(1 << bits, np.uint64)
    have, n = [np.zeros(0, np.uint64)], 0
    for part in parts:
        slot = (part >> np.uint64(64 - bits)).astype(np.int64)
        new = np.flatnonzero((met[slot] != part) | (part == 0))
        met[slot[new]] = part[new]
        have.append(np.unique(part[new]))
        n += len(have[-1])
        if n > 2_000_000:
            have, n = [np.unique(np.concatenate(have))], 0
    return np.unique(np.concatenate(have))


def texts_of(grams: np.ndarray) -> list[str]:
    n = grams.shape[1]
    s = np.ascontiguousarray(grams, np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return [s[i : i + n] for i in range(0, len(s), n)]


class Counter:
    """Counts windows in a table of slots; windows without a slot of their own are counted in sorted runs."""

    def __init__(self, order: int, bits: int = 20):
        self.order, self.shift = order, np.uint64(64 - bits)
        self.key, self.count = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)
        self.gram, self.group = np.zeros((1 << bits, order), np.uint32), np.zeros(1 << bits, np.int32)
        self.names: dict = {}
        self.more: list[tuple] = []

    def add(self, texts: list[str], groups: list) -> None:
        c, starts, lengths = codes(texts, self.order)
        if not lengths.sum():
            return
        ids = np.array([self.names.setdefault(g, len(self.names)) for g in groups], np.int32)
        salts = np.array([salt(g) for g in groups], np.uint64)
        inside = np.repeat(np.arange(len(texts)), lengths)
        at = np.arange(len(inside)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        key = window_keys(c, self.order)[at - self.order + 1] + salts[inside]
        slot = (key * _SLOT >> self.shift).astype(np.int64)
        hit = self.key[slot] == key
        self.count += np.bincount(slot[hit], minlength=len(self.key))
        miss = np.flatnonzero(~hit)
        if not len(miss):
            return
        new, first, n = np.unique(key[miss], return_index=True, return_counts=True)
        where = miss[first]
        gram = c[at[where][:, None] + np.arange(1 - self.order, 1)]
        slot, group = slot[where], ids[inside[where]]
        free = np.flatnonzero(self.key[slot] == 0)
        own = free[np.unique(slot[free], return_index=True)[1]]
        self.key[slot[own]], self.count[slot[own]], self.gram[slot[own]], self.group[slot[own]] = new[own], n[own], gram[own], group[own]
        rest = np.ones(len(new), bool)
        rest[own] = False
        if rest.any():
            self.more.append((new[rest], n[rest], gram[rest], group[rest]))
            if sum(len(x[0]) for x in self.more) > 300_000:
                self._join()

    def _join(self) -> None:
        key, n, gram, group = (np.concatenate(x) for x in zip(*self.more, strict=True))
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        self.more = [(key[first], np.bincount(back, n).astype(np.int64), gram[first], group[first])]

    def batches(self, names: dict | None = None):
        """What was counted, as (groups, grams, counts)."""
        if self.more:
            self._join()
        used = np.flatnonzero(self.key)
        label = list(self.names)
        for gram, group, n in [(self.gram[used], self.group[used], self.count[used]), *[(g, i, n) for _, n, g, i in self.more]]:
            for a in range(0, len(n), 100_000):
                yield [label[i] for i in group[a : a + 100_000]], texts_of(gram[a : a + 100_000]), n[a : a + 100_000]

    def full(self) -> bool:
        return bool(self.more) and len(self.more[0][0]) > 200_000


def count_grams(of: Blocks, order: int = ORDER) -> DataFrame:
    """(grp, gram, c) over blocks whose first two columns are a text and its group; a null group is a group, null texts count as empty."""

    def run(batches):
        def out(counter):
            for groups, grams, n in counter.batches():
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())], ["grp", "gram", "c"])

        only("grams", dict)
        counter = Counter(order)
        for batch in batches:
            for body in batch.column(1):
                for part in batches_of(body.as_py()):
                    counter.add([t or "" for t in part.column(0).to_pylist()], part.column(1).to_pylist())
                    if counter.full():
                        yield from out(counter)
                        counter = None
                        counter = Counter(order)
        yield from out(counter)

    return of.table.select("block", "body").mapInArrow(released(run), "grp string, gram string, c bigint").groupBy("grp", "gram").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> DataFrame:
    """(grp, d1, d2, d3): modified Kneser-Ney discounts of each group; without the counts of counts they need, 0.5, 1 and 1.5."""
    n = [F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in range(1, 5)]
    y = F.expr("n1 / (n1 + 2 * n2)")
    d = [F.greatest(F.lit(0.05), F.least(F.lit(float(i)), i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")))) for i in range(1, 4)]
    ok = F.expr("n1 > 0 and n2 > 0 and n3 > 0 and n4 > 0")
    return counts.groupBy("grp").agg(*n).select("grp", *[F.when(ok, x).otherwise(F.lit(i / 2)).alias(f"d{i}") for i, x in enumerate(d, 1)])


def _same(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """a joined with b on the keys and on the group, nulls equal; without keys b has a row per group."""
    if not keys:
        b = few(written(b))
    b = b.withColumnsRenamed({k: f"_{k}" for k in ("grp", *keys)})
    on = a["grp"].eqNullSafe(b["_grp"])
    for k in keys:
        on &= a[k] == b[f"_{k}"]
    return a.join(b, on, "left").drop("_grp", *[f"_{k}" for k in keys])


def weighted(counts: DataFrame, n: int) -> DataFrame:
    """(grp, gram, ctx, sfx, own, gamma) of n-grams: the discounted share of each, and the weight its context gives to lower orders."""
    x = _same(counts, discounts(counts)).withColumns({"ctx": F.expr(f"substring(gram, 1, {n - 1})"), "sfx": F.expr("substring(gram, 2)"), "d": F.expr("case c when 1 then d1 when 2 then d2 else d3 end")})
    # each context's followers are at most as many as characters exist
    context = Window.partitionBy("grp", "ctx")
    x = x.withColumns({"total": F.sum("c").over(context), "left": F.sum("d").over(context)})
    return x.select("grp", "gram", "ctx", "sfx", F.expr("(c - d) / total").alias("own"), F.expr("left / total").alias("gamma"))


def lower(counts: DataFrame) -> DataFrame:
    """Continuation counts of the n-grams one shorter."""
    return counts.groupBy("grp", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("c"))


def probabilities(counts: DataFrame, order: int) -> DataFrame:
    """(grp, gram, p): interpolated probabilities of the n-grams of the highest order."""
    by_order = {order: counts}
    for n in range(order - 1, 0, -1):
        by_order[n] = written(lower(by_order[n + 1]))
    p = None
    for n in range(1, order + 1):
        w = weighted(by_order[n], n)
        if p is None:
            w = _same(w, by_order[1].groupBy("grp").agg((F.count("*") + 1).alias("v"))).withColumn("low", 1 / F.col("v"))
        else:
            w = _same(w, p.select("grp", F.col("gram").alias("sfx"), F.col("p").alias("low")), "sfx")
        p = written(w.select("grp", "gram", (F.col("own") + F.col("gamma") * F.col("low")).alias("p")))
    return p


def model(p: DataFrame, order: int) -> DataFrame:
    """(key, value): log p of each n-gram of (grp, gram, p)."""

    def each(part):
        grp, gram = part.column(0).to_pylist(), part.column(1).to_pylist()
        salts = {g: salt(g) for g in set(grp)}
        return {"key": gram_keys(gram, np.array([salts[g] for g in grp], np.uint64), order).view(np.int64), "value": np.log(part.column(2).to_numpy()).astype(np.float32)}

    return mapped(p.select("grp", "gram", "p"), each, "key bigint, value float", "gram")

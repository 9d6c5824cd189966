"""N-gram Jaccard join by parity sketches.

Two documents link when their sets of word k-grams satisfy
``den * |A & B| >= num * |A or B|``.  Then ``|A xor B| <= (1 - t) / (1 + t) * (|A| + |B|)``,
t = num / den.

Sketches.  XOR-hashing tokens into bits (a bit is the parity of the tokens on it) gives
sketches whose Hamming distance never exceeds ``|A xor B|``.  Sizes are cut into
bands; a band fixes the most differences D of its pairs and cuts the sketch into
D + r + e parts, r being 2 in bands of small sets and 4 in others.  By the pigeonhole
principle a linked pair agrees in r + e parts at least.  A part's key is the XOR of random words of its
set bits, a 47-bit Zobrist hash of the bits.  Parts of few tokens say little and are shared widely, empty ones by a share of all sets,
which would give pairs by the square.  So each set leaves out the e parts of fewest tokens, of equal ones the first.  A part that agrees although its tokens differ
spends two differences at least, so r + e parts agree in their tokens too; both sets order these alike, and all but their e first stay with both: r common parts remain.

Equal sets are one node (80 bits) before sketches are sent, so copies are joined once.  Rows
(key, node) are sorted in partitions by key, and only keys with two nodes or more go on.
A candidate pair is first held against its whole sketches (of as many bits as the set has
members, or up to twice that): if they differ in more bits than the pair may differ in members, it can't link.

Verification is exact, on the sets of 64-bit hashes of k-grams, and seeks components, not
all pairs.  First, the first node of each bucket is compared with those that it leads in two buckets at least (in one, of small sets); groups of near copies
fall together there, whatever their size.  What is left are buckets of several components, and pairs that weren't compared are met there.
As a linked pair has r keys in common, each node may leave out some of its keys with the largest
buckets: of s left out by each, the r - s first of the common ones by size stay with both.  That empties the buckets of passages that many texts
share.  Nodes leave out two of four, so that a pair has two keys in common still, and one of two (small sets).  Of what is left, buckets with few pairs of
different components for their size (light ones) give these pairs, and a pair that has met once only in them is none, unless it needs no
second key or meets in another; in others (heavy ones) sketches are compared in arrays, and only pairs that pass are sent on.  Large buckets of both
kinds are cut, so that a task holds a bounded part of one.

Near copies by the thousand would still give pairs by the square.  So heavy buckets have a round before: a node is compared within its
largest bucket and sends its ``NEAREST`` pairs only.  Their links make one component of most of a group, and the round over all pairs leaves out those of one component.

Null texts and texts without words have empty sets that link with nothing.  Shorter texts
than k words are one k-gram.  Rows are told apart by their sets, so that repeated ids, also with different texts, join the classes of
all their texts each on its own; a null id is
part of its class but never its name (a class of null ids has no name).  Ties are none: links are symmetric.  A very
long text is one set, in memory some 60 bytes a word.  Columns besides
id and text are not looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, documents, few, mapped, mark, mix, only, released, settled, shrink, slices, sweep, windows_hash, written
from .components import components

#: Growth of the sizes of a band.
GROWTH = 1.5
#: Pairs of different components a node, above which a bucket's sketches are compared before pairs are sent.
CROSS = 16
#: Keys that a linked pair of larger sets has in common when each has left out its largest buckets.
COMMON = 2
#: Most nodes of a bucket whose sketches are compared in one task, and of the largest label whose ids are.
PART, CHUNK = 2048, 100_000
#: Nodes of a bucket above which its pairs are told from those of other such buckets.
BIG = 256
#: Pairs that a node sends in the round before all pairs of heavy buckets.
NEAREST = 8
#: Pairs that Python holds at once while it compares their sets.
PAIRS = 200
_BITS = 4096  # of a part
_WORDS = mix(np.arange(1, _BITS + 1, dtype=np.uint64))  # a random word for each bit of a part


def shingles(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct k-grams, A-Z in lower case."""
    ws = (text or "").encode().lower().split()
    return np.unique(windows_hash(hashes.of(ws), min(k, len(ws)))) if ws else np.zeros(0, np.uint64)


def node_of(s: np.ndarray) -> tuple[int, int]:
    """80 bits that name a set: 16 and 64."""
    low = (s * np.uint64(0x9E3779B97F4A7C15) ^ s >> np.uint64(29)).sum(dtype=np.uint64)
    other = int(np.bitwise_xor.reduce(s)) if len(s) else 0
    return (other ^ other >> 16 ^ other >> 32 ^ other >> 48 ^ len(s)) & 0xFFFF, int(low.astype(np.int64))


def sketch_of(s: np.ndarray) -> bytes:
    """The parity sketch of a set, of the least power of two of bits that isn't below its size (256 at least)."""
    bits = max(256, 1 << max(0, len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer folded to the shorter's length."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), 0)).sum())


class Bands:
    """Sizes cut into bands of at most D differences; none is needed while D is 0, as equal sets are one node."""

    def __init__(self, num: int, den: int, growth: float = GROWTH):
        self.num, self.den, self.growth = num, den, growth
        self.top, self.parts, self.spare = [], [], []

    def differences(self, both: int) -> int:
        return (self.den - self.num) * both // (self.den + self.num)

    @staticmethod
    def common(d: int) -> int:
        """Keys that a linked pair of a band of at most d differences has in common."""
        return 2 if d < 5 else 4

    def small(self) -> int:
        """The largest size whose pairs may lie in a band with two common keys."""
        size = 1
        while self.common(self.differences(2 * size)) == 2:
            size += 1
        self._reach(size)
        return self.top[int(np.searchsorted(self.top, size))]

    def _reach(self, size: int) -> None:
        while not self.top or self.top[-1] < size:
            last = self.top[-1] if self.top else 0
            top = max(last + 1, int(last * self.growth))
            if not self.top:
                while not self.differences(2 * (top + 1)):
                    top += 1
            d = self.differences(2 * top)
            spare = 0 if not d else 2 + d // 12
            self.top.append(top)
            self.parts.append(d + self.common(d) + spare)
            self.spare.append(spare)

    def of(self, size: int) -> range:
        """Bands in which a set of this size meets others: as the larger of a pair, and as the smaller."""
        largest = size * self.den // self.num
        self._reach(largest)
        at = np.searchsorted(self.top, [size, largest])
        return range(max(1, int(at[0])), int(at[1]) + 1)

    def keys(self, s: np.ndarray) -> np.ndarray:
        """47-bit keys of the parts of a set's sketches."""
        out, word_of = [], _WORDS[(s & np.uint64(_BITS - 1)).astype(np.int64)]
        for band in self.of(len(s)):
            p = self.parts[band]
            part = (s >> np.uint64(32)) * np.uint64(p) >> np.uint64(32)
            part = part.astype(np.uint16 if p < 1 << 16 else np.int64)
            order = np.argsort(part, kind="stable")
            part, word = part[order], word_of[order]
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            xor = np.bitwise_xor.reduceat(word, starts)
            n = np.zeros(p, np.int64)
            n[part[starts]] = np.diff([*starts, len(part)])
            keep = np.sort(np.argsort(n, kind="stable")[self.spare[band] :])
            key = np.zeros(p, np.uint64)
            key[part[starts]] = xor
            key = mix(key + (np.arange(p, dtype=np.uint64) + np.uint64((band + 1) << 40)) * np.uint64(0x9E3779B97F4A7C15))
            out.append(key[keep] >> np.uint64(17))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


ROWS = "a bigint, lo bigint, id bigint, n bigint, sketch binary, digest bigint"


def sketch_rows(df: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, hash_col: str | None = None) -> DataFrame:
    """Two kinds of rows from one reading.  a >= 0: key << 16 | hi, and lo, of each part of each set; sets that a task has met are not sent again.
    a < 0 (spread by place): a row's id, set size, node (hi in the last 16 bits of a), whole sketch and hash_col."""
    schema = pa.schema([("a", pa.int64()), ("lo", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("digest", pa.int64())])

    def run(batches):
        hashes, bands, met = WordHashes.shared(), Bands(num, den), set()
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                keys, nodes, sizes, every = [], [], [], []
                for i, (d, t, h) in enumerate(zip(*(c.to_pylist() for c in part.columns), strict=True)):
                    s = shingles(t, k, hashes)
                    node = node_of(s)
                    every.append((-1 << 63 | (hash((d, i)) & (1 << 46) - 1) << 16 | node[0], node[1], d, len(s), sketch_of(s) if len(s) else None, h))
                    if not len(s) or node in met:
                        continue
                    if len(met) < 1_000_000:
                        met.add(node)
                    key = bands.keys(s)
                    keys.append(key)
                    nodes.append(node)
                    sizes.append(len(key))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*every, strict=True), schema, strict=True)], schema=schema)
                if keys:
                    hi, lo = (np.repeat(np.array(x, np.int64), sizes) for x in zip(*nodes, strict=True))
                    a = np.concatenate(keys) << np.uint64(16) | hi.astype(np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(lo), *[pa.nulls(len(a), f.type) for f in list(schema)[2:]]], schema=schema)

    digest = F.col(hash_col) if hash_col else F.lit(None)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), digest.cast("long").alias("digest")).mapInArrow(released(run), ROWS)


def lean(run):
    """run(batches) for mapInArrow in a worker that forgets the words of texts first and gives back the task's memory."""

    def whole(batches):
        only("pairs", dict)
        yield from run(batches)

    return released(whole)


def buckets(rows: DataFrame) -> DataFrame:
    """(key, hi, lo, id, n, sketch, digest): the nodes of each key that two different nodes have, and with a null key the rows of all ids.

    Streams over sorted partitions, whatever a bucket's size.
    """
    schema = pa.schema([("key", pa.int64()), ("hi", pa.int32()), ("lo", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("digest", pa.int64())])

    def run(batches):
        def out(a, lo):
            return pa.RecordBatch.from_arrays([pa.array(a >> 16), pa.array((a & 0xFFFF).astype(np.int32)), pa.array(lo), *[pa.nulls(len(a), f.type) for f in list(schema)[3:]]], schema=schema)

        a0, lo0, sent = np.zeros(0, np.int64), np.zeros(0, np.int64), False  # the key that goes on: its last nodes, or only the last if it was sent
        for batch in batches:
            a, lo = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if len(a) and a[0] < 0:  # rows of ids stand first
                cut = int(np.searchsorted(a, 0))
                own = batch.slice(0, cut)
                yield pa.RecordBatch.from_arrays([pa.nulls(cut, pa.int64()), pa.array((a[:cut] & 0xFFFF).astype(np.int32)), *own.columns[1:]], schema=schema)
                a, lo = a[cut:], lo[cut:]
            a, lo = np.concatenate([a0, a]), np.concatenate([lo0, lo])
            if not len(a):
                continue
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (lo[1:] != lo[:-1])
            a, lo = a[new], lo[new]
            key = a >> 16
            run_of = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            many = np.bincount(run_of) > 1
            if sent:
                many[0] = True
            give = many[run_of]
            give[0] &= not sent
            if give.any():
                yield out(a[give], lo[give])
            last = run_of == run_of[-1]
            sent = bool(many[-1])
            a0, lo0 = (a[-1:], lo[-1:]) if sent else (a[last], lo[last])

    ordered = rows.repartition(F.shiftright("a", 16)).sortWithinPartitions("a", "lo")
    return ordered.mapInArrow(lean(run), "key bigint, hi int, lo bigint, id bigint, n bigint, sketch binary, digest bigint")


def stored_sets(df: DataFrame, nodes: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, s): the number of each of the given nodes (id, doc, hi, lo) and the sorted hashes of its k-grams as bytes.

    Texts are read by doc, the smallest id of a node, and told apart by their own node, as ids may repeat.
    """

    def each(part):
        sets = [shingles(t, k, WordHashes.shared()) for t in part.column(0).to_pylist()]
        named = [node_of(s) for s in sets]
        return {"hi": [x[0] for x in named], "lo": [x[1] for x in named], "s": [s.tobytes() for s in sets]}

    nodes = written(nodes)
    rows = df.select(_doc(F.col(id_col).cast("long")).alias("doc"), F.col(text_col).alias("text")).join(few(written(nodes.select("doc").distinct())), "doc", "left_semi")
    sets = mapped(rows.select("text"), each, "hi int, lo bigint, s binary").join(few(nodes), ["hi", "lo"]).select("id", "s")
    return written(sets).dropDuplicates(["id"])


def _doc(column) -> Column:
    """An id to join on: a null is a value too (rows are told apart by their nodes besides)."""
    return F.coalesce(column, F.lit(-1 << 63))


def near(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link."""
    side = lambda name, x: sketches.select(F.col("id").alias(name), F.col("n").alias(f"n{x}"), F.col("sketch").alias(x))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "nx", "ny", "x", "y")

    def run(batches):
        for batch in batches:
            n = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) * (den - num) // (den + num)
            keep = [i for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)) if hamming(x.as_py(), y.as_py()) <= n[i]]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.mapInArrow(lean(run), "a bigint, b bigint")


def verified(pairs: DataFrame, of: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    with_b = pairs.join(of.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    both = with_b.join(of.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if den * common >= num * (len(x) + len(y) - common):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.mapInArrow(lean(run), "a bigint, b bigint")


def led(rows: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of a bucket's first node and another (rows: key, id, n, lead (id, n)) whose sizes allow a link and that meet so in ``COMMON`` buckets, small sets in one."""
    small = Bands(num, den).small()
    both = rows.where((F.col("id") > F.col("lead.id")) & (den * F.least("n", "lead.n") >= num * F.greatest("n", "lead.n")))
    once = F.when(F.greatest("n", "lead.n") <= small, COMMON).otherwise(1)
    return both.groupBy(F.col("lead.id").alias("a"), F.col("id").alias("b")).agg(F.sum(once).alias("met")).where(F.col("met") >= COMMON).select("a", "b")


def within(rows: DataFrame, num: int, den: int, most: int = 0) -> DataFrame:
    """Pairs (a, b) of a bucket (rows: key, id, n, label, sketch, size) with different labels whose sketches allow a link.

    A bucket of more than ``PART`` nodes is cut into parts by hash of the node, and each two parts meet in a bucket of their
    own, so that no task holds more; sketches of one are compared in blocks of arrays.  Of buckets of more than ``BIG`` nodes a pair is given by the
    first that it has in common, and by no other of them; a node brings these buckets along, of which it has no more than parts.
    most: of pairs that a node sends to the nodes after it, those of least distance (0: all).
    """

    def pairs(ids, n, label, part, at, buckets, sketches):
        least = min(map(len, sketches))
        x = np.stack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, least // 8), 0) for s in sketches])
        block = max(1, (1 << 21) // x.size)
        one = (part == part[0]).all()
        for i in range(0, len(ids), block):
            far = np.bitwise_count(x[i : i + block, None] ^ x[None, i:]).sum(2, dtype=np.int64)
            ok = (far <= (n[i : i + block, None] + n[None, i:]) * (den - num) // (den + num)) & (label[i : i + block, None] != label[None, i:])
            if not one:
                ok &= part[i : i + block, None] != part[None, i:]
            ok = np.triu(ok, 1)
            if 0 < most < ok.shape[1]:
                far = np.where(ok, far, 1 << 40)
                ok &= far <= np.partition(far, most - 1, 1)[:, most - 1 : most]
                ok &= np.cumsum(ok, 1) <= most  # of equal distances the first
            a, b = (x + i for x in np.nonzero(ok))
            if buckets is not None:
                here = [at == min(buckets[p] & buckets[q]) for p, q in zip(a.tolist(), b.tolist(), strict=True)]
                a, b = a[here], b[here]
            yield np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), np.ones(len(a), np.int64)])

    def bucket(t: pa.Table):
        for at in np.unique(t.column(5).to_numpy()):  # one, but for buckets whose parts have one hash
            own = t.filter(pa.array(t.column(5).to_numpy() == at))
            if own.num_rows > 1:
                buckets = None if own.column(6).null_count else list(map(set, own.column(6).to_pylist()))
                yield from pairs(*(own.column(i).to_numpy() for i in range(1, 5)), int(at), buckets, own.column(7).to_pylist())

    parts = F.ceil(F.col("size") / PART).cast("long")
    big = rows.where(F.col("size") > BIG)
    mine = big.groupBy(F.col("id").alias("of")).agg(F.collect_set("key").alias("buckets"))
    both = big.join(mine, F.col("id") == F.col("of")).drop("of").unionByName(rows.where(F.col("size") <= BIG).withColumn("buckets", F.lit(None).cast("array<bigint>")))
    cut = both.withColumn("part", F.pmod(F.xxhash64("id"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    cut = cut.withColumn("at", F.col("key")).withColumn("key", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
    return _by_bucket(cut.select("key", "id", "n", "label", "part", "at", "buckets", "sketch"), bucket).select("a", "b")


def across(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of buckets (rows: key, id, n, label, size, major) with different labels and sizes that allow a link: each node
    outside the label ``major`` of its bucket with all of other labels.  Pairs that need two common keys and have one are left out.

    The nodes of major, most of a bucket, are dealt to chunks of some ``CHUNK``; the others go to each.
    """

    small = Bands(num, den).small()

    def bucket(t: pa.Table):
        ids, n, label = (t.column(i).to_numpy() for i in (1, 2, 3))
        most = t.column(4).to_numpy()[0]
        for i in np.flatnonzero(label != most):
            other = (label != label[i]) & ((label == most) | (np.arange(len(ids)) > i)) & (den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i]))
            one = np.maximum(n[other], n[i]) <= small
            yield np.stack([np.minimum(ids[other], ids[i]), np.maximum(ids[other], ids[i]), np.where(one, COMMON, 1)])

    chunks = F.ceil(F.col("size") / CHUNK).cast("long")
    own = F.pmod(F.xxhash64("id"), chunks)
    dealt = rows.withColumn("chunk", F.explode(F.when(F.col("label") == F.col("major"), F.array(own)).otherwise(F.sequence(F.lit(0).cast("long"), chunks - 1))))
    return _by_bucket(dealt.withColumn("key", F.when(chunks == 1, F.col("key")).otherwise(F.xxhash64("key", "chunk"))).select("key", "id", "n", "label", "major"), bucket).groupBy("a", "b").agg(F.sum("met").alias("met")).where(F.col("met") >= COMMON).select("a", "b")


def _by_bucket(rows: DataFrame, bucket) -> DataFrame:
    """bucket(rows of a key) -> pairs and how often they met, for every key, over partitions that are sorted by key."""

    def once(got):
        x = np.concatenate(got, 1)
        x = x[:, np.lexsort(x[1::-1])]
        new = np.flatnonzero(np.concatenate([[True], (x[:2, 1:] != x[:2, :-1]).any(0)])) if x.shape[1] else []
        return np.concatenate([x[:2, new], np.add.reduceat(x[2:], new, 1)]) if len(new) else x

    def batch_of(x):
        return pa.RecordBatch.from_arrays([pa.array(y) for y in x], ["a", "b", "met"])

    def run(batches):
        held: list = []
        for batch in batches:
            held.append(batch)
            key = batch.column(0)
            if len(key) and key[0] == key[-1] and held[0].column(0)[0] == key[0]:
                continue  # one bucket so far
            yield from out(held, False)
        yield from out(held, True)

    def out(held, last):
        """Pairs of all buckets that are whole; the rest stays held."""
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        key = t.column(0).to_numpy()
        if not len(key):
            return
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = [*cut[1:].tolist(), len(key)]
        held[:] = [] if last else t.slice(int(cut[-1])).combine_chunks().to_batches()
        got, size = [], 0
        for a, b in zip(cut.tolist(), ends, strict=True):
            if b - a > 1 and (last or b < len(key)):
                for x in bucket(t.slice(a, b - a)):
                    got.append(x)
                    size += x.shape[1]
                    if size > 200_000:  # pairs of several keys are one
                        got = [once(got)]
                        size = got[0].shape[1]
                        if size > 100_000:
                            yield batch_of(got[0])
                            got, size = [], 0
        if size:
            yield batch_of(once(got))

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(lean(run), "a bigint, b bigint, met bigint")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of keys with more than one label, the key's size and largest label, and whether it has few pairs of different labels for its size."""
    each = rows.groupBy("key", "label").agg(F.count("*").alias("c"))
    keys = each.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s"), F.count("*").alias("labels"), F.max_by("label", "c").alias("major")).where("labels > 1")
    return rows.join(keys.select("key", "major", F.col("n").alias("size"), (F.col("n") * F.col("n") - F.col("s") <= 2 * CROSS * F.col("n")).alias("light")), "key")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, hash_col: str | None = None) -> DataFrame:
    """(id, n_shingles, component_id) of each row, and hash_col if given: the smallest id that links lead to, its own included."""
    start = mark()
    all_ = settled(lambda: buckets(sketch_rows(df, id_col, text_col, k, num, den, hash_col)))
    known, shared = written(all_.where("key is null").drop("key")), all_.where("key is not null").select("key", "hi", "lo")
    classes = known.where("n > 0").groupBy("hi", "lo").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.count("*").alias("copies"))
    # ids may repeat or be null, so a node goes by a number of its own until components are named
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()))
    nodes = classes.select("id", _doc(F.col("least")).alias("doc"), "hi", "lo")
    members = written(shared.join(classes, ["hi", "lo"]).select("key", "id", "n"))
    whole = known.where("n > 0").select(_doc(F.col("id")).alias("doc"), "hi", "lo", "n", "sketch")
    sketches = written(whole.join(nodes.join(members.select("id").distinct(), "id", "left_semi"), ["doc", "hi", "lo"]).dropDuplicates(["doc", "hi", "lo"]).select("id", "n", "sketch"))
    sweep(start, known, classes, members, sketches)
    shrink(df.sparkSession)

    def linked(pairs: DataFrame) -> DataFrame:
        of = lambda: stored_sets(df, nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi"), id_col, text_col, k)
        return settled(lambda: verified(pairs, of(), num, den), PAIRS)

    def labelled_by(labels: DataFrame, rows: DataFrame, name: str = "id", label: str = "label") -> DataFrame:
        """rows with the label of the node called name."""
        of = labels.select(F.col("v").alias("_v"), F.col("label").alias("_label"))
        return rows.join(of, F.col(name) == F.col("_v"), "left").withColumn(label, F.coalesce("_label", name)).drop("_v", "_label")

    lead = members.groupBy("key").agg(F.min(F.struct("id", "n")).alias("lead"))
    star = settled(lambda: led(members.join(lead, "key"), num, den))
    links = linked(settled(lambda: near(star, sketches, num, den)))
    labels = settled(lambda: components(links))
    # a node has no more keys than parts
    mine = _mixed(labelled_by(labels, members)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("size", "key"))).alias("keys"), F.first("n").alias("n"), F.first("label").alias("label"))
    spare = F.when(F.col("n") <= Bands(num, den).small(), 1).otherwise(4 - COMMON)
    fewer = settled(lambda: mine.select("id", "n", "label", F.explode(F.slice("keys", F.lit(1), F.greatest(F.lit(0), F.size("keys") - spare))).alias("k")).select(F.col("k.key").alias("key"), "id", "n", "label"))
    left = settled(lambda: _mixed(fewer))
    sweep(start, known, classes, sketches, star, links, labels, left)
    shrink(df.sparkSession)
    heavy = left.where("not light")
    some = not heavy.isEmpty()
    if some:
        own = heavy.groupBy(F.col("id").alias("of")).agg(F.max(F.struct("size", "key")).alias("_k"))
        largest = heavy.join(own, (F.col("id") == F.col("of")) & (F.col("key") == F.col("_k.key"))).drop("of", "_k")
        first = settled(lambda: within(largest.join(sketches.select("id", "sketch"), "id"), num, den, NEAREST).distinct().join(star, ["a", "b"], "left_anti"))
        links = written(links.unionByName(linked(first)))
        labels = settled(lambda: components(links))
    light = settled(lambda: across(left.where("light"), num, den).join(star, ["a", "b"], "left_anti"))
    close = settled(lambda: near(light, sketches, num, den))
    if some:
        again = settled(lambda: _mixed(labelled_by(labels, heavy.select("key", "id", "n"))))
        all_pairs = settled(lambda: within(again.join(sketches.select("id", "sketch"), "id"), num, den).join(star.unionByName(first), ["a", "b"], "left_anti").distinct())
        close = close.join(first, ["a", "b"], "left_anti").unionByName(all_pairs)
    close = settled(lambda: labelled_by(labels, labelled_by(labels, close, "a", "la"), "b", "lb").where("la != lb").select("a", "b").distinct())
    if not close.isEmpty():
        more = linked(close)
        labels = settled(lambda: components(links.unionByName(more)))
    sweep(start, known, classes, labels)
    labelled = written(classes.join(labels, F.col("id") == F.col("v"), "left").where("copies > 1 or label is not null").select("hi", "lo", "least", F.coalesce("label", "id").alias("label")))
    least = written(labelled.groupBy(F.col("label").alias("of")).agg(F.min("least").alias("component")))
    named = labelled.join(few(least), F.col("label") == F.col("of")).select(F.col("hi").alias("h"), F.col("lo").alias("l"), "component")
    out = known.join(written(named), (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")) & (F.col("n") > 0), "left")
    kind = df.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").cast(kind).alias("component_id"), *([F.col("digest").alias(hash_col)] if hash_col else []))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; odd rows go as the module says."""
    return jaccard_components(documents(spark, sf_dir, "doc_id", "text"), k=4, num=85, den=100)


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
SQL = {
    "op3_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
  COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS grams FROM d),
g AS (SELECT r, unnest(grams) AS gram FROM s),
c AS (SELECT x.r AS a, y.r AS b, count(*) AS n FROM g x JOIN g y ON x.gram = y.gram AND x.r < y.r GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN s x ON x.r = a JOIN s y ON y.r = b WHERE 100 * n >= 85 * (len(x.grams) + len(y.grams) - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t(a, b) AS (SELECT r, r FROM d UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b)
SELECT x.doc_id, len(x.grams)::BIGINT AS n_shingles, m.least AS component_id
FROM s x JOIN (SELECT t.a, min(y.doc_id) AS least FROM t JOIN d y ON y.r = t.b GROUP BY t.a) m ON m.a = x.r
"""
}

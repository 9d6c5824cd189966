"""Substring dedup by super-k-mers of words.

A window is ``WINDOW`` consecutive words of one document.  Its minimiser is the best of its
runs of ``SEED`` words, the longest in bytes (as the frequent runs are short) and of these that with the least hash.
Consecutive windows with the same minimiser are a super-k-mer: they overlap in all but
a word, so they travel together, as one packed string of their words, to the bucket
that the minimiser names.  Equal windows have equal minimisers and so meet in one bucket,
where sorting brings them together and tells exactly in which documents a window
stands; words are compared, not hashes.

What stands often is met early: of equal super-k-mers that a task meets only those of the smallest id so far travel,
all others are known to be repeats.  A passage in a third of all documents so sends a string per task and not per
document (a task remembers up to ``KNOWN`` bytes of strings that it has met twice; what it doesn't remember travels).
Buckets are as many as the input's bytes ask for; strings are compressed per bucket.  A bucket of more than ``HEAVY`` bytes, as
that of a pair of words which many documents' own words surround, is dealt once more, window by window, by the hash of
the window: a second shuffle of such buckets alone, where equal windows of a part of a bucket travel once.
Back come word ranges, which meet the texts by id and content in a shuffle, as small hash tables.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a null text has none.  A window is removed
if it also starts in a document with a smaller id, as the input has it; all words it covers go.
Rows of one id count as one document: they don't repeat each other; each loses its own words.
Rows with a null id neither lose words nor make others lose them.  Long texts are sent in stretches that overlap
by a window less a word.  Columns besides id and text are not looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mapped, mix, slices, words, written

WINDOW, SEED = 13, 2
#: Bytes of text a bucket, and that a task holds at once.
BUCKET, HELD = 5 << 20, 2 << 20
#: Bytes of strings at which a bucket is dealt again, and bytes of buckets in a partition.
HEAVY, SHUFFLED = 64 << 20, 64 << 20
#: Bytes of strings, met more than once, that a task remembers.
KNOWN = 16 << 20
_ODD = 0xD1342543DE82EF95
_SPACE = re.compile(rb"[ \t\n\v\f\r]")
_powers: list[np.ndarray] = []


class Text:
    """Bytes of words between single separators, and hashes of any stretches of them.

    A stretch's hash is a polynomial over its bytes modulo 2 ** 64, read from sums over all bytes before.
    """

    def __init__(self, data: bytes):
        self.data = data
        b = np.frombuffer(data, np.uint8)
        if not _powers or len(_powers[0]) <= len(b):
            n = max(1 << 20, len(b) + len(b) // 8)
            for i, odd in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
                grown = np.full(n, odd, np.uint64)
                grown[0] = 1
                np.multiply.accumulate(grown, out=grown)
                _powers[i:] = [grown]
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers[0][: len(b)], out=self.sums[1:])
        cuts = np.flatnonzero((b == 32) | (b == 10))
        self.starts = np.concatenate([[0], cuts + 1]) if len(b) else cuts
        self.ends = np.concatenate([cuts, [len(b)]]) if len(b) else cuts
        #: the line in which each word stands
        self.line = np.concatenate([[0], np.cumsum(b[cuts] == 10)]) if len(b) else cuts

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _powers[1][start])


def super_kmers(text: Text, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, minimiser) of each super-k-mer; a line is a text of its own."""
    n = len(text.starts) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    a, b = text.starts[: len(text.starts) - seed + 1], text.ends[seed - 1 :]
    order = (np.uint64(255) - np.minimum(255, b - a).astype(np.uint64)) << np.uint64(56) | text.hashes(a, b) >> np.uint64(8)
    best = order[:n].copy()
    for i in range(1, window - seed + 1):
        np.minimum(best, order[i : i + n], out=best)
    inside = text.line[:n] == text.line[window - 1 :]
    new = np.ones(n, bool)
    new[1:] = (best[1:] != best[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    last = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
    return first, last + window, best[first]


def _joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges sorted by document, touching ones as one."""
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o], end[o]
    if not len(doc):
        return doc, start, end
    # ranges of one document as stretches of one line, so that a running maximum of ends stays within it
    step = int(end.max()) + 1
    rank = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])).astype(np.int64) * step
    far = np.maximum.accumulate(rank + end)
    new = np.concatenate([[True], (rank + start)[1:] > far[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], start[first], far[last] - rank[last]


def stretches(text: str | None, window: int, size: int = HELD) -> list[tuple[int, bytes]]:
    """(first word, words joined by one space) of stretches of some ``size`` bytes that hold all windows of a text."""
    raw = (text or "").encode()
    out, at, carry, begin = [], 0, [], 0
    while begin < len(raw):
        end = begin + size
        if end < len(raw):  # to the next white space
            space = _SPACE.search(raw, end)
            end = space.start() if space else len(raw)
        ws = [*carry, *raw[begin:end].split()]
        if len(ws) >= window:
            out.append((at, b" ".join(ws)))
            carry = ws[len(ws) - window + 1 :]
            at += len(ws) - window + 1
        else:
            carry = ws
        begin = end
    return out


def _packed(doc: np.ndarray, tag: np.ndarray, place: np.ndarray, strings: list[bytes]) -> bytes:
    """Documents, their tags, first words and strings, one a line, as compressed bytes; numbers as differences, their bytes by rank."""
    import zstandard

    ranked = lambda x, kind, width: np.diff(x.astype(kind), prepend=kind(0)).astype(kind).view(np.uint8).reshape(-1, width).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.int64(len(doc)).tobytes(), ranked(doc, np.int64, 8), ranked(tag, np.int32, 4), ranked(place, np.int32, 4), b"\n".join(strings)]))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ranked = lambda at, width, kind: np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8, width * n, at).reshape(width, n).T).view(kind)[:, 0], dtype=kind)
    return ranked(8, 8, np.int64), ranked(8 + 8 * n, 4, np.int32), ranked(8 + 12 * n, 4, np.int32), data[8 + 16 * n :]


def repeats(doc: np.ndarray, texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(line, word in it) of each window that also stands in a line of a smaller document; ``doc`` has one entry a line of all texts."""
    parts = []
    lines = 0
    for i, data in enumerate(texts):
        t = Text(data)
        n = len(t.starts) - window + 1
        if n > 0:
            at = np.flatnonzero(t.line[:n] == t.line[window - 1 :])
            begin = np.searchsorted(t.line, t.line[at])
            parts.append((t.hashes(t.starts[at], t.ends[at + window - 1]), lines + t.line[at], at - begin, np.full(len(at), i), t.starts[at], t.ends[at + window - 1]))
        lines += data.count(b"\n") + 1
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, line, place, which, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    hs = h[order]
    same = hs[1:] == hs[:-1]
    some = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))  # windows whose hash another has
    if not len(some):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = order[some]
    differs = hs[some][1:] != hs[some][:-1]
    sliced = [texts[i][x:y] for i, x, y in zip(which[order].tolist(), a[order].tolist(), b[order].tolist(), strict=True)]
    if any(x != y for x, y, d in zip(sliced, sliced[1:], differs.tolist(), strict=False) if not d):  # two windows with one hash: sort by the words themselves
        by_words = sorted(range(len(sliced)), key=sliced.__getitem__)
        order, sliced = order[by_words], [sliced[i] for i in by_words]
        differs = np.array([x != y for x, y in zip(sliced, sliced[1:], strict=False)], bool)
    starts = np.flatnonzero(np.concatenate([[True], differs]))
    d = doc[line[order]]
    least = np.repeat(np.minimum.reduceat(d, starts), np.diff([*starts, len(order)]))
    found = order[least < d]
    found = found[np.lexsort((place[found], line[found]))]
    return line[found], place[found]


class Known:
    """Strings that a task has met more than once, with the smallest document of each."""

    def __init__(self, most: int = KNOWN):
        self.least: dict[bytes, int] = {}
        self.size, self.most = 0, most

    def repeated(self, data: bytes, doc: np.ndarray, a: np.ndarray, b: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Whether each string data[a:b] is known from a smaller document, here or earlier; learns those that stand here twice."""
        order = np.lexsort((doc, h))
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        starts = np.flatnonzero(new)
        lead = order[starts[np.cumsum(new) - 1]]  # of each, the equal one with the smallest document
        out = np.zeros(len(doc), bool)
        again = np.flatnonzero(doc[lead] < doc[order])
        for x, y in zip(order[again].tolist(), lead[again].tolist(), strict=True):
            if data[a[x] : b[x]] == data[a[y] : b[y]]:
                out[x] = True
        for first, n in zip(order[starts].tolist(), np.diff([*starts, len(order)]).tolist(), strict=True):
            if n > 1 or self.least:
                s = data[a[first] : b[first]]
                known, d = self.least.get(s), int(doc[first])
                if known is not None and known < d:
                    out[first] = True
                elif known is not None or (n > 1 and self.size < self.most):
                    self.size += 0 if known is not None else len(s)
                    self.least[s] = d
        return out


ROWS = "id bigint, tag int, start int, end int, part bigint, blob binary"


def _ranges(doc, tag, start, end) -> pa.RecordBatch:
    """Ranges as rows of ROWS, touching ones of a document as one."""
    order = np.lexsort((tag, doc))
    doc, tag = doc[order], tag[order]
    number = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]))
    at = np.searchsorted(number, np.arange(number[-1] + 1))
    got = _joined(number, start[order], end[order])
    n, of = len(got[0]), at[got[0]]
    return pa.RecordBatch.from_arrays([pa.array(doc[of]), pa.array(tag[of]), pa.array(got[1].astype(np.int32)), pa.array(got[2].astype(np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], ["id", "tag", "start", "end", "part", "blob"])


def _sent(part: np.ndarray, doc, tag, place, strings: list[bytes]) -> pa.RecordBatch:
    """Strings as rows of ROWS, packed for each part."""
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]]))
    blobs = [_packed(doc[o], tag[o], place[o], [strings[i] for i in o.tolist()]) for o in np.split(order, cut[1:])]
    n = len(cut)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.int32())] * 3, pa.array(part[order][cut]), pa.array(blobs, pa.binary())], ["id", "tag", "start", "end", "part", "blob"])


def repeated_ranges(df: DataFrame, id_col: str, text_col: str, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(id, tag, start, end): ranges of words that windows repeat from documents with smaller ids; tag is the crc32 of the text that holds the range."""
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(16, -(-total // BUCKET))
    spread = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHUFFLED))

    def send(batches):
        known = Known()
        for batch in batches:
            for piece in slices(batch, "text", HELD):
                held, size = [], 0
                for d, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    if d is None:
                        continue
                    tag = zlib.crc32((t or "").encode())
                    for at, line in stretches(t, window):
                        held.append((d, tag, at, line))
                        size += len(line)
                        if size > HELD:
                            yield from out(held, known)
                            held, size = [], 0
                if held:
                    yield from out(held, known)

    def out(held, known):
        docs, tags, places, lines = zip(*held, strict=True)
        text = Text(b"\n".join(lines))
        first, last, value = super_kmers(text, window, seed)
        if not len(first):
            return
        a, b, line = text.starts[first], text.ends[last - 1], text.line[first]
        doc, tag = np.array(docs, np.int64)[line], np.array(tags, np.uint32).view(np.int32)[line]
        place = first - np.searchsorted(text.line, line) + np.array(places, np.int64)[line]
        again = known.repeated(text.data, doc, a, b, text.hashes(a, b))
        go = np.flatnonzero(~again)
        if len(go):
            yield _sent((value[go] % np.uint64(parts)).astype(np.int64), doc[go], tag[go], place[go], [text.data[i:j] for i, j in zip(a[go].tolist(), b[go].tolist(), strict=True)])
        if len(x := np.flatnonzero(again)):
            yield _ranges(doc[x], tag[x], place[x], place[x] + last[x] - first[x])

    def meet(batches, deal: bool):
        """Ranges from whole buckets; a bucket of more than HEAVY bytes is dealt again by its windows, if ``deal``."""

        def found(held):
            docs, tags, places, texts = zip(*held, strict=True)
            doc, tag, place = np.concatenate(docs), np.concatenate(tags), np.concatenate(places).astype(np.int64)
            line, j = repeats(doc, list(texts), window)
            if len(line):
                first = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (j[1:] > j[:-1] + window)]))
                last = np.concatenate([first[1:], [len(j)]]) - 1
                at, of = place[line[first]], line[first]
                yield _ranges(doc[of], tag[of], at + j[first], at + j[last] + window)

        def dealt(held):
            docs, tags, places, texts = zip(*held, strict=True)
            doc, tag, place = np.concatenate(docs), np.concatenate(tags), np.concatenate(places).astype(np.int64)
            text = Text(b"\n".join(texts))
            n = len(text.starts) - window + 1
            at = np.flatnonzero(text.line[:n] == text.line[window - 1 :])
            line = text.line[at]
            a, b, place = text.starts[at], text.ends[at + window - 1], place[line] + at - np.searchsorted(text.line, line)
            h = text.hashes(a, b)
            again = Known(0).repeated(text.data, doc[line], a, b, h)
            go, x = np.flatnonzero(~again), np.flatnonzero(again)
            for i in range(0, len(go), 200_000):
                g = go[i : i + 200_000]
                yield _sent((h[g] >> np.uint64(1)).astype(np.int64) % (parts * 16), doc[line[g]], tag[line[g]], place[g], [text.data[i:j] for i, j in zip(a[g].tolist(), b[g].tolist(), strict=True)])
            if len(x):
                yield _ranges(doc[line[x]], tag[line[x]], place[x], place[x] + window)

        held, size, heavy, now = [], 0, False, None
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != now:
                    if held:
                        yield from (dealt if heavy else found)(held)
                    held, size, heavy, now = [], 0, False, part
                held.append(_unpacked(blob.as_py()))
                size += len(held[-1][3])
                if deal and size > HEAVY:
                    yield from dealt(held)
                    held, size, heavy = [], 0, True
        if held:
            yield from (dealt if heavy else found)(held)

    sent = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(send, ROWS)
    # ranges are known already; they go through the shuffle's partitions without a bucket
    one = written(_met(sent, spread, lambda batches: meet(batches, True)))
    two = one.where("blob is not null")
    ranges = one.where("blob is null").select("id", "tag", "start", "end")
    if not two.isEmpty():
        ranges = ranges.unionByName(written(_met(two, spread, lambda batches: meet(batches, False))).select("id", "tag", "start", "end"))
    return ranges


def _met(sent: DataFrame, spread: int, meet) -> DataFrame:
    """meet(batches of part and blob, sorted by part) over all buckets; rows that are ranges pass."""

    def run(batches):
        import pyarrow.compute as pc

        def blobs():
            for batch in batches:
                is_range = pc.is_null(batch.column(5))
                if pc.any(is_range).as_py():
                    ready.append(batch.filter(is_range))
                    batch = batch.filter(pc.invert(is_range))
                if batch.num_rows:
                    yield batch.select(["part", "blob"])

        ready: list = []
        for out in meet(blobs()):
            yield from ready
            ready.clear()
            yield out
        yield from ready

    keyed = sent.withColumn("to", F.coalesce("part", F.xxhash64("id", "start")))
    return keyed.repartition(spread, "to").sortWithinPartitions(F.col("part").asc_nulls_first()).drop("to").mapInArrow(run, ROWS)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_removed, kept): kept is the words that stay, joined by one space."""
    found = repeated_ranges(df, id_col, text_col, window, seed)
    # a document has no more ranges than windows
    ranges = found.groupBy(F.col("id").alias("_of"), F.col("tag").cast("long").bitwiseAND(0xFFFFFFFF).alias("_tag")).agg(F.collect_list(F.struct("start", "end")).alias("_ranges")).hint("shuffle_hash")
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.join(ranges, (F.col("_id") == F.col("_of")) & (F.crc32(F.coalesce("_text", F.lit("")).cast("binary")) == F.col("_tag")), "left").select("_id", "_text", F.col("_ranges.start").alias("_a"), F.col("_ranges.end").alias("_b"))

    def each(part):
        out: dict = {"n_words": [], "n_removed": [], "kept": []}
        for t, a, b in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
            ws = words(t)
            gone = np.zeros(len(ws) + 1, np.int32)
            if a:
                np.add.at(gone, a, 1)
                np.add.at(gone, b, -1)
            gone = np.cumsum(gone)[:-1] > 0
            kept = ws if not gone.any() else [w for w, g in zip(ws, gone.tolist(), strict=True) if not g]
            out["n_words"].append(len(ws))
            out["n_removed"].append(int(gone.sum()))
            out["kept"].append(b" ".join(kept).decode())
        return out | {id_col: part.column(0)}

    return mapped(rows, each, f"`{id_col}` bigint, n_words bigint, n_removed bigint, kept string", "_text")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document; odd rows go as the module says."""
    return written(dedup(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
SQL = {
    "op5_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (SELECT r, doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM d WHERE len(ws) >= 13),
g AS (SELECT r, doc_id, i, array_to_string(ws[i:i+12], ' ') AS gram FROM w),
f AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS least FROM g) WHERE least < doc_id),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM f),
p AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM p ANTI JOIN gone USING (r, i) GROUP BY r),
n AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, COALESCE(n_removed, 0)::BIGINT AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN n USING (r)
"""
}

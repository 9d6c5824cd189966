"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of documents.  Every window of ``LENGTH`` tokens adds to each queue's
deficit counter its quantum, the window's length times the queue's target proportion.  Queues are
visited in turn, from where the last window ran out of room; a queue sends documents while its deficit
covers the next one, and pays their tokens.  What room is left goes to the queues that
are owed most, whose deficits then turn negative; a document that passes the window's end is cut there and
goes on later.  So a window has what its targets ask for to within a document a queue, what a queue was owed or had
too much is carried into the next window, and documents are cut at ends of windows only.

Lanes.  A lane is ``LANE`` windows, and one task serves its queues.  How many tokens of each queue lie before a lane
follows from sizes and weights alone (``Schedule``): the fluid schedule, in which each queue is served at its weight and
an emptied queue's turns go to the others, to within a token.  So all deficits are settled at a lane's
end but for what rounding leaves, and that is carried: the prefix that each lane begins with is closed-form.  A
document is sent to the lanes in which its tokens lie, cut at their edges; a hot source is cut over all lanes.
Texts are tokenised once, token ids are stored, then shuffled once, to lanes.

The last tokens, fewer than a window, are cut into sequences of powers of two: nothing is padded.

Null texts count as empty (one closing token), null sources are a queue, the last.  Ids
may repeat or be null; each row is packed.  A source of weight 0 or without one is served when the others are empty.
Sources past the ``QUEUES`` largest share a queue of the fluid schedule (so the driver holds a bounded table); within
a lane each is a queue of its own again.  Columns besides id, text and source are not looked at.
Ties of deficits go to the first queue.  A long text is tokenised in stretches of ``STRETCH`` bytes and held as its ids.  An empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, fields, named, only, shared_folder, slices
from .substrings import Text

LENGTH, LANE, QUEUES, END = 4096, 256, 1 << 17, 2
#: Bytes of a text that are tokenised at once.
STRETCH = 4 << 20
#: Most rows (partition and source) of the table of beginnings that are broadcast; beyond, it is joined by a shuffle.
BROADCAST = 500_000
#: Bytes of token ids in a partition of lanes.
SHUFFLED = 64 << 20


#: Texts whose tokens can be cut by bytes: ASCII and Latin letters to U+00FF, without what the tokenizer treats apart.
_PLAIN = re.compile(rb"(?:[\t-\r -&(-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*")
_SPACE = re.compile(rb"[\t-\r ]")
_KIND = np.full(256, 1, np.uint8)  # letters
_KIND[33:128] = 3  # marks
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2  # digits, each a token
_KIND[:33] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_AFTER = _LOWER.copy()  # of a letter's second byte
_AFTER[0x80:0x9F] += 0x20


class TokenIds:
    """Token ids of texts as bytes of ``width`` each, equal to the tokenizer's.

    It lower-cases, takes runs of letters, single digits and runs of marks apart, and
    merges pairs within each.  So texts of Latin letters are cut here, on bytes, and only
    words that haven't been met are spelled, many at a time: a token that ends a word says so.
    Other texts are cut at white space, and each new piece goes through the tokenizer.
    """

    def __init__(self, path: str, width: int, most: int = 400_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.type, self.most = Tokenizer.from_file(path), np.dtype(f"<u{width}"), most
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.end = np.array([END], self.type).tobytes()

    @classmethod
    def shared(cls, path: str, width: int) -> TokenIds:
        """The one of this process, which keeps its words from task to task."""
        return only(f"tokens {path} {width}", lambda: cls(path, width))

    def _singly(self, ws: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in ws], add_special_tokens=False)]

    def _learn(self, ws: list[bytes]) -> None:
        if len(self.known) + len(ws) > self.most:
            self.known.clear()
        w = self.type.itemsize
        for i in range(0, len(ws), 512):
            part = ws[i : i + 512]
            ids = np.array(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, self.type)
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(part):
                data, at = ids.tobytes(), (at * w).tolist()
                self.known.update(zip(part, [data[a:b] for a, b in zip([0, *at], at, strict=False)], strict=True))
            else:
                self.known.update(zip(part, self._singly(part), strict=True))

    def _plain(self, raws: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        low = _LOWER[data]
        second = np.flatnonzero(data == 0xC3) + 1
        low[second] = _AFTER[data[second]]
        text = Text(low.tobytes())
        kind = _KIND[low]
        new = kind != 0
        new[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        starts = np.flatnonzero(new)
        stop = kind != 0
        stop[:-1] &= (kind[1:] != kind[:-1]) | (kind[:-1] == 2)
        ends = np.flatnonzero(stop) + 1
        if not len(starts):
            return [self.end] * len(raws)
        _, first, back = np.unique(text.hashes(starts, ends), return_index=True, return_inverse=True)
        ws = [text.data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if missing := [w for w in ws if w not in self.known]:
            self._learn(missing)
            if any(w not in self.known for w in ws):  # the memory was emptied
                self._learn([w for w in ws if w not in self.known])
        ids = list(map(self.known.__getitem__, ws))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.type.itemsize
        flat, at = np.frombuffer(b"".join(ids), self.type), np.cumsum(size) - size
        n = size[back]
        upto = np.cumsum(n)
        out = flat[np.repeat(at[back] - (upto - n), n) + np.arange(upto[-1])]
        # texts end where their line feeds stand
        edge = np.cumsum([len(r) + 1 for r in raws])
        cut = np.concatenate([[0], upto])[np.searchsorted(starts, edge)].tolist()
        return [out[a:b].tobytes() + self.end for a, b in zip([0, *cut], cut, strict=False)]

    def of(self, texts: list[str | None], stretch: int = STRETCH) -> list[bytes]:
        """The ids of each text; one of more than ``stretch`` bytes is cut at white space, where no token begins or ends within a word."""
        raws: list[bytes] = []
        parts = []
        for t in texts:
            raw, at, first = (t or "").encode(), 0, len(raws)
            while len(raw) - at > stretch:
                space = _SPACE.search(raw, at + stretch)
                if not space:
                    break
                raws.append(raw[at : space.start()])
                at = space.start()
            raws.append(raw[at:])
            parts.append((first, len(raws)))
        ids = self._of(raws)
        end = len(self.end)
        return [ids[a] if b - a == 1 else b"".join([*(x[:-end] for x in ids[a : b - 1]), ids[b - 1]]) for a, b in parts]

    def _of(self, raws: list[bytes]) -> list[bytes]:
        plain = [i for i, r in enumerate(raws) if b"<|" not in r and _PLAIN.fullmatch(r)]
        out: list = [None] * len(raws)
        if plain:
            for i, x in zip(plain, self._plain([raws[i] for i in plain]), strict=True):
                out[i] = x
        for i, r in enumerate(raws):
            if out[i] is None:
                ws = r.split()
                if new := list(set(ws).difference(self.pieces)):
                    if len(self.pieces) + len(new) > self.most:
                        self.pieces.clear()
                        new = list(set(ws))
                    self.pieces.update(zip(new, self._singly(new), strict=True))
                out[i] = b"".join([*map(self.pieces.__getitem__, ws), self.end])
        return out


def tokenised(df: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str, width: int = 2) -> DataFrame:
    """(id, src, part, at, n, ids) of each row, stored: its partition, its place among that partition's tokens of its source, and its ids."""

    def run(batches):
        from pyspark import TaskContext

        words = TokenIds.shared(tokenizer, width)
        part = TaskContext.get().partitionId()
        at: dict = {}
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                sources, starts, sizes = piece.column(2).to_pylist(), [], []
                ids = words.of(piece.column(1).to_pylist())
                for s, x in zip(sources, ids, strict=True):
                    n = len(x) // width
                    starts.append(at.get(s, 0))
                    sizes.append(n)
                    at[s] = starts[-1] + n
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sources, pa.string()), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], ["id", "src", "part", "at", "n", "ids"])

    kept = df.select(named(id_col).alias("id"), named(text_col).alias("text"), named(source_col).cast("string").alias("src"))
    rows = kept.mapInArrow(run, fields(kept, ("id",), "src string, part int, at bigint, n bigint, ids binary"))
    path = shared_folder(df.sparkSession)
    rows.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


class Schedule:
    """Which tokens of each queue lie in which lane of ``length`` tokens."""

    def __init__(self, sizes: list[int], weights: list[float] | None = None, length: int = LENGTH * LANE):
        self.sizes, self.length = np.array(sizes, np.int64), length
        self.weights = np.array(self.sizes if weights is None else weights, float) if len(sizes) else np.zeros(0)
        self.weights = np.where(self.sizes > 0, np.maximum(self.weights, 1e-12), 1.0)
        self.weights = self.weights / max(1e-300, self.weights.sum())
        self.total = int(self.sizes.sum())
        # tokens served by the time at which each queue runs out, to begin bisection near its end
        out = np.argsort(self.sizes / self.weights)
        ends = (self.sizes / self.weights)[out]
        done = np.cumsum(self.sizes[out])
        self.times = np.concatenate([[0.0], ends])
        self.served = np.concatenate([[0.0], done + ends * np.maximum(0, self.weights.sum() - np.cumsum(self.weights[out]))])

    def _count(self, time: np.ndarray) -> np.ndarray:
        return np.minimum(np.floor(time[:, None] * self.weights + 0.5), self.sizes).astype(np.int64)

    def edges(self, lane: np.ndarray) -> np.ndarray:
        """Tokens of each queue before each lane's beginning; a row per lane."""
        goal = np.minimum(lane.astype(np.int64) * self.length, self.total)
        slack = len(self.sizes) + 1.0
        low = np.interp(goal - slack, self.served, self.times)
        high = np.interp(goal + slack, self.served, self.times) + 1e-9
        high = np.where(goal + slack >= self.served[-1], self.times[-1] * 2 + 1, high)
        for _ in range(64):
            mid = (low + high) / 2
            if not ((mid > low) & (mid < high)).any():
                break
            enough = self._count(mid).sum(1) >= goal
            high, low = np.where(enough, mid, high), np.where(enough, low, mid)
        a, b = self._count(low), self._count(high)
        more = b - a
        before = np.cumsum(more, 1) - more
        out = a + np.clip((goal - a.sum(1))[:, None] - before, 0, more)
        return np.where((goal >= self.total)[:, None], self.sizes, np.where((goal <= 0)[:, None], 0, out))

    def near(self, queue: np.ndarray, place: np.ndarray, up: bool) -> np.ndarray:
        """A lane at or before (up: after) that of the token at a place of a queue."""
        rank = np.interp((place + 0.5) / self.weights[queue], self.times, self.served)
        slack = len(self.sizes) + 2
        w = np.floor((rank + (slack if up else -slack)) / self.length).astype(np.int64) + up
        return np.clip(w, 0, -(-self.total // self.length))

    def parts(self, queue: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows of ``size`` tokens that begin at ``place`` of ``queue``, cut at lanes: row, start in it, length and lane."""
        if not len(queue):
            return (np.zeros(0, np.int64),) * 4
        first, last = self.near(queue, place, False), self.near(queue, place + np.maximum(size, 1) - 1, True)
        edge = self.edges(np.arange(first.min(), last.max() + 2))
        out: list[list] = [[], [], [], []]
        for q in np.unique(queue):
            rows = np.flatnonzero(queue == q)
            col = edge[:, q]
            i = np.searchsorted(col, place[rows], "right") - 1
            n = np.searchsorted(col, place[rows] + size[rows], "left") - i
            row = np.repeat(rows, n)
            k = np.repeat(i, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a = np.maximum(col[k], place[row])
            b = np.minimum(col[k + 1], place[row] + size[row])
            some = b > a
            for x, y in zip(out, (row, a - place[row], b - a, k + first.min()), strict=True):
                x.append(y[some])
        return tuple(np.concatenate(x) for x in out)


def windows(total: int, length: int) -> list[int]:
    """Lengths of the sequences that hold ``total`` tokens: whole windows, then powers of two, the largest first."""
    rest = total % length
    return [length] * (total // length) + [1 << i for i in range(length.bit_length() - 1, -1, -1) if rest >> i & 1]


def serve(queues: list[np.ndarray], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Deficit round-robin over queues of document sizes: (queue, document, start, length, window, offset) of each piece.

    A queue's target is its share of all tokens.  Its deficit is kept as quanta so far less tokens so far, so nothing drifts.
    """
    sizes = np.array([int(q.sum()) for q in queues], np.int64)
    total = int(sizes.sum())
    share = sizes / max(1, total)
    sent, head, at = np.zeros(len(queues), np.int64), [0] * len(queues), [0] * len(queues)
    left = np.array([q[0] if len(q) else 0 for q in queues], np.int64)  # of each queue's next document; 0 of an empty queue
    quanta, turn, out = 0, 0, []

    def send(i: int, window: int, offset: int, n: int) -> None:
        out.append((i, head[i], at[i], n, window, offset))
        sent[i] += n
        at[i] += n
        left[i] -= n
        if not left[i]:
            head[i], at[i] = head[i] + 1, 0
            if head[i] < len(queues[i]):
                left[i] = queues[i][head[i]]

    for window, room in enumerate(windows(total, length)):
        quanta, offset = quanta + room, 0
        owed = quanta * share - sent
        ready = np.flatnonzero((left > 0) & (owed >= left))
        for i in [*ready[ready >= turn].tolist(), *ready[ready < turn].tolist()]:
            credit = owed[i]
            while room and left[i] and credit >= left[i]:
                n = min(int(left[i]), room)
                send(i, window, offset, n)
                room, offset, credit = room - n, offset + n, credit - n
            if not room:
                turn = i  # it goes on in the next window
                break
        while room:
            i = int(np.argmax(np.where(left > 0, quanta * share - sent, -np.inf)))
            n = min(int(left[i]), room)
            send(i, window, offset, n)
            room, offset = room - n, offset + n
    return out


PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(df: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str, weights: dict | None = None, length: int = LENGTH, width: int = 2, lane: int = LANE) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset); weights: of sources, their shares of all tokens if None."""
    spark = df.sparkSession
    rows = tokenised(df, id_col, text_col, source_col, tokenizer, width)
    parts = rows.groupBy("src", "part").agg(F.sum("n").alias("n"))
    totals = parts.groupBy("src").agg(F.sum("n").alias("n"))
    big = totals.orderBy(F.col("n").desc(), F.col("src").cast("binary").asc_nulls_last()).limit(QUEUES).collect()
    total = totals.agg(F.sum("n")).first()[0] or 0
    names = sorted([r["src"] for r in big], key=lambda s: (s is None, (s or "").encode()))
    sizes = {r["src"]: r["n"] for r in big}
    queues = [sizes[s] for s in names]
    shared = total - sum(queues)
    plan = Schedule(queues + [shared] * bool(shared), None if weights is None else [weights.get(s, 0.0) for s in names] + [sum(w for s, w in weights.items() if s not in sizes)] * bool(shared), length * lane)
    number = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "src string, queue int")
    q = F.coalesce("queue", F.lit(len(names)))
    begin = parts.join(F.broadcast(number.withColumnRenamed("src", "_s")), parts["src"].eqNullSafe(F.col("_s")), "left").select("src", "part", "n", q.alias("queue"))
    order = Window.partitionBy("queue").orderBy("part", F.col("src").cast("binary").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    begin = begin.select(F.col("src").alias("_s"), F.col("part").alias("_p"), "queue", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    if parts.count() <= BROADCAST:
        begin = F.broadcast(begin)
    placed = rows.join(begin, rows["src"].eqNullSafe(F.col("_s")) & (rows["part"] == F.col("_p"))).select("id", "src", "queue", (F.col("base") + F.col("at")).alias("place"), "n", "ids")
    sent = spark.sparkContext.broadcast(plan)  # a few numbers a queue

    def cut(batches):
        """Rows as parts of lanes."""
        for batch in batches:
            for piece in slices(batch, "ids", 4 << 20):
                place, size = piece.column(3).to_numpy(), piece.column(4).to_numpy()
                row, start, n, at = sent.value.parts(piece.column(2).to_numpy(), place, size)
                ids = [memoryview(x.as_buffer()) for x in piece.column(5)]
                took = [ids[r][width * a : width * (a + k)] for r, a, k in zip(row.tolist(), start.tolist(), n.tolist(), strict=True)]
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(at), piece.column(1).take(of), pa.array(place[row]), piece.column(0).take(of), pa.array(start), pa.array(size[row]), pa.array(took, pa.binary())], ["lane", "src", "place", "id", "start", "n", "ids"])

    def packed(batches):
        """The pieces of lane after lane, from rows sorted by lane, source and place."""
        held: list[pa.RecordBatch] = []

        def out():
            t = pa.Table.from_batches(held).combine_chunks()
            src, ids = t.column(1).to_pylist(), [memoryview(x.as_buffer()) for x in t.column(6)]
            size = np.array([len(x) // width for x in ids], np.int64)
            edge = [0, *(i for i in range(1, len(src)) if src[i] != src[i - 1]), len(src)]
            queue, doc, start, n, window, offset = np.array(serve([size[a:b] for a, b in zip(edge, edge[1:], strict=False)], length), np.int64).reshape(-1, 6).T
            row = np.array(edge)[queue] + doc
            crcs = [zlib.crc32(np.frombuffer(ids[r], f"<u{width}", k, width * a).astype("<u4").tobytes()) for r, a, k in zip(row.tolist(), start.tolist(), n.tolist(), strict=True)]
            of, base = pa.array(row), t.column(0)[0].as_py() * lane
            first, tokens = t.column(4).to_numpy()[row], t.column(5).to_numpy()[row]
            cols = [t.column(3).combine_chunks().take(of), pa.array(first + start), pa.array(n), pa.array(crcs, pa.int64()), pa.array(tokens), pa.array(base + window), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            at = batch.column(0).to_numpy()
            edge = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for a, b in zip(edge, edge[1:], strict=False):
                if held and b > a and held[0].column(0)[0].as_py() != at[a]:
                    yield from out()
                    held.clear()
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from out()

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * width // SHUFFLED))
    lanes = placed.mapInArrow(cut, T.StructType([*T.StructType.fromDDL("lane bigint, src string, place bigint"), *fields(rows, ("id",), "start bigint, n bigint, ids binary")]))
    return lanes.repartition(n, "lane").sortWithinPartitions("lane", "src", "place").mapInArrow(packed, fields(df, (id_col,), PIECES))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document, sources in proportion to their tokens; odd rows go as the module says."""
    return pack(documents(spark, sf_dir, "doc_id", "text", "source"), "doc_id", "text", "source", tokenizer_path())


QUERIES = {"op7_packing": op7_packing}
SQL: dict[str, str] = {}

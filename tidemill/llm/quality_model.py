"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words (the last may be shorter).
Each passage is encoded from what stands in it alone: its words and pairs of words, hashed into ``HASHED`` places, rates of character
classes, word lengths, repetition within the passage, and its size.  From the labels of documents alone, a gated attention

    a_k ~ exp(w . (tanh(V h_k) * sigmoid(U h_k))),   h_k = tanh(W x_k + b)

learns which passages matter, and a logistic score is read from the weighted
passage representation sum_k a_k h_k (Ilse, Tomczak and Welling 2018).

The model is fitted on the driver, on at most ``SAMPLE`` labelled documents of each class (those
with the least hash of the id) and of each at most ``FITTED`` passages, evenly spread; they are encoded by the executors, so that
2 * SAMPLE * FITTED rows of ``WIDTH`` numbers at most reach the driver.  The model is a few thousand
numbers, whatever the table's size.  Every passage of every document is scored.

Null and empty texts are bags of one passage of no words.  Null labels are left
out; of a document's repeated labels the highest counts; of repeated rows of an id the model learns from one, that with the
least hash of its text.  Repeated documents, also of null ids, are scored
each.  Without labels of both classes every score is the share of label 1
(1 without any label), in which case no passage stands out: the first has weight 1 over their number.  Passages that tie for the largest weight: the first.
A very long text is taken whole, in memory some 60 bytes a byte and ``WIDTH`` numbers a passage.  Labels, lang, source, id and other
columns are no inputs of a score.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, documents, fields, fold, mapped, mix, named, windows_hash, written

PASSAGE, SAMPLE, FITTED, HIDDEN, GATE, STEPS = 64, 1200, 24, 24, 12, 250
#: Places of hashed words, and as many of hashed pairs of words.
HASHED = 64

_CLASS = np.full(256, 5, np.int64)  # bytes of other scripts
_CLASS[:128] = 4  # control characters
_CLASS[[9, 11, 12, 13, 32]] = 3
for _i, _c in enumerate([c for c in range(33, 127) if not chr(c).isalnum()]):
    _CLASS[_c] = 6 + _i
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 2, 1, 0
CLASSES = int(_CLASS.max()) + 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
WIDTH = CLASSES + 8 + 2 * HASHED


def passages(text: str | None, hashes: WordHashes) -> np.ndarray:
    """One row of features for each passage."""
    raw = (text or "").encode()
    ws = raw.split()
    if not ws:
        return np.zeros((1, WIDTH), np.float32)
    n, b = len(ws), np.frombuffer(raw, np.uint8)
    of = np.arange(n) // PASSAGE
    k = int(of[-1]) + 1
    size = np.bincount(of).astype(float)
    space = _SPACE[b]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    at = np.zeros(len(b), np.int64)
    at[starts[PASSAGE::PASSAGE]] = 1
    at = np.cumsum(at)
    x = np.zeros((k, WIDTH))
    counts = np.bincount(at * CLASSES + _CLASS[b], minlength=k * CLASSES).reshape(k, CLASSES)
    x[:, :CLASSES] = counts / counts.sum(1, keepdims=True)
    length = np.fromiter(map(len, ws), np.float64, n)
    h = hashes.of(ws)
    mean = np.bincount(of, length) / size
    own = np.unique(h ^ of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)[1]
    same = of[1:] == of[:-1]
    again = np.zeros(n)
    if n > 3:  # runs of three words that stood earlier in the passage
        runs = mix(windows_hash(h, 3) ^ of[:-2].astype(np.uint64))
        again[: len(runs)] = of[2:] == of[:-2]
        again[np.unique(runs, return_index=True)[1]] = 0
    j = CLASSES
    x[:, j] = np.log1p(size) / 4
    x[:, j + 1] = mean / 8
    x[:, j + 2] = np.sqrt(np.maximum(0, np.bincount(of, length**2) / size - mean**2)) / 8
    x[:, j + 3] = np.bincount(of[own], minlength=k) / size
    x[:, j + 4] = np.bincount(of[1:], (h[1:] == h[:-1]) & same, minlength=k) / size
    x[:, j + 5] = np.bincount(of, again) / size
    x[:, j + 6] = np.bincount(of, length <= 3) / size
    x[:, j + 7] = np.bincount(of, length >= 12) / size
    j += 8
    places = np.uint64(HASHED - 1)
    x[:, j : j + HASHED] = np.bincount(of * HASHED + (mix(h.copy()) & places).astype(np.int64), minlength=k * HASHED).reshape(k, HASHED)
    pair = (windows_hash(h, 2) & places).astype(np.int64)[same] if n > 1 else np.zeros(0, np.int64)
    x[:, j + HASHED :] = np.bincount(of[1:][same] * HASHED + pair, minlength=k * HASHED).reshape(k, HASHED)
    x[:, j:] = np.sqrt(x[:, j:] / size[:, None])
    return x.astype(np.float32)


class Model:
    """Encoder, gated attention and logistic read-out over bags of passages."""

    def __init__(self, width: int, seed: int = 7):
        r = np.random.default_rng(seed)
        g = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.p = {"W": g(width, HIDDEN), "b": np.zeros(HIDDEN), "V": g(HIDDEN, GATE), "U": g(HIDDEN, GATE), "w": g(GATE, 1)[:, 0], "c": g(HIDDEN, 1)[:, 0], "c0": np.zeros(1)}
        self.constant: float | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        """Score of each bag (rows of x from each start on), its attention weights and what learning needs."""
        p, bag = self.p, np.repeat(np.arange(len(starts)), np.diff([*starts, len(x)]))
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["c0"], -30, 30)))
        return score, a, (x, h, t, s, z, bag)

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.full(len(starts), self.constant) if self.constant is not None else self.forward(x, starts)[0]

    def fit(self, bags: list[np.ndarray], y: np.ndarray, steps: int = STEPS, rate: float = 0.02, decay: float = 1e-4) -> Model:
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 1.0
            return self
        x, y = np.concatenate(bags).astype(np.float32), y.astype(np.float32)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        starts = np.cumsum([0, *map(len, bags)])[:-1]
        weight = 1 / np.diff([*starts, len(x)])[np.repeat(np.arange(len(bags)), np.diff([*starts, len(x)]))]
        self.mean = np.average(x, 0, weight).astype(np.float32)
        self.scale = (np.sqrt(np.average((x - self.mean) ** 2, 0, weight)) + 1e-3).astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(q) for k, q in self.p.items()}
        each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()).astype(np.float32)
        for step in range(1, steps + 1):
            for k, d in self._gradient(x, starts, y, each).items():
                d = d + decay * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                self.p[k] -= rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradient(self, raw, starts, y, each) -> dict:
        p = self.p
        score, a, (x, h, t, s, z, bag) = self.forward(raw, starts)
        d = each * (score - y)
        dz = d[:, None] * p["c"]
        da = (dz[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, starts)[bag])
        dg = de[:, None] * p["w"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T
        dp = dh * (1 - h * h)
        return {"c": z.T @ d, "c0": np.array([d.sum()]), "w": (t * s).T @ de, "V": h.T @ dt, "U": h.T @ ds, "W": x.T @ dp, "b": dp.sum(0)}


def fit(texts: list[str | None], labels: np.ndarray) -> Model:
    hashes = WordHashes()
    return Model(WIDTH).fit([passages(t, hashes) for t in texts], np.asarray(labels, float))


def spread(bag: np.ndarray, most: int = FITTED) -> np.ndarray:
    """At most ``most`` passages of a bag, evenly spread, first and last included."""
    return bag if len(bag) <= most else bag[np.linspace(0, len(bag) - 1, most).round().astype(np.int64)]


def fit_table(df: DataFrame, text_col: str, label_col: str, order_col: str) -> Model:
    """A model from rows of labelled texts, of which there are few; their passages are encoded by the executors."""
    state: list = []

    def each(part):
        if not state:
            state.append(WordHashes())
        bags = [spread(passages(t, state[0])) for t in part.column(0).to_pylist()]
        return {"y": part.column(1), "o": part.column(2), "n": [len(b) for b in bags], "x": [b.astype(np.float32).tobytes() for b in bags]}

    rows = mapped(df.select(named(text_col).alias("_text"), named(label_col).alias("y"), named(order_col).cast("string").alias("o")), each, "y int, o string, n int, x binary", "_text", 1 << 20)
    got = sorted(written(rows).collect(), key=lambda r: (r["o"], bytes(r["x"])))  # 2 * SAMPLE rows
    return Model(WIDTH).fit([np.frombuffer(r["x"], np.float32).reshape(r["n"], WIDTH) for r in got], np.array([r["y"] for r in got], float))


def score(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep``, score, the number of passages and the largest attention weight with its passage."""
    sent, state = df.sparkSession.sparkContext.broadcast(model), []  # a few thousand numbers

    def each(part):
        if not state:
            state.append(WordHashes())
        bags = [passages(t, state[0]) for t in part.column(0).to_pylist()]
        starts = np.cumsum([0, *map(len, bags)])
        m = sent.value
        if m.constant is None:
            out, a, _ = m.forward(np.concatenate(bags), starts[:-1])
        else:
            out, a = np.full(len(bags), m.constant), np.repeat(1 / np.diff(starts), np.diff(starts))
        top = [int(a[i:j].argmax()) for i, j in zip(starts[:-1], starts[1:], strict=True)]
        return {k: part.column(i) for i, k in enumerate(keep, 1)} | {"score": out, "passages": np.diff(starts), "top_passage": top, "top_weight": [float(a[i + k]) for i, k in zip(starts[:-1], top, strict=True)]}

    return mapped(df.select(named(text_col).alias("_text"), *map(named, keep)), each, fields(df, keep, "score double, passages bigint, top_passage bigint, top_weight double"), "_text", 1 << 20)


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages, top_passage, top_weight) of every document; odd rows go as the module says."""
    held_out = fold(F.col("doc_id"), 5) == 0
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    labels = labels.where(~held_out)
    ids = None
    for y in (0, 1):
        some = labels.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        ids = some if ids is None else ids.unionByName(some)
    train = docs.join(F.broadcast(written(ids)), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    model = fit_table(train, "text", "quality", "doc_id")
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "passages", "top_passage", "top_weight")


QUERIES = {"op2_quality_model": op2_quality_model}
SQL: dict[str, str] = {}

"""Toxicity: two class-conditional Kneser-Ney models that share their backoff counts.

The models spell words: character n-grams of a word between start marks and the space that ends it, so that stems
and inflected or disguised forms count as well as whole words.
Each class counts in how many of its training documents a word stands; its
n-grams of the highest order have counts and (from counts of counts) modified Kneser-Ney discounts of its own,

    p(c|h) = (n(hc) - D(n)) / n(h) + gamma(h) s(c|h'),

while s, a modified Kneser-Ney model of the order ``SHARED``, holds continuation counts over both classes
together; a context that a class has not met leaves all to s.  Every word of every training text counts.  The log-likelihood
ratio of the classes is summed over a word, then normalised by length: a document's
figures are its mean a word and the means of its ``TOP`` most toxic distinct words,
so that length neither adds nor dilutes, and one rare word weighs less than several.  A logistic fit turns
them into a score; it uses a fold of labelled documents that the models haven't
counted, at most ``CALIBRATION`` of them, those with the least hash of the id.

Words are scored once each, wherever they stand: distinct words ask for their n-grams, then blocks of texts for their
words (see ``blocks``), so that no model is broadcast or collected.

Of equal training texts with equal labels one counts.  Null and empty texts, and empty tables of texts, have
figures 0 and get the score that follows from them.  Null labels are left out; of
a document's repeated labels the highest counts.  Repeated documents are scored
each, also with repeated or null ids.  Without labels of both classes every score is 0.  Of equal words the order
is no matter.  A very long text is a block of its own.  Labels, lang, source, id and other columns are no inputs of a score.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import blocks, charlm
from .common import documents, few, fields, fold, mapped, named, released, settled, slices, written

ORDER, SHARED = 10, 5
TOP, SHORT = (1, 2, 4, 8), 8
#: Most labelled documents that the logistic fit uses.
CALIBRATION = 20_000
#: Distinct words in a part of the vocabulary.
VOCABULARY = 200_000
FIGURES = ("mean", *(f"top{k}" for k in TOP))
#: What a missed toxic document weighs against a false alarm.
COST = 5.0
_TRIM = ".,;:!?\"'()[]{}<>*#$%&|-_"
#: Characters of a word that are spelled; longer ones are no words, and go on in pieces.
_PIECE = 40
_CONTEXT = 0x2545F4914F6CDD1D  # tells a context's key from an n-gram's


def tokens(text: str | None) -> list[str]:
    out = []
    for w in (text or "").lower().split():
        w = w.strip(_TRIM)
        out += [w[i : i + _PIECE] for i in range(0, len(w), _PIECE)] if len(w) > _PIECE else [w]
    return out


class Numbers(dict):
    """Runs of a block without white space -> the number of their word, -1 for those of several words; words are numbered as they come."""

    def __init__(self):
        super().__init__()
        self.words: dict[str, int] = {}

    def __missing__(self, run: str) -> int:
        w = run.strip(_TRIM)
        self[run] = n = -1 if len(w) > _PIECE else self.words.setdefault(w, len(self.words))
        return n

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the numbers of its ``tokens``."""
        out = []
        for t in texts:
            runs = (t or "").lower().split()
            x = np.fromiter(map(self.__getitem__, runs), np.int32, len(runs))
            out.append(np.array([self.words.setdefault(w, len(self.words)) for w in tokens(t)], np.int32) if len(x) and x.min() < 0 else x)
        return out


def _ranked(x: np.ndarray) -> bytes:
    """32-bit numbers, their bytes by rank, so that compression finds the zeros."""
    return x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _tokenised(batches: list[pa.RecordBatch]) -> bytes:
    """A block's body in three parts: its distinct words; for each text (the first column) its distinct words' numbers and how often each stands; the other columns."""
    import zstandard

    numbers = Numbers()
    texts = [np.unique(x, return_counts=True) for b in batches for x in numbers.of(b.column(0).to_pylist())]
    size = np.array([len(x) for x, _ in texts], np.int32)
    of, times = (np.concatenate([np.zeros(0, np.int32), *x]) for x in zip(*texts, strict=True))
    parts = [
        blocks.body_of([pa.RecordBatch.from_arrays([pa.array(list(numbers.words), pa.string())], ["word"])]),
        zstandard.ZstdCompressor(level=3).compress(b"".join([np.int64(len(size)).tobytes(), _ranked(size), _ranked(np.diff(of, prepend=0)), _ranked(times)])),
        blocks.body_of([b.select(b.schema.names[1:]) for b in batches]),
    ]
    return b"".join([*(len(x).to_bytes(8, "little") for x in parts), *parts])


def _part(body: bytes, i: int) -> bytes:
    sizes = [int.from_bytes(body[8 * k : 8 * k + 8], "little") for k in range(3)]
    return body[24 + sum(sizes[:i]) : 24 + sum(sizes[: i + 1])]


def _words(body: bytes) -> list[str]:
    return [w for b in blocks.batches_of(_part(body, 0)) for w in b.column(0).to_pylist()]


def _texts(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text's words begin, then the end; the words' numbers; how often each stands in its text."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(_part(body, 1))
    n = int(np.frombuffer(data, np.int64, 1)[0])
    read = lambda at, k: np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * k, at).reshape(4, k).T).view("<i4")[:, 0]
    at = np.concatenate([[0], np.cumsum(read(8, n), dtype=np.int64)])
    k = int(at[-1])
    return at, np.cumsum(read(8 + 4 * n, k), dtype=np.int64), read(8 + 4 * n + 4 * k, k)


def word_counts(train: DataFrame) -> DataFrame:
    """(toxic, word, c): in how many texts of each class a word stands.  One row per word, class and part of a task is shuffled."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([y for y, _ in keys], pa.int32()), pa.array([w for _, w in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], ["toxic", "word", "c"])

        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    seen.update([(y, w) for w in set(tokens(t)) if w])
                if len(seen) > 500_000:
                    yield out()
                    seen.clear()
        yield out()

    rows = train.select("text", F.col("toxic").cast("int")).mapInArrow(released(run), "toxic int, word string, c bigint")
    return rows.groupBy("toxic", "word").agg(F.sum("c").alias("c"))


def class_rows(words: DataFrame, order: int = ORDER, shared_order: int = SHARED) -> DataFrame:
    """Rows (tag, gram, value) of the log ratio of class 1 to class 0, from (toxic, word, c): tag 0 for n-grams, 1 for contexts.

    A window's ratio is that of its n-gram plus that of its context, each 0 where there is no row.  Both classes stand in one row of an
    n-gram, and a context's n-grams (no more than there are characters) meet in one window.
    """
    marked = F.concat(F.lit(charlm._START * (order - 1)), "word", F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(marked, i, F.lit(order)))
    both = words.groupBy("word").agg(*[F.sum(F.when(F.col("toxic") == y, F.col("c")).otherwise(0)).alias(f"c{y}") for y in (0, 1)])
    counts = written(both.select(F.explode(grams).alias("gram"), "c0", "c1").groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))
    tail = F.expr(f"substring(gram, {order - shared_order + 1})")
    pooled = counts.groupBy(F.lit("").alias("grp"), tail.alias("gram")).agg(F.count("*").alias("c"))
    shared = few(written(charlm.probabilities(written(pooled), shared_order).select(F.col("gram").alias("sfx"), F.col("p").alias("low"))))
    per_class = counts.select(F.explode(F.array(F.struct(F.lit("0").alias("grp"), F.col("c0").alias("c")), F.struct(F.lit("1").alias("grp"), F.col("c1").alias("c")))).alias("x")).select("x.*").where("c > 0")
    levels = {r["grp"]: [r["d1"], r["d2"], r["d3"]] for r in charlm.discounts(per_class).collect()}  # a row per class
    x, ctx = counts.withColumns({"ctx": F.expr(f"substring(gram, 1, {order - 1})"), "sfx": tail}), Window.partitionBy("ctx")
    for y in (0, 1):
        c = F.col(f"c{y}")
        d = levels.get(str(y), [0.5, 1.0, 1.5])
        x = x.withColumn(f"d{y}", F.when(c == 0, 0.0).when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2]))
    x = x.withColumns({f"{n}{y}": F.sum(f"{c}{y}").over(ctx) for y in (0, 1) for n, c in (("total", "c"), ("left", "d"))} | {"first": F.row_number().over(ctx.orderBy("gram"))})
    gamma = {y: F.col(f"left{y}") / F.col(f"total{y}") for y in (0, 1)}
    weight = sum((F.when(F.col(f"total{y}") > 0, F.log(gamma[y]) * sign).otherwise(0.0) for y, sign in ((0, -1), (1, 1))), F.lit(0.0))
    own = {y: (F.col(f"c{y}") - F.col(f"d{y}")) / F.col(f"total{y}") for y in (0, 1)}
    delta = sum((F.when(F.col(f"c{y}") > 0, (F.log(own[y] + gamma[y] * F.col("low")) - F.log(gamma[y]) - F.log("low")) * sign).otherwise(0.0) for y, sign in ((0, -1), (1, 1))), F.lit(0.0))
    x = x.join(shared, "sfx").select("gram", "ctx", "first", weight.alias("weight"), delta.alias("delta"))
    rows = F.array(F.struct(F.lit(0).alias("tag"), F.col("gram").alias("gram"), F.col("delta").alias("value")), F.struct(F.lit(1).alias("tag"), F.col("ctx").alias("gram"), F.when(F.col("first") == 1, F.col("weight")).otherwise(0.0).alias("value")))
    return x.select(F.explode(rows).alias("x")).select("x.*").where("value != 0")


def _spelled(ws: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the n-grams and of the contexts of each word's windows, and how many a word has."""
    c, starts, lengths = charlm.codes([w + " " for w in ws], order)
    at = np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return charlm.mix(charlm.window_keys(c, order)[at - order + 1]), charlm.mix(charlm.window_keys(c, order - 1)[at - order + 1] + np.uint64(_CONTEXT)), lengths


def class_model(words: DataFrame, order: int = ORDER, shared_order: int = SHARED) -> DataFrame:
    """(key, value): class_rows by the keys of n-grams and contexts, written."""

    def keyed(part):
        tag, gram = np.array(part.column(0).to_pylist(), np.int64), part.column(1).to_pylist()
        key = np.zeros(len(gram), np.uint64)
        for t in (0, 1):
            at = np.flatnonzero(tag == t)
            n = order - t
            c = np.frombuffer("".join([gram[i] for i in at]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
            for i in range(n):
                key[at] += (c[:, n - 1 - i].astype(np.uint64) + np.uint64(1)) * charlm._POWERS[i]
            key[at] += np.uint64(t * _CONTEXT)
        return {"key": charlm.mix(key).view(np.int64), "value": part.column(2).to_numpy().astype(np.float32)}

    return settled(lambda: mapped(class_rows(words, order, shared_order), keyed, "key bigint, value float", "gram"))


def word_ratios(words: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, value): the log ratio of each of the distinct words (word), by the word's key, from class_model."""
    words = settled(lambda: words)
    n, size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    # neighbours have n-grams in common
    parts = max(-(-n // VOCABULARY), words.sparkSession.sparkContext.defaultParallelism)
    table = blocks.stored(words.repartitionByRange(parts, "word"), "word", total=size)

    def spelled(body):
        for part in blocks.batches_of(body):
            ws = part.column(0).to_pylist()
            yield ws, *_spelled(ws, order)

    def keys_of(body):
        return np.unique(np.concatenate([x for _, grams, contexts, _ in spelled(body) for x in (grams, contexts)]))  # of a part of the vocabulary

    def use(body, keys, values):
        found = blocks.Values(keys, values)
        for ws, grams, contexts, lengths in spelled(body):
            sums = np.concatenate([[0.0], np.cumsum(found.of(grams).astype(np.float64) + found.of(contexts))])
            end = np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays([pa.array(word_keys(ws).view(np.int64)), pa.array((sums[end] - sums[end - lengths]).astype(np.float32))], ["key", "value"])

    return blocks.answered(table, keys_of, model, use, "key bigint, value float")


def word_keys(ws: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in ws), np.uint64, len(ws))


def figures(df: DataFrame, model: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", order: int = ORDER) -> DataFrame:
    """The columns ``keep``, and FIGURES, from class_model."""
    table = blocks.stored(df.select(named(text_col).alias("_text"), *[named(k).alias(f"k{i}") for i, k in enumerate(keep)]), "_text", make=_tokenised)
    arrow = to_arrow_schema(schema := fields(df, keep, ", ".join(f"{k} double" for k in FIGURES)))

    def distinct(batches):
        for batch in batches:
            for body in batch.column(1):
                yield pa.RecordBatch.from_arrays([pa.array([w for w in _words(body.as_py()) if w], pa.string())], ["word"])

    def keys_of(body):
        return np.unique(word_keys(_words(body)))

    def use(body, keys, values):
        value = blocks.Values(keys, values).of(word_keys(_words(body))).astype(np.float64)
        at, of, times = _texts(body)
        out = [document_figures(value[of[a:b]], times[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        done = 0
        for part in blocks.batches_of(_part(body, 2)):
            own, done = out[done : done + part.num_rows], done + part.num_rows
            yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(part.columns, arrow, strict=False)], *[pa.array(c, pa.float64()) for c in zip(*own, strict=True)]], schema=arrow)

    ratios = settled(lambda: word_ratios(table.table.mapInArrow(released(distinct), "word string").distinct(), model, order))
    return blocks.answered(table, keys_of, ratios, use, schema)


def document_figures(value: np.ndarray, times: np.ndarray) -> list[float]:
    """FIGURES of a text whose distinct words have ratios ``value`` and stand so often; a text shorter than ``SHORT`` words counts as one filled with zeros."""
    best = np.sort(value)[::-1]
    return [float(value @ times) / max(int(times.sum()), SHORT), *(float(best[:k].sum()) / k for k in TOP)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a logistic fit by Newton steps; the last is the intercept.  Class 1 weighs COST times as much."""
    scale = x.std(0) + 1e-9
    a = np.c_[x / scale, np.ones(len(x))]
    w, each = np.zeros(a.shape[1]), np.where(y == 1, COST, 1.0)
    each /= each.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (each * (p - y)) + ridge * np.r_[w[:-1], 0]
        hess = (a * (each * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + ridge * np.diag([1.0] * (len(w) - 1) + [1e-6])
        w -= np.clip(np.linalg.solve(hess, grad), -5, 5)
    return np.r_[w[:-1] / scale, w[-1]]


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted, figures) of every document.

    The result is written and read again; odd rows go as the module says.
    """
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    labels = written(labels.where(fold(F.col("doc_id"), 5) != 0))
    counted = labels.where(fold(F.col("doc_id"), 5) != 4)
    once = docs.join(few(counted), "doc_id").groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("m"), "toxic").agg(F.min("doc_id").alias("doc_id"))
    train = docs.join(few(written(once.select("doc_id", "toxic"))), "doc_id")
    model = class_model(word_counts(train))
    scored = settled(lambda: figures(docs, model))
    fit = scored.join(few(labels.where(fold(F.col("doc_id"), 5) == 4)), "doc_id")
    rows = fit.orderBy(F.xxhash64("doc_id"), "doc_id", *FIGURES).select(*FIGURES, "toxic").limit(CALIBRATION).toPandas()
    y = rows.toxic.to_numpy(float)
    if 0 < y.sum() < len(y):
        w = logistic(rows[list(FIGURES)].to_numpy(float), y)
        linear = sum((F.lit(float(a)) * F.col(k) for a, k in zip(w, FIGURES, strict=False)), F.lit(float(w[-1])))
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), linear))))
    else:
        score = F.lit(0.0)
    out = scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), score.alias("score"), *FIGURES)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op9_toxicity": op9_toxicity}
SQL: dict[str, str] = {}

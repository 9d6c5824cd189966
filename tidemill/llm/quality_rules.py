"""Quality rules: counts of a document's words and lines, and n-gram perplexity bands.

The perplexity model is a modified Kneser-Ney model over characters (see
``charlm``), one per language, counted over all documents.  A document's figure
is its bits a word; marks that stand alone, as between a table's cells, are no words here.  Each language's band lies around the median of its
documents: as many spreads (distances of the quartiles from the median, each
side its own) as ``WIDTH``, widened for short texts, whose figures scatter.

Null and empty texts have no words and fail the base rules.  A null language is a
language of its own.  Repeated rows are counted and returned as they come, also with repeated or null ids.
A very long text is a block of its own, in memory some 50 times its bytes.  Other columns than text, language and
those kept are not looked at, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import blocks, charlm
from .common import SPACE, documents, few, fields, mix, named, settled, windows_hash, written
from .substrings import Text

#: Spreads on either side of a language's median.
WIDTH = 8.0
#: Words at which a text's tolerance is that of a long one times the square root of 2.
SHORT = 100
#: Least spread in bits a word.
LEAST = 0.25
#: Bits a word in a bin of the histogram from which medians and quartiles are read.
BIN = 1 / 64

SYMBOLS = b"#*$%&|<>"
BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE)] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_ALNUM = np.array([c > 127 or chr(c).isalnum() for c in range(256)])


def base_counts(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and words with a letter or digit, of each text; null texts are empty."""
    raws = [(t or "").encode() for t in texts]
    if not raws:
        return (np.zeros(0, np.int64),) * 6
    text = Text(b"\n".join(raws) + b"\n")
    b, n = np.frombuffer(text.data, np.uint8), len(raws)
    edge = np.cumsum([0, *(len(r) + 1 for r in raws)])
    space = _SPACE[b]
    each = lambda mask: np.add.reduceat(mask.view(np.uint8), edge[:-1], dtype=np.int64)  # noqa: E731  a text has its line feed at least
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    of = np.searchsorted(edge, start, "right") - 1
    letters = np.maximum.reduceat(_ALNUM[b], start) if len(start) else np.zeros(0, bool)
    repeated = np.zeros(n, np.int64)
    if len(start) > 5:
        at = np.flatnonzero(of[4:] == of[:-4])
        key = windows_hash(text.hashes(start, end), 5)[at]
        key ^= mix(of[at].astype(np.uint64))
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        if len(count) < len(key):
            cover, twice = np.zeros(len(start) + 5, np.int64), at[count[back] > 1]
            np.add.at(cover, twice, 1)
            np.add.at(cover, twice + 5, -1)
            repeated = np.bincount(of, np.cumsum(cover)[: len(start)] > 0, minlength=n).astype(np.int64)
    lines = [[x for x in r.split(b"\n") if x and x.strip(SPACE)] for r in raws]
    return (
        np.bincount(of, minlength=n), each(~space & (b & 0xC0 != 0x80)), each(_SYMBOL[b]), np.array([len(x) - len(set(x)) for x in lines], np.int64), repeated,
        np.bincount(of, letters, minlength=n).astype(np.int64),
    )


def scored(df: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ("doc_id",), order: int = charlm.ORDER) -> DataFrame:
    """The columns ``keep``, the base counts, and bits: bits a word under the model of the row's language."""
    kept = [named(k).alias(f"k{i}") for i, k in enumerate(keep)]
    table = blocks.stored(df.select(named(text_col).alias("_text"), named(lang_col).cast("string").alias("_lang"), *kept), "_text")
    model = settled(lambda: charlm.model(charlm.probabilities(written(charlm.count_grams(table, order)), order), order))
    arrow = to_arrow_schema(schema := fields(df, keep, f"{BASE}, bits double, _lang string"))

    def parts(body):
        for part in blocks.batches_of(body):
            yield part, *charlm.text_keys([t or "" for t in part.column(0).to_pylist()], part.column(1).to_pylist(), order)

    def keys_of(body):
        return charlm.distinct(keys for _, keys, _ in parts(body))

    def use(body, keys, values):
        found = blocks.Values(keys, values)
        for part, windows, lengths in parts(body):
            base = base_counts(part.column(0).to_pylist())
            sums = np.concatenate([[0.0], np.cumsum(found.of(windows), dtype=np.float64)])
            end = np.cumsum(lengths)
            bits = (sums[end - lengths] - sums[end]) / math.log(2) / np.maximum(1, base[5])
            yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(part.columns[2:], arrow, strict=False)], *[pa.array(c, pa.int64()) for c in base[:5]], pa.array(bits), part.column(1)], schema=arrow)

    return blocks.answered(table, keys_of, model, use, schema)


def bands(figures: DataFrame, width: float = WIDTH) -> DataFrame:
    """(_lang, mid, down, up): each language's median of bits and how far a long text may lie from it.

    Read from a histogram, so that one row per language and bin is all that is gathered.
    """
    from pyspark.sql import Window

    bins = figures.where(~F.col("base_failed")).groupBy("_lang", F.round(F.col("bits") / BIN).cast("long").alias("b")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("_lang")
    share = F.sum("n").over(w.orderBy("b")) / F.sum("n").over(w)
    at = lambda q: F.min(F.when(F.col("share") >= q, F.col("b"))) * BIN
    q = bins.withColumn("share", share).groupBy("_lang").agg(at(0.25).alias("q1"), at(0.5).alias("mid"), at(0.75).alias("q3"))
    return q.select("_lang", "mid", (width * F.greatest(F.col("mid") - F.col("q1"), F.lit(LEAST))).alias("down"), (width * F.greatest(F.col("q3") - F.col("mid"), F.lit(LEAST))).alias("up"))


def judge(figures: DataFrame, width: float = WIDTH) -> DataFrame:
    """figures and base_failed, kept."""
    x = written(figures.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")))
    b = few(written(bands(x, width))).withColumnRenamed("_lang", "_of")
    room = F.sqrt(1 + SHORT / F.greatest(F.col("n_words"), F.lit(1)))
    inside = (F.col("bits") >= F.col("mid") - F.col("down") * room) & (F.col("bits") <= F.col("mid") + F.col("up") * room)
    return x.join(b, x["_lang"].eqNullSafe(b["_of"]), "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop("_of", "mid", "down", "up")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, counts, base_failed, kept, bits, lang) of every document; odd rows go as the module says."""
    x = judge(settled(lambda: scored(documents(spark, sf_dir, "doc_id", "text", "lang"))))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits", F.col("_lang").alias("lang"))


QUERIES = {"op10_quality_rules": op10_quality_rules}
SQL: dict[str, str] = {}

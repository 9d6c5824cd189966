"""Language identification by language-bitmask n-gram filters.

Every letter of a text gives one n-gram: the letter in lower case, the two
characters before and the one after, where all but letters count as a space.  A
language's n-grams are those with at least ``SHARE`` of its uses, so at most 1 / SHARE
of them, counted over a sample of at most ``SAMPLE`` labelled documents a language
(those with the least hash of the id).  They are put into Bloom filters of one size,
which are bit-sliced: at each position stands a mask with a bit for each language, so
``HASHES`` gathers and an AND return all languages that contain an n-gram.

Per document and language the hits are counted, and corrected for false positives:
with fill f of a language's filter, an absent n-gram hits with f ** HASHES.  The
language with the largest corrected share wins; ties go to the first by code point.
The score is its part of all corrected shares.

A null text, or one without a letter, is ``und`` with score 0, as is everything if
there is no labelled text.  A text none of whose n-grams any language has ties at share 0: the first
language, with score 0.  Rows with a null language are never learned from.
Repeated rows, also of repeated or null ids, are predicted each; an id stands for all its rows in the sample.
A very long text is taken whole, in memory some 60 bytes a character.  Columns besides text and those kept are not looked at.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, fields, fold, mapped, mix, named, slices

SHARE, SAMPLE, HASHES, BITS = 2e-5, 4000, 3, 20
#: Fewest uses of an n-gram of a language's filter, whatever its share; 1 leaves the choice to SHARE.
FLOOR = 1.0
_SALTS = 64  # parts of a language's sample, ranked apart
_POWERS = np.array([pow(0xD1342543DE82EF95, i, 1 << 64) for i in range(4)], np.uint64)
_lower: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> itself in lower case if it is a letter, else a space."""
    if not _lower:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                table[c] = ord(low[0])
        _lower.append(table)
    return _lower[0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each letter of the texts, and the number of its text."""
    c = np.frombuffer("".join(["  " + t + " " for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _letters()[c]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 3
    at = np.flatnonzero(c != 32)
    x = c.astype(np.uint64)
    key = x[at] + x[at - 1] * _POWERS[1] + x[at - 2] * _POWERS[2] + x[at + 1] * _POWERS[3]
    return mix(key), np.searchsorted(np.cumsum(lengths), at, side="right")


def sample(labelled: DataFrame, id_col: str, lang_col: str, most: int = SAMPLE) -> DataFrame:
    """At most ``most`` rows a language, those with the least hash of the id in each of 64 parts."""
    part = F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(_SALTS))
    ranked = labelled.withColumn("_part", part).withColumn("_n", F.row_number().over(Window.partitionBy(lang_col, "_part").orderBy(F.xxhash64(id_col), id_col)))
    return ranked.where(F.col("_n") <= most // _SALTS).drop("_n", "_part")


def counted(texts: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, key, c): uses of each n-gram in each language."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.schema.names[0], 2 << 20):
                by: dict = {}
                for t, g in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    by.setdefault(g, []).append(t or "")
                for g, ts in by.items():
                    key, n = np.unique(ngrams(ts)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n, pa.int64())], ["lang", "key", "c"])

    return texts.select(text_col, lang_col).mapInArrow(run, "lang string, key bigint, c bigint").groupBy("lang", "key").agg(F.sum("c").alias("c"))


class Filters:
    """Bit-sliced Bloom filters of several languages."""

    def __init__(self, grams: dict[str, np.ndarray], bits: int = BITS, hashes: int = HASHES):
        self.langs, self.bits, self.hashes = sorted(grams), bits, hashes
        self.slices = np.zeros((max(1, -(-len(self.langs) // 8)), 1 << bits), np.uint8)
        for i, lang in enumerate(self.langs):
            for at in self._places(grams[lang].astype(np.uint64)):
                np.bitwise_or.at(self.slices[i // 8], at, np.uint8(1 << i % 8))
        fill = np.array([np.count_nonzero(self.slices[i // 8] >> (i % 8) & 1) / (1 << bits) for i in range(len(self.langs))])
        self.false = fill**hashes

    def _places(self, key: np.ndarray):
        for i in range(self.hashes):
            yield (key >> np.uint64(i * 20) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def masks(self, key: np.ndarray) -> list[np.ndarray]:
        """For each n-gram, the masks of the languages that contain it, eight languages an array."""
        places = list(self._places(key))
        return [np.bitwise_and.reduce([s[at] for at in places]) for s in self.slices]

    def shares(self, key: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each text, corrected share of each text's n-grams in each language)."""
        total = np.bincount(text, minlength=n)
        hits = np.zeros((n, 8 * len(self.slices)))
        unpacked = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(float)
        for i, mask in enumerate(self.masks(key)):
            counts = np.bincount(text * 256 + mask, minlength=n * 256).reshape(n, 256)
            hits[:, 8 * i : 8 * i + 8] = counts @ unpacked
        hits = hits[:, : len(self.langs)]
        some = np.maximum(total, 1)[:, None]
        return total, np.maximum(0, (hits / some - self.false) / np.maximum(1e-9, 1 - self.false))


def fit(texts: DataFrame, text_col: str, lang_col: str, share: float = SHARE) -> Filters:
    """Filters from labelled texts; what reaches the driver is at most 1 / share n-grams a language."""
    c = counted(texts, text_col, lang_col)
    uses = {r["lang"]: r["n"] for r in c.groupBy("lang").agg(F.sum("c").alias("n")).collect()}  # a row per language
    if not uses:
        return Filters({})
    least = F.create_map(*[x for g, n in uses.items() for x in (F.lit(g), F.lit(max(FLOOR, share * n)))])
    kept = c.where(F.col("c") >= least[F.col("lang")]).select("lang", "key").toArrow().to_pandas()
    return Filters({g: x["key"].to_numpy().view(np.uint64) for g, x in kept.groupby("lang")})


def predict(df: DataFrame, filters: Filters, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, lang_pred and score."""
    sent = df.sparkSession.sparkContext.broadcast(filters)  # 1 MB for each eight languages

    def each(part):
        f = sent.value
        key, text = ngrams([t or "" for t in part.column(0).to_pylist()])
        out: dict = {"lang_pred": ["und"] * part.num_rows, "score": np.zeros(part.num_rows)}
        if f.langs:
            total, share = f.shares(key, text, part.num_rows)
            best = share.argmax(1)
            out["lang_pred"] = [f.langs[b] if n else "und" for b, n in zip(best, total, strict=True)]
            out["score"] = np.where(total > 0, share.max(1) / np.maximum(share.sum(1), 1e-12), 0.0)
        return {k: part.column(i) for i, k in enumerate(keep, 1)} | out

    return mapped(df.select(named(text_col).alias("_text"), *map(named, keep)), each, fields(df, keep, "lang_pred string, score double"), "_text", 1 << 20)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; odd rows go as the module says."""
    held_out = fold(F.col("doc_id"), 3) == 1
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    learn = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = F.broadcast(sample(learn.select("doc_id", "lang"), "doc_id", "lang").select("doc_id").distinct())  # SAMPLE ids a language at most
    filters = fit(learn.join(ids, "doc_id", "left_semi"), "text", "lang")
    return predict(docs.select("doc_id", "text"), filters).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
SQL: dict[str, str] = {}

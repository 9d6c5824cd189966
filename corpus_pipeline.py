"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's docs.  All but the last return the columns
of documents.  Nothing is sampled or capped; every stage works on all that the stage before kept.

Rows are met again by their id and a hash of their content, so that repeated and
null ids do no harm: few such rows are broadcast, more are met in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import mixing, neardup, packing, quality_rules, secrets
from tidemill.llm.common import few, settled, shrink, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _met(rows: DataFrame) -> DataFrame:
    return few(written(rows))


def _content() -> Column:
    return F.xxhash64("text", "lang", "source")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: base rules and language-specific perplexity bands.

    Null and empty texts go, as they fail the base rules; equal rows go or stay together; a null language is one of its own.
    """
    docs = docs.select(*COLUMNS).withColumn("_h", _content())
    judged = quality_rules.judge(settled(lambda: quality_rules.scored(docs, keep=("doc_id", "_h"))))
    out = judged.where(~F.col("kept")).select(F.col("doc_id").alias("_i"), F.col("_h").alias("_o")).distinct()
    return docs.join(_met(out), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_o")), "left_anti").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five words, Jaccard 0.8); of equal rows one.

    Documents without words, and groups whose ids are all null, stay.
    """
    shrink(spark)
    docs = docs.select(*COLUMNS).withColumn("_h", _content())
    groups = neardup.jaccard_components(docs, "doc_id", "text", k=5, num=80, den=100, hash_col="_h")
    out = groups.where("not (doc_id <=> component_id)").select(F.col("doc_id").alias("_i"), F.col("_h").alias("_o")).distinct()
    kept = docs.join(_met(out), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_o")), "left_anti").select(*COLUMNS)
    twice = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"))
    if twice.isEmpty():
        return kept
    again = kept.join(_met(twice), "doc_id", "left_semi").select(*COLUMNS).dropDuplicates()
    return kept.join(_met(twice), "doc_id", "left_anti").select(*COLUMNS).unionByName(again)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars counts what is left, and is null for a null text."""
    shrink(spark)
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: weights 3, 1, 2 over the sources, 150% of all words, at most twice each.

    Documents without words are taken as the others of their source; those of a source without words are not.  Equal rows are
    taken alike, and so are all rows of a null id in a source; a null source is the last.
    """
    docs = docs.select(*COLUMNS).withColumns({"_n": mixing.size_of("text"), "_h": _content()})
    sizes = written(docs.select("doc_id", "source", F.col("_n").alias("size"), "_h"))
    mix = mixing.pareto_mix(sizes, "doc_id", "source", "size", mixing.WEIGHTS, mixing.SHARE, mixing.MOST)
    taken = mix.where("copies > 0").select(F.col("doc_id").alias("_i"), F.col("_h").alias("_o"), "copies").dropDuplicates(["_i", "_o"])
    both = docs.join(_met(taken), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_o")))
    return both.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, each mixed as all documents are; every row is packed, null texts as one closing token."""
    shrink(spark)
    return packing.pack(docs, "doc_id", "text", "source", packing.tokenizer_path())


STAGES = [
    ("quality_rules", keep_good),
    ("jaccard_join", one_of_each_group),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: Language models, redaction and tokens are no matter for SQL; tests hold every stage's rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs

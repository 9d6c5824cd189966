"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words; a source of size S and target T asks for
T / S copies of its documents on average, times a document's importance over its
source's mean.  Where that passes the most copies a document may have, the document is taken as often as that for
certain, and what it can't take is shared out among the others by importance, until none is above.  The whole part of each number is taken for certain.  What is left
is an inclusion probability; the documents of a source are ranked by

    (u / (1 - u)) / (p / (1 - p)),

random odds over inclusion odds (Rosen 1997), and taken in that order until the
remaining words of the target are reached; the document at the edge is taken if that
comes nearer.  The sample's size in words is thus fixed, and its inclusion probabilities follow p.
u is read from the md5 of seed and id, so reruns agree whatever the partitioning.

No source is gathered in one task: the place of the edge is found in two
histograms of the rank (one row per source and bin), and only the rows of the last bin,
about one in 16 million of a source, are sorted, those of one id as one row.  The tables that are
broadcast have a row for each source; their targets are found in one task.

Null texts have size 0, sources may be null (the last source), ids may repeat
(rows of one id and importance are taken or left alike) or be null (they count as one id).  A null or negative
importance is 0: such rows are not taken.  Sources without words, or of importance 0, get no documents.  A null size is 0.
Columns of the caller's may have any names; its own source_size, target and copies are replaced.  An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, named, written

WORD = r"[^\x20\x09-\x0D]+"
#: Most sources whose table is broadcast; beyond, it is joined by shuffles that split hot sources.
BROADCAST = 100_000


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _with_sources(df: DataFrame, sources: DataFrame, n: int, *columns: str) -> DataFrame:
    """df with columns of its source's row, null sources included."""
    other = sources.select(F.col("source").alias("_of"), *columns)
    return df.join(F.broadcast(other) if n <= BROADCAST else other, df["source"].eqNullSafe(other["_of"])).drop("_of")


def targets(sizes: DataFrame, source_col: str, size_col: str, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(_source, _size, _target) of each source: ``share`` of all words by the repeating weights, at most ``most`` times the source's size.

    What a source can't take goes to the others by weight, until none is above its bound: all but the first sources by bound over weight get the same number of words a unit of weight.
    """
    s = sizes.groupBy(F.col(source_col).alias("_source")).agg(F.sum(size_col).alias("_size"))
    # one row per source from here on
    by_name = Window.orderBy(F.col("_source").cast("binary").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("_w", w.cast("long")).withColumn("_bound", F.col("_size") * F.lit(most))
    order = Window.orderBy(F.col("_bound") / F.col("_w"), F.col("_source").cast("binary").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumns({"_left": F.lit(share) * F.sum("_size").over(whole) - F.coalesce(F.sum("_bound").over(before), F.lit(0.0)), "_rest": F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0))})
    s = s.withColumn("_level", F.col("_left") / F.col("_rest"))
    # the level of the first source whose bound the level doesn't pass holds for it and all after it
    level = F.min(F.when(F.col("_level") <= F.col("_bound") / F.col("_w"), F.struct(F.col("_bound") / F.col("_w"), "_level"))).over(whole)["_level"]
    return s.withColumn("_at", level).select("_source", "_size", F.least("_bound", F.coalesce(F.col("_at") * F.col("_w"), F.col("_bound"))).alias("_target"))


def _levels(rows: DataFrame, goal: DataFrame, most: int) -> DataFrame:
    """goal with level: a row of importance i asks for least(most, level * i) copies, and a source's rows for its target's words.

    Each round holds the rows at ``most`` and raises the level of the others, until no source changes.
    """
    sums = rows.groupBy(F.col("source").alias("_x")).agg(F.sum(F.col("i") * F.col("size")).alias("_all"))
    goal = written(goal.join(sums, F.col("source").eqNullSafe(F.col("_x"))).select("source", "size", "target", F.coalesce(F.try_divide(F.col("target"), F.col("_all")), F.lit(0.0)).alias("level")))
    n = goal.count()
    while True:
        x = _with_sources(rows.select("source", F.col("size").alias("n"), "i"), goal, n, "level")
        over = F.col("level") * F.col("i") > most
        again = x.groupBy(F.col("source").alias("_x")).agg(F.sum(F.when(over, F.col("n")).otherwise(0)).alias("_held"), F.sum(F.when(over, 0.0).otherwise(F.col("i") * F.col("n"))).alias("_free"))
        level = F.when((F.col("_held") > 0) & (F.col("_free") > 0), F.greatest(F.col("level"), (F.col("target") - most * F.col("_held")) / F.col("_free"))).otherwise(F.col("level"))
        new = written(goal.join(again, F.col("source").eqNullSafe(F.col("_x"))).select("source", "size", "target", level.alias("level"), (level > F.col("level") * (1 + 1e-9)).alias("_up")))
        goal = new.drop("_up")
        if new.where("_up").isEmpty():
            return goal


def pareto_mix(df: DataFrame, id_col: str, source_col: str, size_col: str, weights: tuple[int, ...], share: float, most: int, seed: str = "", importance: Column | None = None) -> DataFrame:
    """df with source_size, target and copies: how many times the mix takes each row."""
    own = [c for c in df.columns if c not in ("source_size", "target", "copies")]
    i = F.lit(1.0) if importance is None else F.greatest(F.lit(0.0), F.coalesce(importance.cast("double"), F.lit(0.0)))
    rows = df.select(F.struct(*[named(c) for c in own]).alias("row"), named(id_col).alias("id"), named(source_col).alias("source"), F.coalesce(named(size_col), F.lit(0)).cast("long").alias("size"), i.alias("i"))
    goal = written(targets(rows, "source", "size", weights, share, most).select(F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_target").alias("target")))
    n = goal.count()
    if importance is None:
        goal = goal.withColumn("level", F.coalesce(F.try_divide(F.col("target"), F.col("size").cast("double")), F.lit(0.0)))
    else:
        goal = _levels(rows, goal, most)
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = _with_sources(rows, goal.withColumnRenamed("size", "source_size"), n, "source_size", "target", "level")
    asked = F.least(F.lit(float(most)), F.col("level") * F.col("i"))
    rows = rows.withColumn("asked", asked).withColumn("whole", F.floor("asked")).withColumn("p", F.col("asked") - F.col("whole")).withColumn("u", u)
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rows = written(rows.withColumn("q", F.when(F.col("p") > 0, odds)).withColumn("b", F.floor(F.col("q") / (1 + F.col("q")) * float(1 << 24))).drop("i", "asked", "p", "u", "level"))
    # words that are still to be taken of each source
    rest = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("rest"))
    ranked = rows.where("q is not null").select("source", "id", F.col("size").alias("n"), "q", "b")

    def edge(of: DataFrame, known: DataFrame, bin_: Column) -> DataFrame:
        """The bin of each source in which the words reach rest, and the words before it."""
        bins = of.groupBy("source", bin_.alias("bin")).agg(F.sum("n").alias("n"))
        bins = bins.withColumnRenamed("source", "_x").join(known, F.col("_x").eqNullSafe(F.col("source"))).drop("_x")
        after = F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("bin"))
        return bins.withColumn("after", after).where("after >= rest and after - n < rest").select("source", "rest", "bin", (F.col("after") - F.col("n")).alias("before"))

    def inside(edges: DataFrame, bin_: Column) -> DataFrame:
        e = edges.select(F.col("source").alias("_x"), F.col("bin").alias("_y"))
        return ranked.join(F.broadcast(e) if n <= BROADCAST else e, ranked["source"].eqNullSafe(F.col("_x")) & (bin_ == F.col("_y")), "left_semi")

    coarse = F.shiftright(F.col("b"), 12)
    one = written(edge(ranked, rest.withColumn("before", F.lit(0)), coarse))
    two = written(edge(inside(one, coarse), one.select("source", "rest", "before"), F.col("b")))
    last = inside(two, F.col("b")).groupBy(F.col("source").alias("_x"), "q", "id").agg(F.sum("n").alias("n")).join(two, F.col("_x").eqNullSafe(F.col("source"))).drop("_x")
    sums = F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("q", "id"))
    stop = last.withColumn("sum", sums).where("2 * sum - n <= 2 * rest").groupBy("source").agg(F.max(F.struct("q", "id")).alias("stop"))
    # sources whose rows all fit have no edge
    mark = rest
    for table, column, name in ((two, "bin", "fine"), (stop, "stop", "stop"), (one, "bin", "coarse")):
        mark = mark.join(table.select(F.col("source").alias("_x"), F.col(column).alias(name)), F.col("source").eqNullSafe(F.col("_x")), "left").drop("_x")
    out = _with_sources(rows, written(mark), n, "rest", "coarse", "fine", "stop")
    place = F.struct("q", "id")
    upto = (
        F.when(F.col("q").isNull() | (F.col("rest") <= 0), False)
        .when(F.col("coarse").isNull(), True)
        .when(coarse != F.col("coarse"), coarse < F.col("coarse"))
        .when(F.col("fine").isNull() | (F.col("b") != F.col("fine")), F.coalesce(F.col("b") < F.col("fine"), F.lit(False)))
        .otherwise(F.coalesce(place <= F.col("stop"), F.lit(False)))
    )
    return out.select("row.*", "source_size", "target", (F.col("whole") + upto.cast("long")).alias("copies"))


WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document; odd rows go as the module says."""
    sizes = written(documents(spark, sf_dir, "doc_id", "source", "text").select("doc_id", "source", size_of("text").alias("size")))
    mix = pareto_mix(sizes, "doc_id", "source", "size", WEIGHTS, SHARE, MOST)
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op1_source_mix": op1_source_mix}
SQL = {
    "op1_source_mix": r"""
WITH d AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, source_size * 2.0::DOUBLE AS bound FROM s),
l AS (SELECT *, bound / w AS ratio,
        (1.5::DOUBLE * sum(source_size) OVER () - COALESCE(sum(bound) OVER (ORDER BY bound / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(w) OVER () - COALESCE(sum(w) OVER (ORDER BY bound / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
t AS (SELECT source, source_size, least(bound, COALESCE((SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) * w, bound)) AS target FROM l),
p AS (SELECT d.*, source_size, target, target / source_size AS asked, floor(least(2.0, target / source_size)) AS whole,
        (CAST('0x' || substr(md5(':' || doc_id::VARCHAR), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE source_size > 0),
q AS (SELECT *, CASE WHEN asked > whole THEN (u / (1 - u)) / ((asked - whole) / (1 - (asked - whole))) END AS q FROM p),
r AS (SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS rest,
        sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q, doc_id) AS upto FROM q)
SELECT doc_id, size, source_size, target,
  ((whole + CASE WHEN q IS NOT NULL AND rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r
UNION ALL SELECT doc_id, size, source_size, 0.0::DOUBLE, 0 FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE source_size = 0
"""
}

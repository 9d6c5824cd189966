"""Alert models: static bands, robust scaling, isolation forest.

Fits are aggregates (one job, a row of results); the forest is built from a sample of
fixed size per tree, tree by tree in parallel, and is a table of nodes whose size
does not depend on the data; scoring is a vectorised pass over Arrow batches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..errors import NonFiniteEligibleInputError, TrainOnlyError


def _only_train(frame: DataFrame, split: str) -> tuple[DataFrame, Column]:
    """The eligible rows, and an aggregate that counts rows of other splits: the fit's own job tells whether it was allowed."""
    other = F.col("split").eqNullSafe(F.lit(split)) if "split" in frame.columns else F.lit(True)
    marked = frame.withColumn("_other", ~other).where(F.col("eligible") | F.col("_other"))
    return marked, F.count_if("_other").alias("_others")


def _allowed(got, split: str) -> None:
    if got["_others"]:
        raise TrainOnlyError(f"a fit takes rows of {split} alone")
    if not got["n"]:
        raise TrainOnlyError("no eligible training rows")


def guarded(value: Column, name: str) -> Column:
    """value, which must be finite."""
    return F.when(F.abs(value) < float("inf"), value).otherwise(F.raise_error(F.lit(f"{name} is not finite on an eligible row")))


def train_mean_std(frame: DataFrame, columns: list[str], split: str = "train") -> dict[str, tuple[float, float]]:
    """Population mean and deviation of columns over eligible training rows, pooled over assets."""
    rows, others = _only_train(frame, split)
    aggs = [f(c).alias(f"{c}__{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    got = rows.agg(F.count("*").alias("n"), others, *[F.count_if(~F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))).alias(f"{c}__bad") for c in columns], *aggs).first()
    _allowed(got, split)
    if any(got[f"{c}__bad"] for c in columns):
        raise NonFiniteEligibleInputError("a training value is missing or not finite")
    return {c: (got[f"{c}__mean"], got[f"{c}__std"]) for c in columns}


def static_threshold_alert(frame: DataFrame, bands: dict[str, tuple[float, float]], k: float) -> DataFrame:
    """frame with alert: an eligible row with some column strictly outside mean +- k * std."""
    if not math.isfinite(k) or not all(math.isfinite(x) for b in bands.values() for x in b):
        raise NonFiniteEligibleInputError("k and bands must be finite")
    out = F.lit(False)
    for c, (mean, std) in bands.items():
        x = F.when(F.col("eligible"), guarded(F.col(c), c))
        out |= F.coalesce((x < mean - k * std) | (x > mean + k * std), F.lit(False))
    return frame.withColumn("alert", F.col("eligible") & out)


def static_candidates(frame: DataFrame, bands: dict[str, tuple[float, float]], ks: list[float]) -> DataFrame:
    """frame once per k, with candidate_id, strictness and alert: one plan for all candidates."""
    worst = F.greatest(*[F.abs(F.col(c) - m) / s if s else F.when(F.col(c) == m, 0.0).otherwise(float("inf")) for c, (m, s) in bands.items()], F.lit(0.0))
    x = frame.withColumn("_z", F.when(F.col("eligible"), worst)).withColumn("strictness", F.explode(F.array(*[F.lit(float(k)) for k in ks])))
    return x.withColumn("candidate_id", F.concat(F.lit("k"), F.regexp_replace(F.col("strictness").cast("string"), r"\.0$", ""))).withColumn("alert", F.coalesce(F.col("_z") > F.col("strictness"), F.lit(False)))


@dataclass(frozen=True)
class Scaler:
    """Median and interquartile range of each kept column, and the columns without spread."""

    center: dict[str, float]
    scale: dict[str, float]
    dropped: tuple[str, ...]
    rows: int

    @property
    def columns(self) -> list[str]:
        return list(self.center)


def fit_scaler(frame: DataFrame, columns: list[str], epsilon: float = DEFAULT["iqr_epsilon"], split: str = "train") -> Scaler:
    """Exact quartiles over eligible training rows; columns with a range up to epsilon are dropped."""
    rows, others = _only_train(frame, split)
    got = rows.agg(F.count("*").alias("n"), others, *[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in columns]).first()
    _allowed(got, split)
    kept = {c: got[c] for c in columns if got[c] and got[c][2] - got[c][0] > epsilon}
    return Scaler({c: q[1] for c, q in kept.items()}, {c: q[2] - q[0] for c, q in kept.items()}, tuple(c for c in columns if c not in kept), got["n"])


def scaled(frame: DataFrame, scaler: Scaler) -> DataFrame:
    return frame.withColumns({c: (F.col(c) - scaler.center[c]) / scaler.scale[c] for c in scaler.columns})


def _expected(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass(frozen=True)
class Forest:
    """Isolation forest as arrays (tree, node): feature (-1: leaf), cut, children, and a leaf's depth."""

    columns: tuple[str, ...]
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    depth: np.ndarray
    sample: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean depth / expected depth): near 1 for what is cut off early."""
        total = np.zeros(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t, node]
                go = np.flatnonzero(f >= 0)
                if not len(go):
                    break
                n = node[go]
                node[go] = self.child[t, n] + (x[go, f[go]] >= self.cut[t, n])
            total += self.depth[t, node]
        return 2.0 ** (-total / max(1, len(self.feature)) / max(_expected(self.sample), 1e-12))


def _tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[list, list, list, list]:
    feature, cut, child, depth = [-1], [0.0], [0], [0.0]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, level = todo.pop()
        low, high = x[rows].min(0), x[rows].max(0)
        wide = np.flatnonzero(high > low)
        if level >= limit or len(rows) <= 1 or not len(wide):
            depth[node] = level + _expected(len(rows))
            continue
        f = int(rng.choice(wide))
        c = float(rng.uniform(low[f], high[f]))
        if c <= low[f]:
            c = float(high[f])
        at = len(feature)
        feature[node], cut[node], child[node] = f, c, at
        for right in (0, 1):
            feature.append(-1)
            cut.append(0.0)
            child.append(0)
            depth.append(0.0)
            todo.append((at + right, rows[(x[rows, f] >= c) == bool(right)], level + 1))
    return feature, cut, child, depth


def fit_isolation_forest(frame: DataFrame, columns: list[str], order: list[str], trees: int = 200, sample: int = 256, seed: int = 7, split: str = "train") -> Forest:
    """A forest from eligible training rows (Liu, Ting and Zhou 2008).

    Each tree takes the ``sample`` rows with the least hash of (seed, tree, key columns ``order``),
    so neither partitioning nor row order changes it, and no more than that reaches a tree.
    """
    rows, others = _only_train(frame, split)
    got = rows.agg(F.count("*").alias("n"), others).first()
    _allowed(got, split)
    n = got["n"]
    rows = rows.select(*order, *[guarded(F.col(c), c).alias(c) for c in columns])
    # a row is a candidate of a tree with a probability that leaves three times the sample; the least hashes of these are the least of all
    share = min(1.0, 3.0 * sample / n + 20.0 / n)
    h = lambda tree: F.xxhash64(F.lit(seed), tree, *order)
    # the trees that may take a row are found before it is copied for each of them; most rows of a large frame have none
    mine = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: (F.shiftright(h(tree), 11) / float(1 << 52) + 1) / 2 < share)
    near = rows.withColumn("_mine", mine).where(F.size("_mine") > 0).withColumn("tree", F.explode("_mine")).drop("_mine").withColumn("_h", h(F.col("tree")))
    limit = math.ceil(math.log2(max(2, sample)))
    names = list(columns)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", *order]).head(sample)
        t = int(pdf["tree"].iloc[0])
        got = _tree(pdf[names].to_numpy(float), np.random.default_rng([seed, t]), limit)
        return pd.DataFrame({"tree": t, "node": np.arange(len(got[0])), "feature": got[0], "cut": got[1], "child": got[2], "depth": got[3]})

    nodes = near.groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, cut double, child int, depth double").toPandas()  # at most trees * 2 * sample rows
    shape = (trees, int(nodes["node"].max()) + 1)
    arrays = [np.full(shape, -1, np.int64), np.zeros(shape), np.zeros(shape, np.int64), np.zeros(shape)]
    for a, name in zip(arrays, ("feature", "cut", "child", "depth"), strict=True):
        a[nodes["tree"], nodes["node"]] = nodes[name]
    return Forest(tuple(columns), *arrays, min(sample, n))


def anomaly_scores(frame: DataFrame, forest: Forest, name: str = "score", scaler: Scaler | None = None) -> DataFrame:
    """frame with the score of eligible rows, NULL elsewhere.

    With a scaler, rows are scaled on the way in: as columns of their own, dozens of aliases
    under one filter make the optimizer's inference of constraints explode.
    """
    sent = frame.sparkSession.sparkContext.broadcast(forest)  # trees * nodes numbers, whatever the data's size
    columns = [(F.col(c) - scaler.center[c]) / scaler.scale[c] if scaler else F.col(c) for c in forest.columns]

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float) for c in cols], 1)
        ok = np.isfinite(x).all(1)
        out = np.full(len(x), np.nan)
        out[ok] = sent.value.score(x[ok])
        return pd.Series(out)

    return frame.withColumn(name, F.when(F.col("eligible"), guarded(score(*columns), name)))


def score_thresholds(scores: DataFrame, quantiles: list[float], name: str = "score") -> list[float]:
    """Exact quantiles of the scores of eligible rows."""
    got = scores.where("eligible").agg(F.percentile(name, F.array(*[F.lit(q) for q in quantiles]))).first()[0]
    if not got or not all(map(math.isfinite, got)):
        raise NonFiniteEligibleInputError("no finite thresholds")
    return list(got)


def score_alert(frame: DataFrame, threshold: float, name: str = "score") -> DataFrame:
    """frame with alert: an eligible row whose score is strictly over the threshold."""
    if not math.isfinite(threshold):
        raise NonFiniteEligibleInputError("the threshold must be finite")
    return frame.withColumn("alert", F.col("eligible") & F.coalesce(F.col(name) > threshold, F.lit(False)))

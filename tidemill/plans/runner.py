"""The whole evaluation: select on validation, then score test strata one by one.

Candidates are a column, not a loop: every k, and every forest threshold, is a row of
one plan that is grouped by candidate, split and asset.
"""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, SENSORS, fingerprint
from ..errors import LockedSeedsError, SelectionIntegrityError
from ..operators import episodes, features, models
from ..sources import generator

KEYS = ["split", "asset"]
CHANNELS = ["equipment", "data"]


def dataset_features(data: dict[str, DataFrame], cfg: dict = DEFAULT) -> DataFrame:
    """Feature windows of all strata; nothing crosses from split to split."""
    out = None
    for s in data["splits"].collect():  # three rows
        here = F.col("split") == s["split"]
        part = features.features(data["readings"].where(here), KEYS, "ts_epoch", s["start"], s["end"], SENSORS, cfg, declared=data["strata"].where(here), strict=True)
        out = part if out is None else out.unionByName(part)
    return out


def guard(windows: DataFrame, data: dict[str, DataFrame], cfg: dict = DEFAULT) -> None:
    """Refuse splits that overlap, windows that aren't the whole grid of their split, alerts where there is no score, and events that have
    no stratum here, occur twice or pass their split's end."""
    spans = {r["split"]: (r["start"], r["end"]) for r in data["splits"].collect()}  # three rows
    episodes.validate_splits(spans)
    episodes.validate(windows, KEYS, cfg["window_s"], spans)
    here = windows.select(*KEYS).distinct()
    episodes.validate_labels(data["fault_events"].join(here.select("split").distinct(), "split", "left_semi"), here, KEYS, spans, cfg["tail_s"])


def with_flags(windows: DataFrame, data: dict[str, DataFrame]) -> DataFrame:
    return episodes.flagged(episodes.flagged(windows, data["planned_stops"], KEYS, "in_stop"), data["normal_changes"], KEYS, "in_change")


def _scores(windows: DataFrame, labels: DataFrame, by: list[str], cfg: dict) -> DataFrame:
    each = labels.join(windows.select(*by).distinct(), [k for k in by if k in labels.columns]) if len(by) > 2 else labels
    return episodes.event_scores(windows, each, by, cfg["window_s"], cfg["gap_s"], cfg["tail_s"], tuple(cfg["delay_quantiles"]))


def identity(selection: dict) -> str:
    return hashlib.sha256(json.dumps({k: v for k, v in selection.items() if k != "identity"}, sort_keys=True, default=str).encode()).hexdigest()


def _chosen(candidates: DataFrame, cap: float) -> dict:
    rows = [r.asDict() for r in episodes.select_candidate(candidates, cap).orderBy("candidate_id").collect()]  # a row per candidate
    best = next((r for r in rows if r["selected"]), None)
    return {"selected": best and best["candidate_id"], "strictness": best and best["strictness"], "candidates": rows}


def select(data: dict[str, DataFrame], frames: DataFrame, cfg: dict = DEFAULT, fit_on_scaled: bool = True) -> tuple[dict, dict]:
    """(selection, fitted): thresholds chosen on validation alone.  fit_on_scaled=False fits the forest on unscaled rows but scores scaled ones."""
    train, val = frames.where("split = 'train'"), frames.where("split = 'validation'")
    columns = features.feature_columns(SENSORS, cfg["frames"], f"{cfg['window_s']}s")
    features.assert_no_leak(columns, columns, cfg["deny"])
    means = [f"{s}__mean_5m" for s in SENSORS]
    bands = models.train_mean_std(train, means)
    scaler = models.fit_scaler(train, columns, cfg["iqr_epsilon"])
    f = cfg["forest"]
    rows = models.scaled(train, scaler) if fit_on_scaled else train
    forest = models.fit_isolation_forest(rows, scaler.columns, [*KEYS, "window_start"], f["trees"], f["sample"], f["seed"])
    thresholds = models.score_thresholds(models.anomaly_scores(train, forest, scaler=scaler if fit_on_scaled else None), f["quantiles"])
    by = ["candidate_id", "strictness", *KEYS]
    guard(episodes.no_alert(val), data, cfg)
    flagged = with_flags(val, data)
    static = models.static_candidates(flagged, bands, cfg["static_k"])
    scored = models.anomaly_scores(flagged, forest, scaler=scaler)
    levels = F.explode(F.array(*[F.struct(F.lit(f"q{q}").alias("candidate_id"), F.lit(t).alias("strictness")) for q, t in zip(f["quantiles"], thresholds, strict=True)]))
    wooded = scored.withColumn("_c", levels).select("*", "_c.*").drop("_c")
    wooded = wooded.withColumn("alert", F.col("eligible") & F.coalesce(F.col("score") > F.col("strictness"), F.lit(False)))
    labels = data["fault_events"]
    out = {"config": fingerprint(cfg), "scaler": {"rows": scaler.rows, "dropped": scaler.dropped}, "bands": bands, "thresholds": thresholds}
    for name, x in (("static_threshold", static), ("isolation_forest", wooded)):
        pooled = episodes.pool(_scores(x, labels, by, cfg), ["candidate_id", "strictness"])
        out[name] = _chosen(pooled.select("candidate_id", "strictness", "tp", "fp", "fn", "false_alerts_per_operating_hour", F.col("episodes").alias("total_alerts")), cfg["cap_per_hour"])
    out["identity"] = identity(out)
    return out, {"bands": bands, "scaler": scaler, "forest": forest}


def score_test(selection: dict, fitted: dict, data: dict[str, DataFrame], frames: DataFrame, cfg: dict = DEFAULT) -> dict[str, DataFrame]:
    """Event and window scores of each test stratum under each selected model; refuses a selection that was changed."""
    if identity(selection) != selection["identity"]:
        raise SelectionIntegrityError("the selection isn't the one that was made")
    test = with_flags(frames.where("split = 'test'"), data)
    labels = data["fault_events"].where("split = 'test'")
    guard(episodes.always_alert(test), data, cfg)
    out = {}
    for name in ("static_threshold", "isolation_forest"):
        s = selection[name]
        if s["selected"] is None:
            continue
        if s["selected"] == "no_alert" or math.isinf(s["strictness"]):
            alerts = episodes.no_alert(test)
        elif name == "static_threshold":
            alerts = models.static_threshold_alert(test, fitted["bands"], s["strictness"])
        else:
            alerts = models.score_alert(models.anomaly_scores(test, fitted["forest"], scaler=fitted["scaler"]), s["strictness"])
        out[f"{name}_report"] = episodes.stratum_report(alerts, labels, KEYS, cfg["window_s"], cfg["gap_s"], cfg["tail_s"], CHANNELS, tuple(cfg["delay_quantiles"]))
        out[f"{name}_events"] = _scores(alerts, labels, KEYS, cfg)
        out[f"{name}_points"] = episodes.point_scores(alerts, labels, KEYS, cfg["window_s"], CHANNELS)
    for name, f in (("no_alert", episodes.no_alert), ("always_alert", episodes.always_alert)):
        out[f"{name}_events"] = _scores(f(test), labels, KEYS, cfg)
    return out


def run(spark: SparkSession, table: str = "dev", cfg: dict = DEFAULT, allow_locked: bool = False) -> dict:
    """Generate, select, score: {table, config, dataset, selection, prevalence, test}.  The locked table is for one evaluation and is refused here."""
    if allow_locked:
        raise LockedSeedsError("a run never takes the locked table")
    data = generator.generate(spark, table, cfg)
    data["readings"] = data["readings"].cache()
    frames = dataset_features(data, cfg).cache()
    selection, fitted = select(data, frames, cfg)
    return {"table": table, "config": fingerprint(cfg), "dataset": generator.digest(data["readings"]), "selection": selection, "prevalence": generator.prevalence_report(data, cfg), "test": score_test(selection, fitted, data, frames, cfg)}

import json

import pytest

from tidemill.config import DEFAULT, fingerprint, load
from tidemill.errors import ArtifactExistsError
from tidemill.plans import artifacts, demo


def test_artifacts(tmp_path):
    p = artifacts.write_once(tmp_path / "a/x.json", {"b": 1})
    assert json.loads(p.read_text()) == {"b": 1}
    with pytest.raises(ArtifactExistsError):
        artifacts.write_once(p, {"b": 2})


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"gap_s": 30, "forest": {"trees": 5}}')
    cfg = load(str(tmp_path / "c.json"))
    assert cfg["gap_s"] == 30 and cfg["forest"] == DEFAULT["forest"] | {"trees": 5} and fingerprint(cfg) != fingerprint(DEFAULT) and load() == DEFAULT


def test_demo(spark, tmp_path):
    cfg = DEFAULT | {"forest": DEFAULT["forest"] | {"trees": 20}}
    got = demo.seed(spark, str(tmp_path), 1, cfg=cfg)
    assert got["counts"]["accepted"] > 3400 and got["counts"]["bad_payload"] == 0
    v = demo.view(spark, str(tmp_path), "LINE_A.FILLER")
    assert v["readings"].count() == 500 and v["ingest"].first()["accepted"] == got["counts"]["accepted"] and v["sensors"].count() == 2000


@pytest.fixture(scope="module")
def small(spark):
    """Three days of a line, generated once; its readings and features are kept."""
    from tidemill.plans import runner
    from tidemill.sources import generator

    cfg = DEFAULT | {"splits": {"dev": {"start": "2023-09-04", "train": [1], "validation": [2], "test": [3]}}, "forest": DEFAULT["forest"] | {"trees": 10, "sample": 64}, "static_k": [2, 4]}
    data = generator.generate(spark, "dev", cfg)
    data["readings"] = data["readings"].cache()
    frames = runner.dataset_features(data, cfg).cache()
    return cfg, data, frames


def test_prevalence_report(small):
    from tidemill.sources import generator

    cfg, data, _ = small
    got = generator.prevalence_report(data, cfg)
    events = data["fault_events"].collect()
    faults = {(r["split"], r["fault_type"]): r for r in got["faults"].collect()}
    assert set(faults) == {(s, k) for s in ("train", "validation", "test") for k in cfg["faults"]}
    for (split, kind), r in faults.items():
        own = [e for e in events if (e["split"], e["fault_type"]) == (split, kind)]
        assert r["events"] == len(own) and r["by_asset"] == {a: sum(e["asset"] == a for e in own) for a in cfg["split_assets"][split]}
        assert r["events_per_asset_day"] == len(own) / 2 and r["fraction_of_asset_days_with_event"] == len({(e["asset"], e["date"]) for e in own}) / 2
        assert (r["channel"], [r["rule"], r["rule_value"]]) == (cfg["faults"][kind][1], cfg["faults"][kind][3])
    for r in got["splits"].collect():
        assert (r["days"], r["assets"], r["asset_days"]) == (1, sorted(cfg["split_assets"][r["split"]]), 2)
        assert abs(r["missing_jitter_rate_realised"] - r["missing_jitter_rate_declared"]) < 0.001
        seconds = {c: sum(e["end"] - e["onset"] for e in events if e["split"] == r["split"] and e["channel"] == c) for c in ("equipment", "data")}
        assert r["fault_seconds_fraction"] == pytest.approx({c: n / 2 / 86400 for c, n in seconds.items()})
    assert generator.digest(data["fault_events"]) == generator.digest(data["fault_events"].repartition(3)) != generator.digest(data["fault_events"].limit(1))


def test_reports_of_a_run(small):
    """Every name that a stratum's report must have, and numbers that agree with one another."""
    from tidemill.plans import runner

    cfg, data, frames = small
    selection, fitted = runner.select(data, frames, cfg)
    out = runner.score_test(selection, fitted, data, frames, cfg)
    for name in ("static_threshold", "isolation_forest"):
        if selection[name]["selected"] is None:
            assert f"{name}_report" not in out
            continue
        rows = out[f"{name}_report"].collect()
        assert {(r["split"], r["asset"]) for r in rows} == {("test", a) for a in cfg["split_assets"]["test"]}
        for r in rows:
            e, p = r["event_level"], r["point_level"]
            assert set(e.asDict()) == {
                "tp", "fp", "fn", "precision", "recall", "f1", "events", "episodes", "precision_kind", "recall_by_fault_type", "recall_by_channel", "false_alerts_operating", "operating_hours_observed_eligible",
                "false_alerts_per_operating_hour", "planned_stop", "unseen_normal_change", "alert_active_fraction_operating", "delay", "match_table", "episodes_table",
            }
            assert set(e["planned_stop"].asDict()) == {"unmatched_episodes", "episodes_starting", "observed_hours", "false_alerts_per_observed_hour"}
            assert set(e["unseen_normal_change"].asDict()) == {"unmatched_episodes", "alert_active_seconds", "observed_hours", "false_alerts_per_observed_hour"}
            assert set(e["delay"].asDict()) == {"matched_events", "events", "miss_rate", "p50", "p90", "quantile_method"}
            assert set(p) == {"equipment", "data"} and set(p["data"].asDict()) == {
                "tp", "fp", "fn", "tn", "precision", "recall", "f1", "eligible_windows", "eligible_positive_windows", "excluded_windows", "excluded_positive_windows", "excluded_by_reason", "coverage",
            }
            assert r["windows_total"] == 8640 and len(e["match_table"]) == e["events"] == e["tp"] + e["fn"] and len(e["episodes_table"]) == e["episodes"]
            assert sum(x["matched_event"] is not None for x in e["episodes_table"]) == e["tp"]
            assert sum(x["windows"] for x in p["data"]["excluded_by_reason"].values()) == p["data"]["excluded_windows"]
            assert sum(x["events"] for x in e["recall_by_channel"].values()) == e["events"]


def test_a_run_refuses_what_it_can_not_score(spark, small):
    from pyspark.sql import functions as F

    from tidemill.errors import InputError, LockedSeedsError, SplitOverlapError
    from tidemill.operators import episodes
    from tidemill.plans import runner

    cfg, data, frames = small
    windows = episodes.no_alert(frames)
    runner.guard(windows, data, cfg)
    first = windows.agg(F.min("window_start")).first()[0]
    for bad in (windows.where(f"window_start != {first + 500}"), windows.unionByName(windows.limit(1)), windows.withColumn("alert", ~F.col("eligible")), windows.where(f"window_start > {first}"), windows.limit(0)):
        with pytest.raises(InputError):
            runner.guard(bad, data, cfg)
    e = data["fault_events"]
    for labels in (e.unionByName(e.limit(1)), e.withColumn("asset", F.lit("NONE")), e.withColumn("end", F.col("end") + 86400)):
        with pytest.raises(InputError):
            runner.guard(windows, data | {"fault_events": labels}, cfg)
    with pytest.raises(SplitOverlapError):
        runner.guard(windows, data | {"splits": data["splits"].withColumn("end", F.col("end") + 10)}, cfg)
    with pytest.raises(InputError):
        runner.select(data | {"fault_events": e.withColumn("asset", F.lit("NONE"))}, frames, cfg)
    with pytest.raises(LockedSeedsError):
        runner.run(spark, allow_locked=True)

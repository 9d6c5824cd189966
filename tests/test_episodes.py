import pytest

from tidemill.errors import InputError, PoolingError, SplitOverlapError
from tidemill.operators import episodes as E

S, N = 1700006400, 2160
KEYS = ["split", "asset"]


def windows(spark, alerts=(), ineligible=(), split="validation"):
    on = {(a - a % 10) for lo, hi in alerts for a in range(lo, hi, 10)}
    off = {a for lo, hi in ineligible for a in range(lo, hi, 10)}
    rows = [(split, "A", S + 10 * i, 10 * i not in off, 10 * i in on and 10 * i not in off, "dropout" if 10 * i in off else "") for i in range(N)]
    df = spark.createDataFrame(rows, "split string, asset string, window_start bigint, eligible boolean, alert boolean, dq_reason string")
    return df


def intervals(spark, rows):
    return spark.createDataFrame([("validation", "A", S + a, S + b) for a, b in rows], "split string, asset string, start bigint, end bigint")


def flagged(spark, w, stops=(), changes=()):
    return E.flagged(E.flagged(w, intervals(spark, stops), KEYS, "in_stop"), intervals(spark, changes), KEYS, "in_change")


def labels(spark, rows):
    return spark.createDataFrame([(i, "validation", "A", t, c, S + a, S + b) for i, t, c, a, b in rows], "event_id string, split string, asset string, fault_type string, channel string, onset bigint, end bigint")


def eq(*spans):
    return [(f"E{i}", "bearing_wear", "equipment", a, b) for i, (a, b) in enumerate(spans, 1)]


def score(spark, alerts, events, **more):
    w = windows(spark, alerts)
    return E.event_scores(flagged(spark, w, **more), labels(spark, events), KEYS, 10, 60, 600).first()


def test_debounce_gap(spark):
    one = E.debounce(windows(spark, [(0, 10), (70, 80)]), KEYS, 10, 60).collect()
    two = E.debounce(windows(spark, [(0, 10), (80, 90)]), KEYS, 10, 60).orderBy("start").collect()
    assert len(one) == 1 and [r["start"] - S for r in two] == [10, 90]


@pytest.mark.parametrize(
    ("alerts", "events", "want"),
    [
        ([(3600, 4400)], eq((3600, 4200), (3700, 4300)), (1, 0, 1)),
        ([(3600, 3700), (4000, 4100), (5000, 5100)], eq((3600, 7200)), (1, 2, 0)),
        ([(0, 21600)], eq((3600, 4200), (7200, 7800), (9000, 9600)), (0, 1, 3)),
        ([], eq((3600, 4200)), (0, 0, 1)),
        ([(4790, 4800)], eq((3600, 4200)), (1, 0, 0)),
        ([(4800, 4810)], eq((3600, 4200)), (0, 1, 1)),
    ],
)
def test_counts(spark, alerts, events, want):
    r = score(spark, alerts, events)
    assert (r["tp"], r["fp"], r["fn"]) == want


def test_undefined_metrics(spark):
    r = score(spark, [], eq((3600, 4200)))
    assert (r["f1"], r["recall"], r["precision"]) == (0.0, 0.0, None)
    assert r["operating_hours"] == 6.0


def test_match_order_and_overlap(spark):
    ev = [("B", "x", "equipment", 3600, 4200), ("A", "x", "equipment", 3600, 4200)]
    ep = E.debounce(windows(spark, [(3700, 3710), (4000, 4010)]), KEYS, 10, 60)
    got = {r["event_id"]: r["matched_start"] - S for r in E.match(labels(spark, ev), ep, KEYS, 600).collect()}
    assert got == {"A": 3710, "B": 4010}
    assert {r["event_id"]: r["overlapping"] for r in E.overlaps(labels(spark, ev), KEYS, 600).collect()} == {"A": ["B"], "B": ["A"]}


def test_delays(spark):
    ev = eq(*[(3000 * i, 3000 * i + 600) for i in range(1, 6)])
    r = score(spark, [(3000, 3010), (6060, 6070), (9120, 9130), (12300, 12310)], ev)
    assert r["miss_rate"] == pytest.approx(0.2) and r["delay_p50"] == pytest.approx(100.0)


def test_stop_and_change(spark):
    r = score(spark, [(8000, 8010), (12000, 12010)], eq(), stops=[(7200, 10800)])
    assert (r["false_alerts_operating"], r["operating_hours"], r["stop_unmatched"], r["stop_hours"], r["fp"]) == (1, 5.0, 1, 1.0, 2)
    r = score(spark, [(15000, 15100)], eq(), changes=[(14400, 21600)])
    assert (r["change_unmatched"], r["change_alert_seconds"], r["change_hours"], r["fp"]) == (1, 100, 2.0, 1)


def test_points(spark):
    ev = [("E1", "w", "equipment", 3600, 4200), ("E2", "d", "data", 8000, 8600)]
    got = {r["channel"]: r for r in E.point_scores(windows(spark, [(3700, 3710)]), labels(spark, ev), KEYS, 10, ["equipment", "data"]).collect()}
    assert (got["equipment"]["tp"], got["equipment"]["fn"]) == (1, 59) and (got["data"]["fp"], got["data"]["fn"]) == (1, 60)
    for r in got.values():
        assert r["tp"] + r["fp"] + r["fn"] + r["tn"] + r["excluded_windows"] == N
    w = windows(spark, [], [(3600, 4500)])
    x = E.point_scores(w, labels(spark, [("D", "dropout", "data", 3600, 4500)]), KEYS, 10, ["data"]).first()
    assert x["excluded_positive_windows"] == 90 and x["coverage"] == pytest.approx((N - 90) / N)


def candidates(spark, rows):
    return spark.createDataFrame(rows, "candidate_id string, strictness double, tp bigint, fp bigint, fn bigint, false_alerts_per_operating_hour double, total_alerts bigint")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("k2", 2.0, 8, 9, 1, 1.5, 17), ("k3", 3.0, 7, 4, 2, 0.9, 11), ("k4", 4.0, 7, 2, 2, 0.5, 9), ("k5", 5.0, 3, 0, 6, 0.0, 3)], "k4"),
        ([("a", 1.0, 5, 2, 1, 0.1, 9), ("b", 2.0, 5, 2, 1, 0.1, 9)], "b"),
        ([("a", 1.0, 5, 2, 1, 0.1, 8), ("b", 2.0, 5, 2, 1, 0.1, 9)], "a"),
        ([("a", 1.0, 5, 2, 1, None, 8)], "no_alert"),
    ],
)
def test_selection(spark, rows, want):
    got = E.select_candidate(candidates(spark, rows)).collect()
    assert [r["candidate_id"] for r in got if r["selected"]] == [want] and len(got) == len(rows) + 1


def test_refusals(spark):
    E.validate(windows(spark), KEYS, 10, {"validation": (S, S + 21600)})
    w = windows(spark)
    bad = [w.where(f"window_start != {S + 500}"), w.unionByName(w.limit(1)), w.limit(0), w.withColumn("alert", w["eligible"].cast("int")), w.withColumns({"eligible": E.F.lit(False), "alert": E.F.lit(True)})]
    for x in bad:
        with pytest.raises(InputError):
            E.validate(x, KEYS, 10)
    with pytest.raises(InputError):
        E.validate(w, KEYS, 10, {"validation": (S, S + 21610)})
    with pytest.raises(InputError):
        E.validate_labels(labels(spark, eq((1, 2)) * 2), w, KEYS)
    with pytest.raises(InputError):
        E.validate_labels(labels(spark, eq((1, 2))).withColumn("asset", E.F.lit("Z")), w, KEYS)
    with pytest.raises(InputError):
        E.validate_labels(labels(spark, eq((21000, 21500))), w, KEYS, {"validation": (S, S + 21600)})
    with pytest.raises(SplitOverlapError):
        E.validate_splits({"a": (0, 10), "b": (5, 20)})
    with pytest.raises(PoolingError):
        E.pool(E.event_scores(flagged(spark, windows(spark, split="test")), labels(spark, eq((1, 2))), KEYS, 10, 60, 600), [])

import numpy as np
import pytest

from tidemill.config import DEFAULT, SENSORS
from tidemill.errors import GeneratorError, InsufficientBaselineError, LockedSeedsError, MissingFitBoundaryError, NonFiniteEligibleInputError, SelectionIntegrityError, TrainOnlyError
from tidemill.operators import models, monitoring, views
from tidemill.plans import runner
from tidemill.sources import generator


def table(spark, values, split="train", bad=()):
    return spark.createDataFrame([(split, i, i not in bad, *map(float, v)) for i, v in enumerate(values)], "split string, window_start bigint, eligible boolean, x double, y double")


def test_mean_std_and_alerts(spark):
    df = table(spark, [(1, 0), (2, 0), (100, 0), (3, 0), (4, 0)], bad=(2,))
    bands = models.train_mean_std(df, ["x"])
    assert bands["x"] == pytest.approx((2.5, np.std([1, 2, 3, 4])))
    got = models.static_threshold_alert(table(spark, [(2.5, 0), (5, 0), (9, 0)], "test", bad=(2,)), bands, 2).orderBy("window_start").collect()
    assert [r["alert"] for r in got] == [False, True, False]
    with pytest.raises(TrainOnlyError):
        models.train_mean_std(table(spark, [(1, 0)], "test"), ["x"])
    with pytest.raises(NonFiniteEligibleInputError):
        models.train_mean_std(table(spark, [(float("nan"), 0)]), ["x"])
    with pytest.raises(NonFiniteEligibleInputError):
        models.static_threshold_alert(df, bands, float("inf"))
    with pytest.raises(Exception, match="not finite"):
        models.static_threshold_alert(table(spark, [(float("nan"), 0)]), bands, 1.0).collect()


def test_scaler(spark):
    r = np.random.default_rng(1).standard_normal(400)
    s = models.fit_scaler(table(spark, [(v, 7) for v in r]), ["x", "y"])
    assert s.dropped == ("y",) and s.center["x"] == pytest.approx(np.median(r)) and s.scale["x"] == pytest.approx(np.subtract(*np.percentile(r, [75, 25])))


def test_forest(spark):
    r = np.random.default_rng(2).standard_normal((600, 2))
    df = table(spark, [*r, (9, 9)])
    forest = models.fit_isolation_forest(df.repartition(7), ["x", "y"], ["window_start"], 50, 128)
    again = models.fit_isolation_forest(df.coalesce(1), ["x", "y"], ["window_start"], 50, 128)
    assert np.array_equal(forest.cut, again.cut)
    x = models.anomaly_scores(df, forest).orderBy("score").collect()
    assert x[-1]["window_start"] == 600 and 0 < x[0]["score"] < x[-1]["score"] < 1
    t = models.score_thresholds(models.anomaly_scores(df, forest), [0.9, 0.95, 0.99])
    assert t == sorted(t)
    assert models.score_alert(models.anomaly_scores(df, forest), t[-1]).where("alert").count() == sum(r["score"] > t[-1] for r in x)


def test_expanding_zscore(spark):
    r = 10 + 0.1 * np.random.default_rng(4).standard_normal((100, 2))
    r[10], r[80] = 30, (500, 10)
    got = monitoring.expanding_zscore(table(spark, r, bad=(10,)), ["split"], {"a": "x", "b": "y"}).orderBy("window_start").collect()
    assert not any(x["alert"] for x in got[:31]) and got[80]["alert"] and got[80]["worst_sensor"] == "a" and not got[10]["alert"]
    prior = np.delete(r[:80, 0], 10)
    assert got[80]["z"] == pytest.approx((500 - prior.mean()) / prior.std(), rel=1e-6) and got[80]["prior_n"] == 79


def wide(spark, n, spike=None):
    from tidemill.operators.features import feature_columns

    c = feature_columns()
    r = np.random.default_rng(5).standard_normal((n, len(c)))
    if spike is not None:
        r[spike] = 500
    return spark.createDataFrame([(10 * i, True, *map(float, v)) for i, v in enumerate(r)], "window_start bigint, eligible boolean, " + ", ".join(f"{x} double" for x in c))


def test_alert_log(spark, tmp_path):
    cfg = DEFAULT | {"forest": DEFAULT["forest"] | {"trees": 30}}
    rows, note = monitoring.run_monitoring(wide(spark, 80, 70), "M", cfg, warm_up_windows=50)
    assert not note and {r["source"] for r in rows.where("window_start = 700").collect()} == {"rule", "model"}
    path = str(tmp_path / "log")
    first = monitoring.append_alerts(rows, path)
    assert first["rows_written"] == first["rows_offered"] and monitoring.append_alerts(rows, path)["rows_written"] == 0
    log = spark.read.parquet(path)
    assert views.recent_alerts(log, "M", 1).first()["window_start"] == log.agg({"window_start": "max"}).first()[0]
    rows, note = monitoring.run_monitoring(wide(spark, 20), "M", cfg)
    assert "needed" in note and rows.where("source = 'model'").isEmpty()
    b = monitoring.fit_baseline(wide(spark, 80, 10), [c for c in wide(spark, 1).columns if "__" in c], 50, cfg)
    x = monitoring.score_frame(wide(spark, 80, 10), b)
    assert x.where("alert and window_start <= 490").isEmpty() and x.where("not causal").count() == 50
    with pytest.raises(MissingFitBoundaryError):
        monitoring.score_frame(wide(spark, 5), monitoring.Baseline(b.scaler, b.forest, b.threshold, None))
    with pytest.raises(InsufficientBaselineError):
        monitoring.fit_baseline(wide(spark, 5), ["vibration_rms__mean_5m"], 10)


def test_generator(spark):
    assert generator.mix64(0) == 0xE220A8397B1DCDAF
    counts = {}
    for s in generator.splits("dev"):
        events = generator.plan_faults(s)
        assert events == generator.plan_faults(s)
        counts[s["split"]] = len(events)
        for a in s["assets"]:
            own = sorted((e["onset"], e["tail_end"]) for e in events if e["asset"] == a)
            assert all(x[1] <= y[0] for x, y in zip(own, own[1:], strict=False))
        assert all(s["warm_up_end"] <= e["onset"] and e["tail_end"] <= s["end"] for e in events)
    assert counts == {"train": 10, "validation": 4, "test": 6}
    with pytest.raises(LockedSeedsError):
        generator.splits("locked")
    with pytest.raises(GeneratorError):
        generator.splits("none")
    x = np.random.default_rng(6).standard_normal(2000)
    y, want = generator.recurrence(x, 0.9, 2.0), []
    last = 2.0
    for v in x:
        last = 0.9 * last + v
        want.append(last)
    assert np.allclose(y, want)


def test_generated_day(spark):
    s = generator.splits("dev")[1]
    pdf = generator.synthesize(s, "FILLER", generator.plan_faults(s))
    assert len(pdf) == 86400 and pdf.equals(generator.synthesize(s, "FILLER", generator.plan_faults(s)))
    drop = sum(e["end"] - e["onset"] for e in generator.plan_faults(s) if e["asset"] == "FILLER" and e["fault_type"] == "dropout")
    lost = pdf[list(SENSORS)].isna().to_numpy().mean()
    assert abs((lost - drop / 86400) - 0.005) < 0.001 and (pdf["vibration_rms"].dropna() >= 0).all()


def test_selection_is_sealed():
    s = {"a": 1}
    s["identity"] = runner.identity(s)
    s["a"] = 2
    with pytest.raises(SelectionIntegrityError):
        runner.score_test(s, {}, {}, None)


def test_intervals():
    free = [(0, 10), (20, 25)]
    assert generator.without(free, [(3, 5), (9, 22), (-4, 1)]) == [(1, 3), (5, 9), (22, 25)]
    assert generator.without(free, []) == free and generator.without(free, [(-1, 30)]) == []
    assert [generator.at_rank(free, i) for i in (0, 9, 10, 14)] == [0, 9, 20, 24]
    with pytest.raises(IndexError):
        generator.at_rank(free, 15)


def test_quotas_are_exact():
    for s in generator.splits("dev"):
        days, n = len(s["seeds"]), len(s["seeds"]) * len(s["assets"])
        q = generator.quotas(s)
        assert not q.duplicated().any()
        for kind, (_, _, _, (rule, value), _, _) in DEFAULT["faults"].items():
            own = q[q["fault_type"] == kind]
            if rule == "share":
                assert all((own["asset"] == a).sum() == int(value * days + 0.5) for a in s["assets"])
            else:
                assert len(own) == int(n / value + 0.5)
        events = generator.plan_faults(s)
        assert len({e["event_id"] for e in events}) == len(events) == len(q)


def test_a_baseline_must_be_finite(spark):
    from tidemill.errors import NonFiniteBaselineError

    for bad in (float("nan"), float("inf"), None):
        frame = wide(spark, 60).withColumn("line_pressure_bar__mean_5m", monitoring.F.when(monitoring.F.col("window_start") == 100, monitoring.F.lit(bad).cast("double")).otherwise(monitoring.F.col("line_pressure_bar__mean_5m")))
        with pytest.raises(NonFiniteBaselineError, match="line_pressure_bar__mean_5m"):
            monitoring.fit_baseline(frame, [c for c in frame.columns if "__" in c], 50)


def test_the_alert_log_reads_the_days_it_needs(spark, tmp_path):
    rows = spark.createDataFrame([("m", d * 86400 + 10, d * 86400 + 20, "rule", "x", 1.0, "") for d in range(5)], "machine string, window_start bigint, window_end bigint, source string, sensor string, score double, detail string")
    path = str(tmp_path / "log")
    assert monitoring.append_alerts(rows.limit(0), path) == {"rows_offered": 0, "rows_written": 0}
    assert monitoring.append_alerts(rows, path) == {"rows_offered": 5, "rows_written": 5}
    assert monitoring.append_alerts(rows.where("window_start > 200000").unionByName(rows.withColumn("source", monitoring.F.lit("model"))), path) == {"rows_offered": 7, "rows_written": 5}
    log = spark.read.parquet(path)
    assert log.count() == 10 and log.dropDuplicates(monitoring.KEY).count() == 10 and {r["day"] for r in log.select("day").distinct().collect()} == set(range(5))

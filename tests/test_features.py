import math

import numpy as np
import pytest

from tidemill.config import DEFAULT, SENSORS
from tidemill.errors import LeakError, SplitSpanError
from tidemill.operators import features

T0 = 1700006400


def frame(spark, n, values, start=T0, end=None, warm_up=None):
    rows = [(("a", T0 + i) + tuple(None if values[s][i] is None or (isinstance(values[s][i], float) and math.isnan(values[s][i])) else float(values[s][i]) for s in SENSORS)) for i in range(n)]
    df = spark.createDataFrame(rows, "asset string, t bigint, " + ", ".join(f"{s} double" for s in SENSORS))
    return features.features(df, ["asset"], "t", start, T0 + n if end is None else end, warm_up=warm_up)


@pytest.fixture(scope="module")
def noisy():
    r = np.random.default_rng(3)
    v = {s: 10 + r.standard_normal(4000) for s in SENSORS}
    v["vibration_rms"][2500:2800] = np.nan
    v["vibration_rms"][::97] = np.nan
    return v


def test_equals_brute_force(spark, noisy):
    got = {r["window_start"]: r for r in frame(spark, 4000, noisy).collect()}
    assert len(got) == 400
    for w in (185, 250, 281, 300, 399):
        end = 10 * (w + 1)
        for name, (width, least) in DEFAULT["frames"].items():
            lo = max(0, end - width)
            x, t = noisy["vibration_rms"][lo:end], np.arange(lo, end)
            ok = np.isfinite(x)
            r = got[T0 + 10 * w]
            if ok.sum() < least:
                assert r[f"vibration_rms__mean_{name}"] is None
                continue
            assert r[f"vibration_rms__mean_{name}"] == pytest.approx(x[ok].mean(), rel=1e-12)
            assert r[f"vibration_rms__std_{name}"] == pytest.approx(x[ok].std(), rel=1e-9)
            assert r[f"vibration_rms__slope_{name}"] == pytest.approx(np.polyfit(t[ok] - t[0], x[ok], 1)[0], rel=1e-7, abs=1e-12)
            assert r[f"vibration_rms__missing_frac_{name}"] == pytest.approx(1 - ok.sum() / (end - lo))


def test_reasons(spark):
    v = {s: np.full(4000, 10.0) + np.arange(4000) % 7 for s in SENSORS}
    for s in SENSORS:
        v[s][2400:2450] = np.nan
    v["bearing_temp_c"][2450:2460] = np.nan
    v["motor_current_a"][3005] = np.inf
    got = [r["dq_reason"] for r in frame(spark, 4000, v).orderBy("window_start").collect()]
    assert got[:180] == ["warm_up"] * 180
    assert got[240:246] == ["all_sensors_missing"] * 5 + ["partial_sensor_missing"]
    assert got[180:240] == [""] * 60 and got[246:300] == [""] * 54
    assert got[300:] == ["non_finite_input"] * 100
    report = features.excluded_report(frame(spark, 4000, v), ["asset"], 10).collect()
    assert sum(r["windows"] for r in report) + report[0]["windows_eligible"] == 400 and len(report) == 5


def test_future_does_not_change_the_past(spark, noisy):
    other = {s: x.copy() for s, x in noisy.items()}
    for s in SENSORS:
        other[s][3000:] += 50
    a, b = (sorted(map(tuple, frame(spark, 4000, v).where(f"window_start < {T0 + 3000}").collect())) for v in (noisy, other))
    assert a == b


def test_slope(spark):
    got = frame(spark, 2400, {s: 5 + 0.01 * np.arange(2400) for s in SENSORS}).where(f"window_start = {T0 + 2390}").first()
    assert got["line_pressure_bar__slope_5m"] == pytest.approx(0.01) and got["line_pressure_bar__slope_30m"] == pytest.approx(0.01)


def test_refusals(spark, noisy):
    with pytest.raises(SplitSpanError):
        frame(spark, 4000, noisy, end=T0 + 3995)
    columns = features.feature_columns()
    assert len(columns) == 36 and columns[:3] == ["vibration_rms__mean_5m", "vibration_rms__std_5m", "vibration_rms__slope_5m"]
    features.assert_no_leak(columns, columns)
    for bad in (columns[1:], [*columns, "fault_type"], columns[::-1]):
        with pytest.raises(LeakError):
            features.assert_no_leak(bad, columns)


def test_readings_outside_of_the_split(spark, noisy):
    for more in ({"start": T0 + 10}, {"end": T0 + 3990}):
        with pytest.raises(Exception, match="SplitSpanError"):
            frame(spark, 4000, noisy, **more).collect()


def test_declared_assets_and_sensors(spark):
    rows = [("a", T0 + i, 1.0, 2.0, 3.0, 4.0) for i in range(100)]
    df = spark.createDataFrame(rows, "asset string, t bigint, " + ", ".join(f"{s} double" for s in SENSORS))
    declared = spark.createDataFrame([("a",), ("b",)], "asset string")
    got = features.features(df, ["asset"], "t", T0, T0 + 100, warm_up=0, declared=declared).groupBy("asset", "dq_reason").count().collect()
    assert {(r["asset"], r["dq_reason"]): r["count"] for r in got} == {("a", "insufficient_observations"): 10, ("b", "all_sensors_missing"): 10}
    with pytest.raises(ValueError, match="vibration_rms"):
        features.features(df.drop("vibration_rms"), ["asset"], "t", T0, T0 + 100)
    with pytest.raises(ValueError, match="humidity"):
        features.features(df.withColumn("humidity", df["t"]), ["asset"], "t", T0, T0 + 100, strict=True)


@pytest.mark.parametrize("k", [1, 2, 3, 7, 30, 180])
def test_frames_of_any_length(spark, k):
    """Moments of trailing frames, by numpy, also over blocks without values."""
    r = np.random.default_rng(k)
    x = 1e4 + r.standard_normal(2000)
    x[r.random(2000) < 0.3] = np.nan
    x[500:700] = np.nan
    df = spark.createDataFrame([("a", T0 + i, float(v)) for i, v in enumerate(x) if np.isfinite(v)], "asset string, t bigint, x double")
    stats = features.block_stats(df, ["asset"], "t", T0, 10)
    got = features.rolling(features.dense_blocks(stats, ["asset"], T0, T0 + 2000, 10), ["asset"], 10, {"f": [10 * k, 2]}).orderBy("block").collect()
    for w, row in enumerate(got):
        own = x[max(0, 10 * (w + 1 - k)) : 10 * (w + 1)]
        t = np.flatnonzero(np.isfinite(own))
        assert row["n_f"] == len(t) and row["missing_frac_f"] == pytest.approx(1 - len(t) / len(own))
        if len(t) >= 2:
            assert row["mean_f"] == pytest.approx(own[t].mean(), rel=1e-12) and row["std_f"] == pytest.approx(own[t].std(), rel=1e-9, abs=1e-9)
            assert row["slope_f"] == pytest.approx(np.polyfit(t - t[0], own[t], 1)[0], rel=1e-6, abs=1e-9)

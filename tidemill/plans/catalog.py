"""Queries over the test tables, and the SQL that checks them.

The events table stands in for sensor data: an asset is an event type, its first sensor
is the value and its second the number in props (missing at multiples of 7).  Windows are hours,
frames 6 and 24 hours.  Floating-point results are rounded on both sides by one convention
(``compared``), which no operator applies.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, SENSORS
from ..functions.columns import compared, epoch_seconds, iso_utc
from ..operators import episodes, features, ingest, models, monitoring, views
from ..sources import generator, messages

HOUR, START = 3600, 1704067200
END = START + 30 * 86400
TEST = START + 20 * 86400
FRAMES = {"6h": [6 * HOUR, 5], "24h": [24 * HOUR, 10]}
CFG = DEFAULT | {"window_s": HOUR, "frames": FRAMES, "warm_up_s": 86400}
PAIR = ("s1", "s2")
KEYS = ["asset"]
CHANNELS = ["equipment", "data"]


def _events(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("event_type").alias("asset"), "user_id", epoch_seconds("ts").alias("t"), F.col("value").alias("s1"), F.when(F.pmod(k, F.lit(7)) != 0, k).alias("s2"))


def _r(name: str, digits: int = 6, offset: float = 1e-9):
    return compared(F.col(name), digits, offset).alias(name)


def _blocks(spark, sf):
    return features.block_stats(features.long_sensors(_events(spark, sf), KEYS, "t", PAIR), ["asset", "sensor"], "t", START, HOUR)


def block_stats(spark, sf):
    return _blocks(spark, sf).select("asset", "sensor", "block", "n", _r("mean"), _r("tbar", 4), _r("m2", 4), _r("stx", 2, 0.00137), "n_inf")


def dense_grid(spark, sf):
    r = _events(spark, sf).groupBy("asset", (F.floor((F.col("t") - START) / HOUR) * HOUR + START).alias("hour")).agg(F.count("*").alias("n"))
    return messages.dense_grid(r, KEYS, "hour", START, END, HOUR)


def _rolled(spark, sf):
    by = ["asset", "sensor"]
    return features.rolling(features.dense_blocks(_blocks(spark, sf), by, START, END, HOUR), by, HOUR, FRAMES)


def rolling_stats(spark, sf):
    return _rolled(spark, sf).select("asset", "sensor", "block", F.col("n_24h").alias("n"), _r("mean_24h"), _r("std_24h"), _r("slope_24h", 8))


def missing_fraction(spark, sf):
    return _rolled(spark, sf).select("asset", "sensor", "block", _r("missing_frac_6h"), _r("missing_frac_24h"))


def _features(spark, sf):
    return features.features(_events(spark, sf), KEYS, "t", START, END, PAIR, CFG)


def dq_reasons(spark, sf):
    return _features(spark, sf).select("asset", "window_start", "dq_reason", "eligible")


def excluded_report(spark, sf):
    return features.excluded_report(_features(spark, sf), KEYS, HOUR).select("asset", "dq_reason", "windows", "seconds", "windows_total", "windows_eligible", _r("observed_fraction"))


def _split(frame):
    return frame.withColumn("split", F.when(F.col("window_start") < TEST, "train").otherwise("test"))


COLUMNS = [f"{s}__mean_6h" for s in PAIR]


def train_mean_std(spark, sf):
    got = models.train_mean_std(_split(_features(spark, sf)).where("split = 'train'"), COLUMNS)
    return spark.createDataFrame([(c, *got[c]) for c in COLUMNS], "feature string, mean double, std double").select("feature", _r("mean"), _r("std"))


def static_threshold_alerts(spark, sf):
    x = _split(_features(spark, sf))
    bands = models.train_mean_std(x.where("split = 'train'"), COLUMNS)
    return models.static_threshold_alert(x, bands, 1.5).select("asset", "window_start", "eligible", "alert")


def static_candidates(spark, sf):
    x = _split(_features(spark, sf))
    bands = models.train_mean_std(x.where("split = 'train'"), COLUMNS)
    c = models.static_candidates(x.where("split = 'test'"), bands, [1, 2, 3])
    return c.groupBy("candidate_id", "asset").agg(F.count_if("alert").alias("alerts"), F.count_if("eligible").alias("eligible"))


def robust_scaler_fit(spark, sf):
    s = models.fit_scaler(_split(_features(spark, sf)).where("split = 'train'"), COLUMNS)
    return spark.createDataFrame([(c, s.center[c], s.scale[c], s.rows) for c in s.columns], "feature string, center double, scale double, rows bigint").select("feature", _r("center"), _r("scale"), "rows")


def robust_scaled(spark, sf):
    x = _split(_features(spark, sf))
    s = models.fit_scaler(x.where("split = 'train'"), COLUMNS)
    return models.scaled(x.where("eligible"), s).select("asset", "window_start", *[_r(c, 5) for c in COLUMNS])


def score_quantiles(spark, sf):
    x = _features(spark, sf).withColumn("score", F.abs(COLUMNS[0]))
    q = DEFAULT["forest"]["quantiles"]
    return spark.createDataFrame(list(zip(q, models.score_thresholds(x, q), strict=True)), "q double, threshold double").select("q", _r("threshold"))


def _hourly(spark, sf):
    """Hour means of both sensors; an hour is eligible after the first day and with an observation of each."""
    b = features.dense_blocks(_blocks(spark, sf), [*KEYS, "sensor"], START, END, HOUR)
    means = [F.max(F.when(F.col("sensor") == s, F.col("mean"))).alias(s) for s in PAIR]
    x = b.groupBy(*KEYS, F.col("block").alias("window_start")).agg(*means, F.count_if(F.col("n") == 0).alias("none"))
    reason = F.when(F.col("window_start") < START + 86400, "warm_up").when(F.col("none") == len(PAIR), "all_sensors_missing").when(F.col("none") > 0, "partial_sensor_missing").otherwise("")
    return x.withColumn("dq_reason", reason).withColumn("eligible", F.col("dq_reason") == "").drop("none")


def _alerts(spark, sf, k: float = 1.0):
    return monitoring.expanding_zscore(_hourly(spark, sf), KEYS, {s: s for s in PAIR}, k, 30)


def expanding_zscore_alerts(spark, sf):
    return _alerts(spark, sf, 2.0).select("asset", "window_start", "eligible", "alert", "worst_sensor", _r("z", 5), "prior_n")


def _intervals(spark, sf):
    """Stops (an hour a day) and changes (evenings of the last five days) of every asset."""
    a = _events(spark, sf).select("asset").distinct()
    day = a.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(29))))
    at = lambda lo, hi: [(F.lit(START) + F.col("d") * 86400 + lo).cast("long").alias("start"), (F.lit(START) + F.col("d") * 86400 + hi).cast("long").alias("end")]
    return day.select("asset", *at(50400, 54000)), day.where("d >= 25").select("asset", *at(64800, 86400))


def _labels(spark, sf):
    """Every third day an event of four hours, on every sixth another that overlaps it."""
    a = _events(spark, sf).select("asset").distinct()
    d = a.withColumn("d", F.explode(F.sequence(F.lit(2), F.lit(27), F.lit(3)))).withColumn("w", F.explode(F.array(F.lit(0), F.lit(1)))).where("w = 0 or d % 6 = 2")
    onset = F.lit(START) + F.col("d") * 86400 + 28800 + F.col("w") * 7200
    wear = (F.col("d") + F.col("w")) % 2 == 0
    return d.select("asset", F.concat_ws("-", "asset", F.format_string("%02d", "d"), F.col("w").cast("string")).alias("event_id"), F.when(wear, "bearing_wear").otherwise("dropout").alias("fault_type"), F.when(wear, "equipment").otherwise("data").alias("channel"), onset.cast("long").alias("onset"), (onset + 14400).cast("long").alias("end"))


def _windows(spark, sf):
    stops, changes = _intervals(spark, sf)
    return episodes.flagged(episodes.flagged(_alerts(spark, sf), stops, KEYS, "in_stop"), changes, KEYS, "in_change")


GAP = TAIL = 7200


def debounce_episodes(spark, sf):
    return episodes.debounce(_alerts(spark, sf), KEYS, HOUR, GAP).select("asset", "episode", "start", "end", "n_windows")


def greedy_match(spark, sf):
    return episodes.match(_labels(spark, sf), episodes.debounce(_alerts(spark, sf), KEYS, HOUR, GAP), KEYS, TAIL).select("asset", "event_id", "matched_start", "delay")


def overlapping_events(spark, sf):
    x = episodes.overlaps(_labels(spark, sf), KEYS, TAIL)
    return x.select("asset", "event_id", F.array_join("overlapping", ",").alias("overlapping"))


def _scores(spark, sf):
    return episodes.event_scores(_windows(spark, sf), _labels(spark, sf), KEYS, HOUR, GAP, TAIL)


def event_scores(spark, sf):
    exact = ["windows_total", "events", "episodes", "tp", "fp", "fn", "false_alerts_operating", "stop_unmatched", "stop_episodes", "change_unmatched", "change_alert_seconds"]
    rounded = ["operating_hours", "stop_hours", "change_hours", "precision", "recall", "f1", "false_alerts_per_operating_hour", "delay_p50", "delay_p90", "alert_active_fraction_operating"]
    return _scores(spark, sf).select("asset", *[F.col(c).cast("long").alias(c) for c in exact], *[_r(c) for c in rounded])


def _matched(spark, sf):
    labels = _labels(spark, sf)
    return labels, episodes.match(labels, episodes.debounce(_alerts(spark, sf), KEYS, HOUR, GAP), KEYS, TAIL)


def recall_by_type(spark, sf):
    return episodes.recall_by(*_matched(spark, sf), KEYS, "fault_type").select("asset", "fault_type", "events", "matched", _r("recall"))


def recall_by_channel(spark, sf):
    return episodes.recall_by(*_matched(spark, sf), KEYS, "channel", [*CHANNELS, "other"]).select("asset", "channel", "events", "matched", _r("recall"))


def point_confusion(spark, sf):
    x = episodes.point_scores(_alerts(spark, sf), _labels(spark, sf), KEYS, HOUR, CHANNELS)
    return x.select("asset", "channel", "tp", "fp", "fn", "tn", "eligible_windows", "excluded_windows", "excluded_positive_windows", _r("precision"), _r("recall"), _r("f1"), _r("coverage"))


def excluded_by_reason(spark, sf):
    return episodes.excluded_by_reason(_alerts(spark, sf), _labels(spark, sf), KEYS, HOUR, CHANNELS)


def pool_counts(spark, sf):
    x = episodes.pool(_scores(spark, sf), [])
    return x.select(*[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "episodes")], _r("precision"), _r("recall"), _r("f1"), _r("false_alerts_per_operating_hour"))


def _candidates(spark, sf):
    """A candidate per minimum value of the first sensor: an event over it alerts, and is right if it is an error."""
    x = _events(spark, sf).withColumn("strictness", F.explode(F.array(*[F.lit(float(k)) for k in (50, 100, 150, 200, 250)])))
    hit, error = F.col("s1") > F.col("strictness"), F.col("asset") == "error"
    g = x.groupBy("strictness").agg(F.count_if(hit & error).alias("tp"), F.count_if(hit & ~error).alias("fp"), F.count_if(~hit & error).alias("fn"), F.count_if(hit).alias("total_alerts"))
    return g.select(F.concat(F.lit("v"), F.col("strictness").cast("int").cast("string")).alias("candidate_id"), "strictness", "tp", "fp", "fn", (F.col("fp") / 720.0).alias("false_alerts_per_operating_hour"), "total_alerts")


def _selected(x):
    return x.select("candidate_id", "tp", "fp", "fn", "total_alerts", _r("f1"), "within_cap", "rank", "selected")


def selection_rule(spark, sf):
    return _selected(episodes.select_candidate(_candidates(spark, sf), 1.0))


def selection_no_candidate(spark, sf):
    return _selected(episodes.select_candidate(_candidates(spark, sf).where("strictness < 100"), -1.0))


def _tag():
    return F.concat(F.lit("LINE_A.U"), F.col("user_id").cast("string"))


def _declared():
    """All users are declared machines but those whose number is 7 modulo 10, however many there are."""
    return F.col("tag").rlike(r"^LINE_A\.U(-\d+|\d*[0-689])$")


def _messages(spark, sf):
    """Events as JSON messages: replays (every 10th), conflicts (every 17th), late ones (every 13th), text that is no JSON (every 19th)."""
    e = _events(spark, sf)
    t = F.col("t") - F.when(F.col("event_id") % 13 == 0, 86400).otherwise(0)
    base = e.select("event_id", _tag().alias("tag"), t.alias("t"), F.col("s1").alias("v"), F.col("s2").alias("w"))
    replay = base.where("event_id % 10 = 0").withColumn("arrival_seq", F.col("event_id") * 4 + 4002)
    other = base.where("event_id % 17 = 0").withColumn("w", F.coalesce("w", F.lit(0.0)) + 1).withColumn("arrival_seq", F.col("event_id") * 4 + 4003)
    x = base.withColumn("arrival_seq", F.col("event_id") * 4).unionByName(replay).unionByName(other)
    body = F.to_json(F.struct(iso_utc(F.col("t")).alias("ts"), "tag", F.lit("SENSOR").alias("type"), F.col("v").alias("vibration_rms"), F.lit(None).cast("double").alias("bearing_temp_c"), F.col("w").alias("motor_current_a"), F.lit(4.0).alias("line_pressure_bar")), {"ignoreNullFields": "false"})
    raw = F.when((F.col("event_id") % 19 == 0) & (F.col("arrival_seq") % 4 == 0), F.concat(F.lit("x"), body)).otherwise(body)
    return x.select("arrival_seq", raw.alias("raw"))


def _log(spark, sf):
    return ingest.classify(_messages(spark, sf), _declared())


def ingest_categories(spark, sf):
    return _log(spark, sf).select("arrival_seq", "category", "tag", "ts_epoch")


def ingest_reconciliation(spark, sf):
    return ingest.reconciliation(_log(spark, sf))


def ingest_summary(spark, sf):
    return ingest.summary(_log(spark, sf))


def message_round_trip(spark, sf):
    """Accepted readings as messages, classified again: all are accepted and give the same values."""
    log = ingest.readings(_log(spark, sf))
    back = messages.to_messages(log, "machine").select(F.col("ts_epoch").alias("at"), "raw")
    x = ingest.parse(back)
    return x.select("tag", "ts_epoch", "vibration_rms", "motor_current_a", F.col("reason").isNull().alias("well_formed"))


def latest_readings(spark, sf):
    return views.latest_readings(ingest.readings(_log(spark, sf)), "LINE_A.U8", 20).select("machine", "ts_epoch", "vibration_rms", "motor_current_a")


def latest_state(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("machine"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    return views.latest_state(e).select("machine", "state", "seq")


def _alert_log(spark, sf):
    return monitoring.alert_rows(_alerts(spark, sf), F.col("asset"), "rule", HOUR)


def alert_log_upsert(spark, sf):
    """The first ten days are in the log; all alerts are offered twice."""
    a = _alert_log(spark, sf)
    return monitoring.new_alerts(a.unionByName(a), a.where(F.col("window_start") < START + 10 * 86400)).select(*monitoring.KEY, "window_end", _r("score", 5))


def recent_alerts(spark, sf):
    return views.recent_alerts(_alert_log(spark, sf), None, 50).select(*monitoring.KEY)


def alert_summary(spark, sf):
    return views.alert_summary(_alert_log(spark, sf), "error", 100)


def sensor_long(spark, sf):
    r = ingest.readings(_log(spark, sf))
    return views.sensor_long(r).where("value is not null")


def prevalence_report(spark, sf):
    x = _labels(spark, sf).withColumn("date", F.date_from_unix_date(F.floor(F.col("onset") / 86400).cast("int")).cast("string"))
    return generator.prevalence(x, 150).select("fault_type", "events", "asset_days", F.col("seconds").cast("long").alias("seconds"), _r("events_per_asset_day"))


def iforest_scores(spark, sf):
    x = _split(_features(spark, sf))
    f = DEFAULT["forest"]
    s = models.fit_scaler(x.where("split = 'train'"), [c for c in x.columns if "__" in c])
    y = models.scaled(x, s)
    forest = models.fit_isolation_forest(y.where("split = 'train'"), s.columns, ["asset", "window_start"], f["trees"], f["sample"], f["seed"])
    return models.anomaly_scores(y, forest).select("asset", "window_start", "eligible", "score")


def generator_readings(spark, sf):
    """All development days of the generated line, by split and asset."""
    data = generator.generate(spark, "dev")
    return data["readings"].groupBy("split", "asset").agg(F.count("*").alias("seconds"), *[F.count(s).alias(s) for s in SENSORS])


def stream_ingest(spark, sf):
    """The messages as a stream, classified with state; categories equal those in batch."""
    from ..streaming import ingest as stream
    from ..streaming.replay import replayed

    return replayed(_messages(spark, sf), lambda s: stream.classify_stream(s, _declared())).select("arrival_seq", "category")


QUERIES = {
    f.__name__: f
    for f in (
        block_stats, dense_grid, rolling_stats, missing_fraction, dq_reasons, excluded_report, train_mean_std, static_threshold_alerts, static_candidates, robust_scaler_fit, robust_scaled, score_quantiles,
        expanding_zscore_alerts, debounce_episodes, greedy_match, overlapping_events, event_scores, recall_by_type, recall_by_channel, point_confusion, excluded_by_reason, pool_counts, selection_rule,
        selection_no_candidate, ingest_categories, ingest_reconciliation, ingest_summary, message_round_trip, latest_readings, latest_state, alert_log_upsert, recent_alerts, alert_summary, sensor_long,
        prevalence_report, iforest_scores, generator_readings, stream_ingest,
    )
}

# --- the same in SQL ------------------------------------------------------------------------

EV = "ev AS (SELECT event_id, event_type AS asset, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, value AS s1, CASE WHEN CAST(regexp_extract(props, '[0-9]+') AS INT) % 7 <> 0 THEN CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) END AS s2 FROM events)"
LO = "lo AS (SELECT asset, 's1' AS sensor, t, s1 AS x FROM ev UNION ALL SELECT asset, 's2', t, s2 FROM ev)"
GRID = f"hours AS (SELECT unnest(range({START}, {END}, {HOUR})) AS block), assets AS (SELECT DISTINCT asset FROM ev), sensors AS (SELECT DISTINCT asset, sensor FROM lo)"


def _c(x: str, name: str = "", digits: int = 6) -> str:
    return f"round({x} + 1e-9, {digits}) AS {name or x}"


def _roll(name: str) -> str:
    w, least = FRAMES[name]
    return f"""r{name} AS (SELECT g.asset, g.sensor, h.block, count(x) AS n, avg(x) AS mean, stddev_pop(x) AS std, regr_slope(x, CAST(t - {START} AS DOUBLE)) AS slope, regr_sxx(x, CAST(t - {START} AS DOUBLE)) AS stt
      FROM sensors g CROSS JOIN hours h LEFT JOIN lo ON lo.asset = g.asset AND lo.sensor = g.sensor AND lo.t >= greatest({START}, h.block + {HOUR} - {w}) AND lo.t < h.block + {HOUR} AND x IS NOT NULL GROUP BY ALL),
      q{name} AS (SELECT *, n >= {least} AND stt > 0 AS ok FROM r{name})"""


def _frac(name: str) -> str:
    k = FRAMES[name][0] // HOUR
    return f"1 - n / (least({k}, (block - {START}) // {HOUR} + 1) * {HOUR}.0::DOUBLE)"


@cache
def _wide() -> str:
    return f"""{EV}, {LO}, {GRID}, {_roll('6h')}, {_roll('24h')},
 empty AS (SELECT g.asset, h.block, g.sensor, count(x) AS n FROM sensors g CROSS JOIN hours h LEFT JOIN lo ON lo.asset = g.asset AND lo.sensor = g.sensor AND lo.t >= h.block AND lo.t < h.block + {HOUR} GROUP BY ALL),
 wide AS (SELECT a.asset, a.block AS window_start, max(CASE WHEN a.sensor = 's1' AND a.ok THEN a.mean END) AS m1, max(CASE WHEN a.sensor = 's2' AND a.ok THEN a.mean END) AS m2, count_if(e.n = 0) AS none, count_if(NOT COALESCE(a.ok, false) OR NOT COALESCE(b.ok, false)) AS short
   FROM q6h a JOIN q24h b USING (asset, sensor, block) JOIN empty e USING (asset, sensor, block) GROUP BY ALL),
 dq AS (SELECT *, CASE WHEN window_start < {START + 86400} THEN 'warm_up' WHEN none = 2 THEN 'all_sensors_missing' WHEN none > 0 THEN 'partial_sensor_missing' WHEN short > 0 THEN 'insufficient_observations' ELSE '' END AS dq_reason FROM wide),
 fr AS (SELECT *, dq_reason = '' AS eligible, window_start < {TEST} AS train FROM dq),
 bands AS (SELECT avg(m1) AS a1, stddev_pop(m1) AS d1, avg(m2) AS a2, stddev_pop(m2) AS d2 FROM fr WHERE train AND eligible)"""


@cache
def _alert_sql() -> str:
    b = "OVER (PARTITION BY asset ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{EV}, {LO}, {GRID},
 hm AS (SELECT a.asset, h.block AS window_start, avg(s1) AS mean1, count(s1) AS n1, avg(s2) AS mean2, count(s2) AS n2 FROM assets a CROSS JOIN hours h LEFT JOIN ev ON ev.asset = a.asset AND t >= h.block AND t < h.block + {HOUR} GROUP BY ALL),
 hd AS (SELECT *, CASE WHEN window_start < {START + 86400} THEN 'warm_up' WHEN n1 = 0 AND n2 = 0 THEN 'all_sensors_missing' WHEN n1 = 0 OR n2 = 0 THEN 'partial_sensor_missing' ELSE '' END AS dq_reason FROM hm),
 hx AS (SELECT *, dq_reason = '' AS eligible, CASE WHEN dq_reason = '' THEN mean1 END AS x1, CASE WHEN dq_reason = '' THEN mean2 END AS x2 FROM hd),
 hz AS (SELECT *, count(x1) {b} AS pn1, avg(x1) {b} AS pm1, stddev_pop(x1) {b} AS ps1, count(x2) {b} AS pn2, avg(x2) {b} AS pm2, stddev_pop(x2) {b} AS ps2 FROM hx),
 zs AS (SELECT *, CASE WHEN x1 IS NOT NULL AND pn1 >= 30 AND ps1 > 0 THEN (x1 - pm1) / ps1 END AS z1, CASE WHEN x2 IS NOT NULL AND pn2 >= 30 AND ps2 > 0 THEN (x2 - pm2) / ps2 END AS z2 FROM hz),
 z AS (SELECT *, CASE WHEN COALESCE(abs(z2), -1) > COALESCE(abs(z1), -1) THEN 's2' ELSE 's1' END AS worst FROM zs),
 w AS (SELECT asset, window_start, dq_reason, eligible, worst, COALESCE(greatest(abs(z1), abs(z2)) > 1.0, false) AS alert, CASE worst WHEN 's2' THEN z2 ELSE z1 END AS z, CASE worst WHEN 's2' THEN pn2 ELSE pn1 END AS pn,
   (window_start - {START}) % 86400 >= 50400 AND (window_start - {START}) % 86400 < 54000 AS in_stop, window_start >= {START + 25 * 86400} AND (window_start - {START}) % 86400 >= 64800 AS in_change FROM z),
 i0 AS (SELECT *, CASE WHEN window_start - (lag(window_start) OVER (PARTITION BY asset ORDER BY window_start) + {HOUR}) <= {GAP} THEN 0 ELSE 1 END AS new FROM w WHERE alert),
 i1 AS (SELECT *, sum(new) OVER (PARTITION BY asset ORDER BY window_start) AS episode FROM i0),
 ep AS (SELECT asset, CAST(episode AS BIGINT) AS episode, min(window_start) + {HOUR} AS start, max(window_start) + {HOUR} AS "end", count(*) AS n_windows, arg_min(in_stop, window_start) AS in_stop, arg_min(in_change, window_start) AS in_change FROM i1 GROUP BY ALL),
 days AS (SELECT unnest(range(2, 28, 3)) AS d), twice AS (SELECT unnest([0, 1]) AS w),
 lab AS (SELECT asset, concat_ws('-', asset, lpad(d::VARCHAR, 2, '0'), twice.w::VARCHAR) AS event_id, CASE WHEN (d + twice.w) % 2 = 0 THEN 'bearing_wear' ELSE 'dropout' END AS fault_type, CASE WHEN (d + twice.w) % 2 = 0 THEN 'equipment' ELSE 'data' END AS channel,
   {START} + d * 86400 + 28800 + twice.w * 7200 AS onset, {START} + d * 86400 + 43200 + twice.w * 7200 AS "end" FROM assets CROSS JOIN days CROSS JOIN twice WHERE twice.w = 0 OR d % 6 = 2),
 o AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY onset, event_id) AS i FROM lab),
 st AS (SELECT asset, list_sort(list(start)) AS starts FROM ep GROUP BY asset),
 g AS (SELECT asset, 0::BIGINT AS i, COALESCE(starts, []::BIGINT[]) AS lefts, NULL::BIGINT AS got FROM assets LEFT JOIN st USING (asset)
   UNION ALL SELECT asset, i, CASE WHEN got IS NULL THEN lefts ELSE list_filter(lefts, lambda s: s <> got) END, got FROM
     (SELECT g.asset, o.i, g.lefts, list_min(list_filter(g.lefts, lambda s: s >= o.onset AND s <= o."end" + {TAIL})) AS got FROM g JOIN o ON o.asset = g.asset AND o.i = g.i + 1)),
 m AS (SELECT o.asset, event_id, fault_type, channel, onset, got AS matched_start, got - onset AS delay FROM o JOIN g USING (asset, i)),
 un AS (SELECT ep.*, m.event_id IS NULL AS un FROM ep LEFT JOIN m ON m.asset = ep.asset AND m.matched_start = ep.start),
 sc AS (SELECT a.asset, (SELECT count(*) FROM w WHERE w.asset = a.asset) AS windows_total, (SELECT count(*) FROM m WHERE m.asset = a.asset) AS events, (SELECT count(*) FROM un WHERE un.asset = a.asset) AS episodes,
   (SELECT count(matched_start) FROM m WHERE m.asset = a.asset) AS tp, (SELECT count_if(un) FROM un WHERE un.asset = a.asset) AS fp, (SELECT count(*) - count(matched_start) FROM m WHERE m.asset = a.asset) AS fn,
   (SELECT count_if(un AND NOT in_stop) FROM un WHERE un.asset = a.asset) AS false_alerts_operating, (SELECT count_if(un AND in_stop) FROM un WHERE un.asset = a.asset) AS stop_unmatched, (SELECT count_if(in_stop) FROM un WHERE un.asset = a.asset) AS stop_episodes,
   (SELECT count_if(un AND in_change) FROM un WHERE un.asset = a.asset) AS change_unmatched, (SELECT count_if(alert AND in_change) * {HOUR} FROM w WHERE w.asset = a.asset) AS change_alert_seconds,
   (SELECT count_if(eligible AND NOT in_stop)::DOUBLE FROM w WHERE w.asset = a.asset) AS operating_hours, (SELECT count_if(eligible AND in_stop)::DOUBLE FROM w WHERE w.asset = a.asset) AS stop_hours, (SELECT count_if(eligible AND in_change)::DOUBLE FROM w WHERE w.asset = a.asset) AS change_hours,
   (SELECT quantile_cont(delay, 0.5) FROM m WHERE m.asset = a.asset) AS delay_p50, (SELECT quantile_cont(delay, 0.9) FROM m WHERE m.asset = a.asset) AS delay_p90,
   (SELECT count_if(alert AND NOT in_stop)::DOUBLE / nullif(count_if(eligible AND NOT in_stop), 0) FROM w WHERE w.asset = a.asset) AS alert_active_fraction_operating FROM assets a),
 pt AS (SELECT w.*, c.channel, EXISTS (SELECT 1 FROM lab WHERE lab.asset = w.asset AND lab.channel = c.channel AND w.window_start < lab."end" AND w.window_start + {HOUR} > lab.onset) AS truth FROM w CROSS JOIN (SELECT unnest(['equipment', 'data']) AS channel) c)"""


def _prf(tp="tp", fp="fp", fn="fn"):
    return ", ".join([_c(f"{tp} / nullif({tp} + {fp}, 0)::DOUBLE", "precision"), _c(f"{tp} / nullif({tp} + {fn}, 0)::DOUBLE", "recall"), _c(f"2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0)::DOUBLE", "f1")])


MSG = f"""{EV}, b AS (SELECT event_id, 'LINE_A.U' || user_id AS tag, user_id, t - CASE WHEN event_id % 13 = 0 THEN 86400 ELSE 0 END AS t, s1 AS v, s2 AS w FROM ev),
 msg AS (SELECT event_id * 4 AS arrival_seq, *, event_id % 19 = 0 AS broken FROM b UNION ALL SELECT event_id * 4 + 4002, *, false FROM b WHERE event_id % 10 = 0
   UNION ALL SELECT event_id * 4 + 4003, event_id, tag, user_id, t, v, COALESCE(w, 0) + 1, false FROM b WHERE event_id % 17 = 0),
 bad AS (SELECT *, CASE WHEN broken OR v > 100 THEN 'bad_payload' WHEN user_id % 10 = 7 THEN 'unknown_tag' END AS early FROM msg),
 ok AS (SELECT *, max(t) OVER (PARTITION BY tag ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark, row_number() OVER (PARTITION BY tag, t ORDER BY arrival_seq) AS nth,
   first_value((v, w)) OVER (PARTITION BY tag, t ORDER BY arrival_seq) IS NOT DISTINCT FROM (v, w) AS same FROM bad WHERE early IS NULL),
 log AS (SELECT arrival_seq, early AS category, CASE WHEN NOT broken THEN tag END AS tag, CASE WHEN early = 'unknown_tag' THEN t END AS ts_epoch, v, w FROM bad WHERE early IS NOT NULL
   UNION ALL SELECT arrival_seq, CASE WHEN nth > 1 AND same THEN 'duplicate' WHEN nth > 1 THEN 'reading_conflict' WHEN mark IS NULL OR t > mark THEN 'accepted' ELSE 'out_of_order_rejected' END, tag, t, v, w FROM ok)"""

CAND = f"""{EV}, ks AS (SELECT unnest([50.0, 100.0, 150.0, 200.0, 250.0])::DOUBLE AS strictness),
 c0 AS (SELECT 'v' || strictness::INT::VARCHAR AS candidate_id, strictness, count_if(s1 > strictness AND asset = 'error') AS tp, count_if(s1 > strictness AND asset <> 'error') AS fp, count_if(s1 <= strictness AND asset = 'error') AS fn, count_if(s1 > strictness) AS total_alerts FROM ev CROSS JOIN ks GROUP BY strictness)"""


def _select_sql(where: str, cap: str) -> str:
    return f"""WITH {CAND}, c1 AS (SELECT *, fp / 720.0::DOUBLE AS rate FROM c0 WHERE {where}),
 c2 AS (SELECT * FROM c1 UNION ALL SELECT 'no_alert', 'inf'::DOUBLE, 0, 0, max(tp + fn), 0, 0.0 FROM c1),
 c3 AS (SELECT *, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1, rate <= {cap} AS within_cap FROM c2),
 c4 AS (SELECT *, row_number() OVER (PARTITION BY within_cap ORDER BY COALESCE(f1, -1) DESC, fp, total_alerts, strictness DESC, candidate_id)::INT AS rank FROM c3)
 SELECT candidate_id, tp, fp, fn, total_alerts, {_c('f1')}, within_cap, rank, within_cap AND rank = 1 AS selected FROM c4"""


ALOG = f"al AS (SELECT asset AS machine, window_start, window_start + {HOUR} AS window_end, 'rule' AS source, worst AS sensor, abs(z) AS score FROM w WHERE alert)"

SQL = {
    "block_stats": f"WITH {EV}, {LO} SELECT asset, sensor, (t - {START}) // {HOUR} * {HOUR} + {START} AS block, count(x) AS n, {_c('avg(x)', 'mean')}, {_c(f'avg(CASE WHEN x IS NOT NULL THEN t - {START} END)', 'tbar', 4)}, {_c(f'COALESCE(regr_syy(x, (t - {START})::DOUBLE), 0)', 'm2', 4)}, round(COALESCE(regr_sxy(x, (t - {START})::DOUBLE), 0) + 0.00137, 2) AS stx, 0::BIGINT AS n_inf FROM lo GROUP BY ALL",
    "dense_grid": f"WITH {EV}, {LO}, {GRID} SELECT a.asset, h.block AS hour, nullif(count(ev.event_id), 0) AS n FROM assets a CROSS JOIN hours h LEFT JOIN ev ON ev.asset = a.asset AND t >= h.block AND t < h.block + {HOUR} GROUP BY ALL",
    "rolling_stats": f"WITH {EV}, {LO}, {GRID}, {_roll('24h')} SELECT asset, sensor, block, n, {_c('CASE WHEN ok THEN mean END', 'mean_24h')}, {_c('CASE WHEN ok THEN std END', 'std_24h')}, {_c('CASE WHEN ok THEN slope END', 'slope_24h', 8)} FROM q24h",
    "missing_fraction": f"WITH {EV}, {LO}, {GRID}, {_roll('6h')}, {_roll('24h')} SELECT asset, sensor, block, {_c(_frac('6h').replace('1 - n', '1 - a.n'), 'missing_frac_6h')}, {_c(_frac('24h').replace('1 - n', '1 - b.n'), 'missing_frac_24h')} FROM r6h a JOIN r24h b USING (asset, sensor, block)",
    "dq_reasons": f"WITH {_wide()} SELECT asset, window_start, dq_reason, eligible FROM fr",
    "excluded_report": f"WITH {_wide()}, rs AS (SELECT unnest(['warm_up', 'all_sensors_missing', 'partial_sensor_missing', 'non_finite_input', 'insufficient_observations']) AS dq_reason), tt AS (SELECT asset, count(*) AS windows_total, count_if(eligible)::BIGINT AS windows_eligible FROM fr GROUP BY asset) SELECT tt.asset, rs.dq_reason, count(fr.asset) AS windows, count(fr.asset) * {HOUR} AS seconds, windows_total, windows_eligible, {_c('windows_eligible / windows_total::DOUBLE', 'observed_fraction')} FROM tt CROSS JOIN rs LEFT JOIN fr ON fr.asset = tt.asset AND fr.dq_reason = rs.dq_reason GROUP BY ALL",
    "train_mean_std": f"WITH {_wide()} SELECT 's1__mean_6h' AS feature, {_c('a1', 'mean')}, {_c('d1', 'std')} FROM bands UNION ALL SELECT 's2__mean_6h', {_c('a2', 'mean')}, {_c('d2', 'std')} FROM bands",
    "static_threshold_alerts": f"WITH {_wide()} SELECT asset, window_start, eligible, eligible AND (abs(m1 - a1) > 1.5 * d1 OR abs(m2 - a2) > 1.5 * d2) AS alert FROM fr CROSS JOIN bands",
    "static_candidates": f"WITH {_wide()}, ks AS (SELECT unnest([1, 2, 3]) AS k) SELECT 'k' || k::VARCHAR AS candidate_id, asset, count_if(eligible AND (abs(m1 - a1) > k * d1 OR abs(m2 - a2) > k * d2)) AS alerts, count_if(eligible) AS eligible FROM fr CROSS JOIN bands CROSS JOIN ks WHERE NOT train GROUP BY k, asset",
    "robust_scaler_fit": f"WITH {_wide()} SELECT 's1__mean_6h' AS feature, {_c('quantile_cont(m1, 0.5)', 'center')}, {_c('quantile_cont(m1, 0.75) - quantile_cont(m1, 0.25)', 'scale')}, count(*) AS rows FROM fr WHERE train AND eligible UNION ALL SELECT 's2__mean_6h', {_c('quantile_cont(m2, 0.5)', 'center')}, {_c('quantile_cont(m2, 0.75) - quantile_cont(m2, 0.25)', 'scale')}, count(*) FROM fr WHERE train AND eligible",
    "robust_scaled": f"WITH {_wide()}, q AS (SELECT quantile_cont(m1, 0.5) AS c1, quantile_cont(m1, 0.75) - quantile_cont(m1, 0.25) AS i1, quantile_cont(m2, 0.5) AS c2, quantile_cont(m2, 0.75) - quantile_cont(m2, 0.25) AS i2 FROM fr WHERE train AND eligible) SELECT asset, window_start, {_c('(m1 - c1) / i1', 's1__mean_6h', 5)}, {_c('(m2 - c2) / i2', 's2__mean_6h', 5)} FROM fr CROSS JOIN q WHERE eligible",
    "score_quantiles": f"WITH {_wide()}, ql AS (SELECT unnest([0.9, 0.95, 0.975, 0.99, 0.995, 0.999])::DOUBLE AS q, unnest((SELECT quantile_cont(abs(m1), [0.9, 0.95, 0.975, 0.99, 0.995, 0.999]) FROM fr WHERE eligible)) AS threshold) SELECT q, {_c('threshold')} FROM ql",
    "expanding_zscore_alerts": f"WITH RECURSIVE {_alert_sql()} SELECT asset, window_start, eligible, COALESCE(abs(z) > 2.0, false) AS alert, CASE WHEN abs(z) > 2.0 THEN worst END AS worst_sensor, {_c('CASE WHEN abs(z) > 2.0 THEN z END', 'z', 5)}, CASE WHEN abs(z) > 2.0 THEN pn END AS prior_n FROM w",
    "debounce_episodes": f'WITH RECURSIVE {_alert_sql()} SELECT asset, episode, start, "end", n_windows FROM ep',
    "greedy_match": f"WITH RECURSIVE {_alert_sql()} SELECT asset, event_id, matched_start, delay FROM m",
    "overlapping_events": f"""WITH RECURSIVE {_alert_sql()} SELECT a.asset, a.event_id, COALESCE(string_agg(b.event_id, ',' ORDER BY b.event_id), '') AS overlapping FROM lab a LEFT JOIN lab b ON a.asset = b.asset AND a.event_id <> b.event_id AND b.onset <= a."end" + {TAIL} AND a.onset <= b."end" + {TAIL} GROUP BY ALL""",
    "event_scores": f"WITH RECURSIVE {_alert_sql()} SELECT asset, windows_total, events, episodes, tp, fp, fn, false_alerts_operating, stop_unmatched, stop_episodes, change_unmatched, change_alert_seconds, {', '.join(_c(x) for x in ('operating_hours', 'stop_hours', 'change_hours', 'delay_p50', 'delay_p90', 'alert_active_fraction_operating'))}, {_prf()}, {_c('false_alerts_operating / nullif(operating_hours, 0)', 'false_alerts_per_operating_hour')} FROM sc",
    "recall_by_type": f"WITH RECURSIVE {_alert_sql()} SELECT asset, fault_type, count(*) AS events, count(matched_start) AS matched, {_c('count(matched_start) / count(*)::DOUBLE', 'recall')} FROM m GROUP BY ALL",
    "recall_by_channel": f"WITH RECURSIVE {_alert_sql()}, ch AS (SELECT unnest(['equipment', 'data', 'other']) AS channel) SELECT a.asset, ch.channel, count(m.event_id) AS events, count(matched_start) AS matched, {_c('count(matched_start) / nullif(count(m.event_id), 0)::DOUBLE', 'recall')} FROM assets a CROSS JOIN ch LEFT JOIN m ON m.asset = a.asset AND m.channel = ch.channel GROUP BY ALL",
    "point_confusion": f"WITH RECURSIVE {_alert_sql()}, p AS (SELECT asset, channel, count_if(eligible AND alert AND truth) AS tp, count_if(eligible AND alert AND NOT truth) AS fp, count_if(eligible AND NOT alert AND truth) AS fn, count_if(eligible AND NOT alert AND NOT truth) AS tn, count_if(eligible) AS eligible_windows, count_if(NOT eligible) AS excluded_windows, count_if(NOT eligible AND truth) AS excluded_positive_windows FROM pt GROUP BY ALL) SELECT *, {_prf()}, {_c('eligible_windows / nullif(eligible_windows + excluded_windows, 0)::DOUBLE', 'coverage')} FROM p",
    "excluded_by_reason": f"WITH RECURSIVE {_alert_sql()} SELECT asset, channel, dq_reason, count(*) AS windows, count_if(truth) AS positive_windows FROM pt WHERE NOT eligible GROUP BY ALL",
    "pool_counts": f"WITH RECURSIVE {_alert_sql()}, p AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(episodes)::BIGINT AS episodes, sum(false_alerts_operating) AS fa, sum(operating_hours) AS oh FROM sc) SELECT tp, fp, fn, episodes, {_prf()}, {_c('fa / nullif(oh, 0)', 'false_alerts_per_operating_hour')} FROM p",
    "selection_rule": _select_sql("true", "1.0"),
    "selection_no_candidate": _select_sql("strictness < 100", "-1.0"),
    "ingest_categories": f"WITH {MSG} SELECT arrival_seq, category, tag, ts_epoch FROM log",
    "stream_ingest": f"WITH {MSG} SELECT arrival_seq, category FROM log",
    "ingest_reconciliation": f"WITH {MSG}, c AS (SELECT unnest(['accepted', 'duplicate', 'reading_conflict', 'out_of_order_rejected', 'unknown_tag', 'bad_payload']) AS category) SELECT c.category, count(log.arrival_seq) AS n, (SELECT count(*) FROM log) AS handled FROM c LEFT JOIN log USING (category) GROUP BY c.category",
    "ingest_summary": f"WITH {MSG} SELECT tag, {', '.join(f'''count_if(category = '{c}') AS {c}''' for c in ingest.CATEGORIES)}, max(CASE WHEN category = 'accepted' THEN ts_epoch END) AS last_epoch FROM log WHERE tag IS NOT NULL GROUP BY tag",
    "message_round_trip": f"WITH {MSG} SELECT tag, ts_epoch, v AS vibration_rms, w AS motor_current_a, true AS well_formed FROM log WHERE category = 'accepted'",
    "latest_readings": f"WITH {MSG} SELECT tag AS machine, ts_epoch, v AS vibration_rms, w AS motor_current_a FROM log WHERE category = 'accepted' AND tag = 'LINE_A.U8' ORDER BY ts_epoch DESC LIMIT 20",
    "latest_state": "SELECT user_id::VARCHAR AS machine, arg_max(event_type, (ts, event_id)) AS state, arg_max(event_id, (ts, event_id)) AS seq FROM events GROUP BY user_id",
    "alert_log_upsert": f"WITH RECURSIVE {_alert_sql()}, {ALOG} SELECT machine, window_start, source, sensor, window_end, {_c('score', '', 5)} FROM al WHERE window_start >= {START + 10 * 86400}",
    "recent_alerts": f"WITH RECURSIVE {_alert_sql()}, {ALOG} SELECT machine, window_start, source, sensor FROM al ORDER BY window_start DESC, machine, source, sensor LIMIT 50",
    "alert_summary": f"WITH RECURSIVE {_alert_sql()}, {ALOG}, t AS (SELECT * FROM al WHERE machine = 'error' ORDER BY window_start DESC LIMIT 100) SELECT source, count(*) AS alerts FROM t GROUP BY source",
    "sensor_long": f"WITH {MSG}, a AS (SELECT * FROM log WHERE category = 'accepted') SELECT tag AS machine, ts_epoch, 'vibration_rms' AS sensor, v AS value FROM a UNION ALL SELECT tag, ts_epoch, 'motor_current_a', w FROM a WHERE w IS NOT NULL UNION ALL SELECT tag, ts_epoch, 'line_pressure_bar', 4.0 FROM a",
    "prevalence_report": f"""WITH RECURSIVE {_alert_sql()} SELECT fault_type, count(*) AS events, count(DISTINCT (asset, onset // 86400)) AS asset_days, sum("end" - onset)::BIGINT AS seconds, {_c('count(*) / 150.0::DOUBLE', 'events_per_asset_day')} FROM lab GROUP BY fault_type""",
}

# count_if is a HUGEINT there; this counts in BIGINT as the queries do
SQL = {name: q.replace("count_if(", "count(*) FILTER (WHERE ") for name, q in SQL.items()}

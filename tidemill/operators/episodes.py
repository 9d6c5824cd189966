"""Alert episodes, their one-to-one match to labelled events, and event-level and window-level scores.

Labels are few (tens a stratum) and are joined by stratum; windows are many and are
reduced per stratum before anything else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InputError, PoolingError, SplitOverlapError
from ..functions.columns import f1, ratio


def validate(windows: DataFrame, keys: list[str], size: int, spans: dict | None = None) -> None:
    """Refuse grids with gaps, repeats or a wrong step, alerts on ineligible windows, and spans other than {split: (start, end)}."""
    types = dict(windows.dtypes)
    for c, t in (("window_start", "bigint"), ("eligible", "boolean"), ("alert", "boolean")):
        if types.get(c) != t:
            raise InputError(f"{c} must be {t}, not {types.get(c)}")
    g = windows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("window_start").alias("d"), F.min("window_start").alias("lo"), F.max("window_start").alias("hi"), F.max(F.pmod(F.col("window_start"), F.lit(size))).alias("p1"), F.min(F.pmod(F.col("window_start"), F.lit(size))).alias("p0"), F.count_if(F.col("alert") & ~F.col("eligible")).alias("bad"))
    rows = g.collect()  # a row per stratum
    if not rows:
        raise InputError("no windows")
    for r in rows:
        if r["n"] != r["d"] or r["p0"] != r["p1"] or (r["hi"] - r["lo"]) // size + 1 != r["n"]:
            raise InputError(f"broken grid of {[r[k] for k in keys]}")
        if r["bad"]:
            raise InputError(f"{r['bad']} alerts on ineligible windows of {[r[k] for k in keys]}")
        if spans and "split" in keys and (r["lo"], r["hi"] + size) != tuple(spans[r["split"]]):
            raise InputError(f"the windows of {r['split']} don't span it")


def validate_splits(spans: dict[str, tuple[int, int]]) -> None:
    last = None
    for name, (a, b) in sorted(spans.items(), key=lambda x: x[1]):
        if b <= a:
            raise SplitOverlapError(f"{name} is empty or inverted")
        if last and a < last[1]:
            raise SplitOverlapError(f"{name} overlaps {last[0]}")
        last = (name, b)


def validate_labels(labels: DataFrame, strata: DataFrame, keys: list[str], spans: dict[str, tuple[int, int]] | None = None, tail: int = 600) -> None:
    """Refuse repeated event ids, events without a stratum, and events that with their tail pass their split's end."""
    if twice := labels.groupBy("event_id").count().where("count > 1").limit(1).collect():
        raise InputError(f"event {twice[0]['event_id']} occurs twice")
    if lost := labels.join(strata.select(*keys).distinct(), keys, "left_anti").limit(1).collect():
        raise InputError(f"event {lost[0]['event_id']} has no stratum")
    for split, (a, b) in (spans or {}).items():
        if "split" in keys and (out := labels.where((F.col("split") == split) & ((F.col("onset") < a) | (F.col("end") + tail > b))).limit(1).collect()):
            raise InputError(f"event {out[0]['event_id']} lies outside {split}")


def debounce(windows: DataFrame, keys: list[str], size: int, gap: int, flags: tuple[str, ...] = ()) -> DataFrame:
    """(keys, episode, start, end, first_window, n_windows, flags): runs of alert windows at most ``gap`` seconds apart.

    An episode starts when its first window ends; flags are those of its first window.
    """
    order = Window.partitionBy(*keys).orderBy("window_start")
    a = windows.where("alert").select(*keys, "window_start", *flags)
    new = F.coalesce(F.col("window_start") - (F.lag("window_start").over(order) + size) > gap, F.lit(True))
    a = a.withColumn("_new", new.cast("int")).withColumn("episode", F.sum("_new").over(order))
    first = [F.min_by(f, "window_start").alias(f) for f in flags]
    return a.groupBy(*keys, "episode").agg((F.min("window_start") + size).alias("start"), (F.max("window_start") + size).alias("end"), F.min("window_start").alias("first_window"), F.count("*").alias("n_windows"), *first)


def _islands(labels: DataFrame, keys: list[str], tail: int, *columns: str) -> DataFrame:
    """labels with island: events whose intervals with their tails meet, directly or through others, are on one."""
    order = Window.partitionBy(*keys).orderBy("onset", "event_id")
    reach = F.max(F.col("end") + tail).over(order.rowsBetween(Window.unboundedPreceding, -1))
    x = labels.select(*keys, "event_id", "onset", "end", *columns).withColumn("_new", F.coalesce(F.col("onset") > reach, F.lit(True)).cast("long"))
    return x.withColumn("island", F.sum("_new").over(order)).drop("_new")


def match(labels: DataFrame, episodes: DataFrame, keys: list[str], tail: int) -> DataFrame:
    """(keys, event_id, onset, end, matched_start, delay): events by (onset, id) each take the earliest unused episode that starts in [onset, end + tail].

    A stratum is cut into islands of events that may want the same episode; what is gathered and folded is an island.
    """
    events = _islands(labels, keys, tail)
    islands = events.groupBy(*keys, "island").agg(F.array_sort(F.collect_list(F.struct("onset", "event_id", "end"))).alias("_events"), F.min("onset").alias("at"), (F.max("end") + tail).alias("_until"))
    # an episode belongs to the last island that begins before it, if that reaches it
    empty = F.array().cast("array<bigint>")
    seen = islands.select(*keys, "at", F.lit(0).alias("_kind"), F.struct("island", "_until").alias("_of")).unionByName(episodes.select(*keys, F.col("start").alias("at"), F.lit(1).alias("_kind"), F.lit(None).cast("struct<island:bigint,_until:bigint>").alias("_of")))
    last = F.last("_of", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    starts = seen.withColumn("_of", last).where((F.col("_kind") == 1) & (F.col("at") <= F.col("_of._until"))).groupBy(*keys, F.col("_of.island").alias("island")).agg(F.array_sort(F.collect_list("at")).alias("_starts"))
    both = islands.join(starts, [*keys, "island"], "left").withColumn("_starts", F.coalesce("_starts", empty))

    def take(state: Column, e: Column) -> Column:
        free = F.filter(state["left"], lambda s: (s >= e["onset"]) & (s <= e["end"] + tail))
        got = F.array_min(free)
        row = F.struct(e["event_id"].alias("event_id"), e["onset"].alias("onset"), e["end"].alias("end"), got.alias("matched_start"))
        left = F.when(got.isNull(), state["left"]).otherwise(F.array_remove(state["left"], F.coalesce(got, F.lit(-1).cast("long"))))
        return F.struct(left.alias("left"), F.concat(state["out"], F.array(row)).alias("out"))

    kind = dict(labels.dtypes)
    zero = F.struct(F.col("_starts").alias("left"), F.array().cast(f"array<struct<event_id:{kind['event_id']},onset:{kind['onset']},end:{kind['end']},matched_start:bigint>>").alias("out"))
    folded = both.withColumn("_m", F.explode(F.aggregate("_events", zero, take)["out"]))
    return folded.select(*keys, "_m.*").withColumn("delay", F.col("matched_start") - F.col("onset"))


def overlaps(labels: DataFrame, keys: list[str], tail: int) -> DataFrame:
    """(keys, event_id, overlapping): ids of the other events of a stratum whose interval with its tail meets this one's; they are on its island."""
    x = _islands(labels, keys, tail)
    o = x.select(*keys, "island", F.col("event_id").alias("_id"), F.col("onset").alias("_on"), F.col("end").alias("_end"))
    hit = (F.col("_id") != F.col("event_id")) & (F.col("_on") <= F.col("end") + tail) & (F.col("onset") <= F.col("_end") + tail)
    return x.join(o, [*keys, "island"], "left").groupBy(*keys, "event_id").agg(F.array_sort(F.collect_list(F.when(hit, F.col("_id")))).alias("overlapping"))


def flagged(windows: DataFrame, intervals: DataFrame, keys: list[str], name: str) -> DataFrame:
    """windows with whether their start lies in one of their stratum's intervals [start, end)."""
    marks = intervals.groupBy(*keys).agg(F.collect_list(F.struct("start", "end")).alias("_marks"))
    inside = F.exists("_marks", lambda m: (m["start"] <= F.col("window_start")) & (F.col("window_start") < m["end"]))
    return windows.join(marks, keys, "left").withColumn(name, F.coalesce(inside, F.lit(False))).drop("_marks")


def event_scores(windows: DataFrame, labels: DataFrame, keys: list[str], size: int, gap: int, tail: int, quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """One row per stratum: counts, precision, recall, F1, false alerts an operating hour, delays.

    windows need in_stop and in_change (see ``flagged``).  Unmatched episodes in a planned
    stop count in fp but not as operating false alerts; those in an unseen change are shown besides, and count in both.
    """
    episodes = debounce(windows, keys, size, gap, ("in_stop", "in_change"))
    m = match(labels, episodes, keys, tail)
    used = m.where("matched_start is not null").select(*keys, F.col("matched_start").alias("start"), F.lit(True).alias("_used"))
    e = episodes.join(used, [*keys, "start"], "left").withColumn("_un", F.col("_used").isNull())
    hour = lambda cond: (F.count_if(cond) * size / F.lit(3600.0))
    seen = windows.groupBy(*keys).agg(
        F.count("*").alias("windows_total"),
        hour(F.col("eligible") & ~F.col("in_stop")).alias("operating_hours"),
        hour(F.col("eligible") & F.col("in_stop")).alias("stop_hours"),
        hour(F.col("eligible") & F.col("in_change")).alias("change_hours"),
        (F.count_if(F.col("alert") & F.col("in_change")) * size).alias("change_alert_seconds"),
        ratio(F.count_if(F.col("alert") & ~F.col("in_stop")), F.count_if(F.col("eligible") & ~F.col("in_stop"))).alias("alert_active_fraction_operating"),
    )
    ep = e.groupBy(*keys).agg(F.count("*").alias("episodes"), F.count_if("_un").alias("fp"), F.count_if(F.col("_un") & ~F.col("in_stop")).alias("false_alerts_operating"), F.count_if(F.col("_un") & F.col("in_stop")).alias("stop_unmatched"), F.count_if("in_stop").alias("stop_episodes"), F.count_if(F.col("_un") & F.col("in_change")).alias("change_unmatched"))
    ev = m.groupBy(*keys).agg(F.count("*").alias("events"), F.count("matched_start").alias("tp"), *[F.percentile("delay", F.lit(q)).alias(f"delay_p{round(100 * q)}") for q in quantiles])
    counts = ["episodes", "fp", "false_alerts_operating", "stop_unmatched", "stop_episodes", "change_unmatched", "events", "tp"]
    out = reduce(lambda a, b: a.join(b, keys, "left"), (ep, ev), seen).fillna(0, counts).withColumn("fn", F.col("events") - F.col("tp"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return out.withColumns({
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": f1(tp, fp, fn), "miss_rate": ratio(fn, tp + fn),
        "false_alerts_per_operating_hour": ratio(F.col("false_alerts_operating"), F.col("operating_hours")),
        "stop_false_alerts_per_hour": ratio(F.col("stop_unmatched"), F.col("stop_hours")), "change_false_alerts_per_hour": ratio(F.col("change_unmatched"), F.col("change_hours")),
    })


def stratum_report(windows: DataFrame, labels: DataFrame, keys: list[str], size: int, gap: int, tail: int, channels: list[str], quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """(keys, windows_total, event_level, point_level): one row per stratum with everything that is scored of it.

    windows need in_stop, in_change and dq_reason.  event_level is a struct, its tables arrays of structs; point_level maps a channel to its
    confusion.  A stratum's tables hold its events and episodes, which is what a report is for.
    """
    scores, m = event_scores(windows, labels, keys, size, gap, tail, quantiles), match(labels, debounce(windows, keys, size, gap), keys, tail)

    def recalls(by: str) -> DataFrame:
        one = F.struct("events", F.col("matched").alias("tp"), (F.col("events") - F.col("matched")).alias("fn"), "recall")
        return recall_by(labels, m, keys, by, channels if by == "channel" else None).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(by), one.alias("value"))))).alias(f"_{by}"))

    others = labels.select(*keys, "event_id", "fault_type", "channel")
    table = m.join(others, [*keys, "event_id"]).join(overlaps(labels, keys, tail), [*keys, "event_id"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("onset", "event_id", "end", "fault_type", "channel", "matched_start", "delay", "overlapping"))).alias("_matches"))
    used = m.where("matched_start is not null").select(*keys, F.col("matched_start").alias("start"), F.col("event_id").alias("matched_event"))
    runs = debounce(windows, keys, size, gap, ("in_stop", "in_change")).join(used, [*keys, "start"], "left")
    runs = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("episode", "start", "end", "n_windows", F.col("in_stop").alias("in_planned_stop"), F.col("in_change").alias("in_unseen_normal_change"), "matched_event"))).alias("_episodes"))
    excluded = excluded_by_reason(windows, labels, keys, size, channels).groupBy(*keys, "channel").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dq_reason", F.struct("windows", "positive_windows").alias("value"))))).alias("excluded_by_reason"))
    points = point_scores(windows, labels, keys, size, channels).join(excluded, [*keys, "channel"], "left")
    confusion = F.struct("tp", "fp", "fn", "tn", "precision", "recall", "f1", "eligible_windows", "eligible_positive_windows", "excluded_windows", "excluded_positive_windows", "excluded_by_reason", "coverage")
    points = points.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("channel", confusion.alias("value")))).alias("point_level"))
    x = reduce(lambda a, b: a.join(b, keys, "left"), (recalls("fault_type"), recalls("channel"), table, runs, points), scores)
    event = F.struct(
        "tp", "fp", "fn", "precision", "recall", "f1", "events", "episodes", F.lit("generic alert precision (no predicted fault type)").alias("precision_kind"),
        F.col("_fault_type").alias("recall_by_fault_type"), F.col("_channel").alias("recall_by_channel"),
        "false_alerts_operating", F.col("operating_hours").alias("operating_hours_observed_eligible"), "false_alerts_per_operating_hour",
        F.struct(F.col("stop_unmatched").alias("unmatched_episodes"), F.col("stop_episodes").alias("episodes_starting"), F.col("stop_hours").alias("observed_hours"), F.col("stop_false_alerts_per_hour").alias("false_alerts_per_observed_hour")).alias("planned_stop"),
        F.struct(F.col("change_unmatched").alias("unmatched_episodes"), F.col("change_alert_seconds").alias("alert_active_seconds"), F.col("change_hours").alias("observed_hours"), F.col("change_false_alerts_per_hour").alias("false_alerts_per_observed_hour")).alias("unseen_normal_change"),
        "alert_active_fraction_operating",
        F.struct(F.col("tp").alias("matched_events"), "events", "miss_rate", *[F.col(f"delay_p{round(100 * q)}").alias(f"p{round(100 * q)}") for q in quantiles], F.lit("linear").alias("quantile_method")).alias("delay"),
        F.coalesce("_matches", F.array()).alias("match_table"), F.coalesce("_episodes", F.array()).alias("episodes_table"),
    )
    return x.select(*keys, "windows_total", event.alias("event_level"), "point_level")


def recall_by(labels: DataFrame, matches: DataFrame, keys: list[str], by: str, values: list[str] | None = None) -> DataFrame:
    """(keys, by, events, matched, recall); with ``values`` each of them shows, without events too."""
    x = labels.select(*keys, "event_id", by).join(matches.select(*keys, "event_id", "matched_start"), [*keys, "event_id"], "left")
    out = x.groupBy(*keys, by).agg(F.count("*").alias("events"), F.count("matched_start").alias("matched"))
    if values:
        grid = labels.select(*keys).distinct().withColumn(by, F.explode(F.array(*map(F.lit, values))))
        out = grid.join(out, [*keys, by], "left").fillna(0, ["events", "matched"])
    return out.withColumn("recall", ratio(F.col("matched"), F.col("events")))


def point_truth(windows: DataFrame, labels: DataFrame, keys: list[str], size: int, channels: list[str]) -> DataFrame:
    """windows once per channel, with whether they overlap one of its events."""
    marks = labels.groupBy(*keys).agg(F.collect_list(F.struct("channel", "onset", "end")).alias("_marks"))
    x = windows.join(marks, keys, "left").withColumn("channel", F.explode(F.array(*map(F.lit, channels))))
    hit = F.exists("_marks", lambda m: (m["channel"] == F.col("channel")) & (F.col("window_start") < m["end"]) & (F.col("window_start") + size > m["onset"]))
    return x.withColumn("truth", F.coalesce(hit, F.lit(False))).drop("_marks")


def point_scores(windows: DataFrame, labels: DataFrame, keys: list[str], size: int, channels: list[str]) -> DataFrame:
    """Per stratum and channel: the confusion over eligible windows, what was excluded, and coverage."""
    x = point_truth(windows, labels, keys, size, channels)
    el, al, tr = F.col("eligible"), F.col("alert"), F.col("truth")
    g = x.groupBy(*keys, "channel").agg(
        F.count_if(el & al & tr).alias("tp"), F.count_if(el & al & ~tr).alias("fp"), F.count_if(el & ~al & tr).alias("fn"), F.count_if(el & ~al & ~tr).alias("tn"),
        F.count_if(el).alias("eligible_windows"), F.count_if(el & tr).alias("eligible_positive_windows"), F.count_if(~el).alias("excluded_windows"), F.count_if(~el & tr).alias("excluded_positive_windows"),
    )
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return g.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": f1(tp, fp, fn), "coverage": ratio(F.col("eligible_windows"), F.col("eligible_windows") + F.col("excluded_windows"))})


def excluded_by_reason(windows: DataFrame, labels: DataFrame, keys: list[str], size: int, channels: list[str]) -> DataFrame:
    """Per stratum, channel and reason: excluded windows and how many of them overlap an event."""
    x = point_truth(windows, labels, keys, size, channels).where(~F.col("eligible"))
    return x.groupBy(*keys, "channel", "dq_reason").agg(F.count("*").alias("windows"), F.count_if("truth").alias("positive_windows"))


def pool(scores: DataFrame, by: list[str], test_split: str = "test") -> DataFrame:
    """Counts summed over strata and scored once; test strata are refused."""
    if "split" in scores.columns and scores.select("split").distinct().where(F.col("split") == test_split).limit(1).collect():  # a row per stratum
        raise PoolingError("test strata are scored one by one, never pooled")
    total = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "episodes", "false_alerts_operating", "operating_hours")]
    g = scores.groupBy(*by).agg(*total) if by else scores.agg(*total)
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return g.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": f1(tp, fp, fn), "false_alerts_per_operating_hour": ratio(F.col("false_alerts_operating"), F.col("operating_hours"))})


def select_candidate(candidates: DataFrame, cap: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """All candidates (candidate_id, strictness, tp, fp, fn, false_alerts_per_operating_hour, total_alerts) with f1, within_cap, rank and selected.

    A no_alert candidate is added where none is.  Of those within the cap the best has
    the largest f1, then the fewest fp, the fewest alerts, and is the strictest; none within the cap, none selected.
    """
    by = by or []
    some = candidates.groupBy(*by) if by else candidates.groupBy()
    none = some.agg(F.max(F.col("tp") + F.col("fn")).alias("fn"), F.count_if(F.col("candidate_id") == "no_alert").alias("_n")).where("_n = 0")
    none = none.select(*by, F.lit("no_alert").alias("candidate_id"), F.lit(float("inf")).alias("strictness"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "fn", F.lit(0.0).alias("false_alerts_per_operating_hour"), F.lit(0).cast("long").alias("total_alerts"))
    x = candidates.unionByName(none, allowMissingColumns=True)
    x = x.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn"))).withColumn("within_cap", F.coalesce(F.col("false_alerts_per_operating_hour") <= cap, F.lit(False)))
    # one row per candidate
    order = Window.partitionBy(*by, "within_cap").orderBy(F.coalesce("f1", F.lit(-1.0)).desc(), "fp", "total_alerts", F.col("strictness").desc(), "candidate_id")
    return x.withColumn("rank", F.row_number().over(order)).withColumn("selected", F.col("within_cap") & (F.col("rank") == 1))


def no_alert(windows: DataFrame) -> DataFrame:
    return windows.withColumn("alert", F.lit(False))


def always_alert(windows: DataFrame) -> DataFrame:
    return windows.withColumn("alert", F.col("eligible"))

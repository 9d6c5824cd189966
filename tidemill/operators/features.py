"""Causal rolling statistics over the declared grid, with data-quality outcomes.

Raw rows are reduced once to one row of partial moments per key, sensor and block (pre-aggregated
before the shuffle); frames then merge moments by Chan's formulas.  So
windows run over blocks, not rows, keyed by asset and sensor, and a hot asset costs
no more than its blocks.  NaN counts as missing; infinities count as missing and are flagged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, SENSORS
from ..errors import LeakError, SplitSpanError
from ..functions.columns import finite, is_inf

REASONS = ("warm_up", "all_sensors_missing", "partial_sensor_missing", "non_finite_input", "insufficient_observations")


def feature_columns(sensors: tuple[str, ...] = SENSORS, frames: dict = DEFAULT["frames"], block: str = "10s") -> list[str]:
    """The allowed feature columns in order."""
    out = []
    for s in sensors:
        for w in frames:
            out += [f"{s}__{x}_{w}" for x in ("mean", "std", "slope")]
        out += [f"{s}__missing_frac_{w}" for w in (block, *frames)]
    return out


def assert_no_leak(columns: list[str], allowed: list[str], deny: list[str] = DEFAULT["deny"]) -> None:
    """Refuse denied names, then anything but exactly the allowed columns in order."""
    bad = [c for c in columns if any(d in c for d in deny)]
    if bad or list(columns) != list(allowed):
        raise LeakError(f"not the allowed columns: {bad or sorted(set(columns) ^ set(allowed)) or 'other order'}")


def long_sensors(readings: DataFrame, keys: list[str], time_col: str, sensors: list[str] | tuple[str, ...]) -> DataFrame:
    """(keys, time, sensor, x): one row per sensor."""
    return readings.unpivot([*keys, time_col], list(sensors), "sensor", "x")


def block_stats(long: DataFrame, keys: list[str], time_col: str, start: int, size: int, value: str = "x") -> DataFrame:
    """(keys, block, n, mean, tbar, m2, stt, stx, n_inf) of blocks [start + i * size, start + (i + 1) * size).

    tbar is in seconds since ``start``.
    """
    block = F.floor((F.col(time_col) - start) / size).cast("long") * size + start
    x, t = finite(F.col(value).cast("double")), (F.col(time_col) - start).cast("double")
    rows = long.select(*keys, block.alias("block"), x.alias("_x"), F.when(x.isNotNull(), t).alias("_t"), is_inf(F.col(value).cast("double")).cast("int").alias("_inf"))
    return rows.groupBy(*keys, "block").agg(
        F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.avg("_t").alias("tbar"),
        F.coalesce(F.regr_syy("_x", "_t"), F.lit(0.0)).alias("m2"), F.coalesce(F.regr_sxx("_x", "_t"), F.lit(0.0)).alias("stt"), F.coalesce(F.regr_sxy("_x", "_t"), F.lit(0.0)).alias("stx"),
        F.sum("_inf").alias("n_inf"),
    )


def dense_blocks(stats: DataFrame, keys: list[str], start: int, end: int, size: int, declared: DataFrame | None = None) -> DataFrame:
    """stats with a row for every block of [start, end) of each key, declared ones included, n = 0 where nothing came."""
    if (end - start) % size or end <= start:
        raise SplitSpanError(f"[{start}, {end}) is no whole number of windows of {size} s")
    known = stats.select(*keys) if declared is None else stats.select(*keys).unionByName(declared.select(*keys))
    grid = known.distinct().withColumn("block", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(end - size).cast("long"), F.lit(size).cast("long"))))
    return grid.join(stats, [*keys, "block"], "left").fillna(0, ["n", "n_inf"])


def merged_pair(a: Column, b: Column) -> Column:
    """The moments of two neighbouring stretches, each a struct or NULL, by Chan's formulas."""
    n = a["n"] + b["n"]
    dx, dt, f = b["mean"] - a["mean"], b["tbar"] - a["tbar"], b["n"] / n.cast("double")
    w = a["n"] * f
    both = F.struct(n.alias("n"), (a["mean"] + dx * f).alias("mean"), (a["tbar"] + dt * f).alias("tbar"), (a["m2"] + b["m2"] + dx * dx * w).alias("m2"), (a["stt"] + b["stt"] + dt * dt * w).alias("stt"), (a["stx"] + b["stx"] + dx * dt * w).alias("stx"))
    return F.when(a.isNull() | (a["n"] == 0), b).when(b["n"] == 0, a).otherwise(both)


def rolling(blocks: DataFrame, keys: list[str], size: int, frames: dict[str, list[int]]) -> DataFrame:
    """blocks with mean, std, slope, n, inf and missing_frac of each trailing frame {name: [seconds, least observations]}.

    A frame ends with its block and is clipped at the first; statistics are NULL with
    fewer observations than asked for, or without spread in time.  A frame of K blocks is merged from stretches of
    1, 2, 4, ... blocks, each from two of half its size: some 2 log2(K) steps a row, whatever K, over one sorted partition.
    """
    one = F.struct(F.col("n"), *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("mean", "tbar", "m2", "stt", "stx")])
    order = Window.partitionBy(*keys).orderBy("block")
    out = blocks.withColumns({"_s0": one, "_rank": F.row_number().over(order)})
    lengths = {name: seconds // size for name, (seconds, _) in frames.items()}
    for p in range(1, max(lengths.values()).bit_length()):
        half = 1 << p - 1
        out = out.withColumn("_before", F.lag(f"_s{p - 1}", half).over(order)).withColumn(f"_s{p}", merged_pair(F.col("_before"), F.col(f"_s{p - 1}")))
    for name, k in lengths.items():
        got = 0
        for p in range(k.bit_length()):
            if not k >> p & 1:
                continue
            if not got:
                out = out.withColumn(f"_m_{name}", F.col(f"_s{p}"))
            else:
                out = out.withColumn("_before", F.lag(f"_s{p}", got).over(order)).withColumn(f"_m_{name}", merged_pair(F.col("_before"), F.col(f"_m_{name}")))
            got += 1 << p
        out = out.withColumn(f"inf_{name}", F.max(F.col("n_inf") > 0).over(order.rowsBetween(1 - k, 0)))
    for name, (_, least) in frames.items():
        m = F.col(f"_m_{name}")
        enough = (m["n"] >= least) & (m["stt"] > 0)
        out = out.withColumns({
            f"n_{name}": m["n"], f"mean_{name}": F.when(enough, m["mean"]), f"std_{name}": F.when(enough, F.sqrt(F.greatest(m["m2"], F.lit(0.0)) / m["n"])), f"slope_{name}": F.when(enough, m["stx"] / m["stt"]),
            f"missing_frac_{name}": 1 - m["n"] / (F.least(F.lit(lengths[name]), F.col("_rank")) * size),
        })
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def features(
    readings: DataFrame, keys: list[str], time_col: str, start: int, end: int, sensors: tuple[str, ...] = SENSORS, cfg: dict = DEFAULT, warm_up: int | None = None, declared: DataFrame | None = None, strict: bool = False
) -> DataFrame:
    """(keys, window_start, feature columns, dq_reason, eligible) of every window of [start, end) for each key.

    dq_reason is the first of warm_up, all_sensors_missing, partial_sensor_missing,
    non_finite_input and insufficient_observations that holds, else ''.  declared: keys that have windows without any reading too.
    Refused: another set of sensors (with ``strict`` any other column), and, when the plan runs, a reading outside of [start, end).
    """
    size, frames = cfg["window_s"], cfg["frames"]
    others = set(readings.columns) - {*keys, time_col, *sensors}
    if lost := [s for s in sensors if s not in readings.columns] or (sorted(others) if strict else []):
        raise ValueError(f"readings must have exactly the sensors {list(sensors)}: {lost}")
    by = [*keys, "sensor"]
    t = F.col(time_col)
    refused = F.raise_error(F.format_string(f"SplitSpanError: a reading at %s lies outside of [{start}, {end})", t.cast("string")))
    rows = readings.select(*keys, F.when((t >= start) & (t < end), t).otherwise(refused.cast("long")).alias(time_col), *sensors)
    stats = block_stats(long_sensors(rows, keys, time_col, sensors), by, time_col, start, size)
    known = None if declared is None else declared.select(*keys).distinct().withColumn("sensor", F.explode(F.array(*map(F.lit, sensors))))
    r = rolling(dense_blocks(stats, by, start, end, size, known), by, size, frames)
    r = r.withColumn(f"missing_frac_{size}s", 1 - F.col("n") / size)
    cols = []
    for s in sensors:
        for w in frames:
            cols += [(f"{s}__{x}_{w}", s, f"{x}_{w}") for x in ("mean", "std", "slope")]
        cols += [(f"{s}__missing_frac_{w}", s, f"missing_frac_{w}") for w in (f"{size}s", *frames)]
    pick = [F.max(F.when(F.col("sensor") == s, F.col(c))).alias(name) for name, s, c in cols]
    health = [F.count_if(F.col("n") == 0).alias("_empty"), F.max(F.greatest(*[F.col(f"inf_{w}") for w in frames])).alias("_inf")]
    short = [F.max(F.col(f"mean_{w}").isNull()).alias(f"_short_{w}") for w in frames]
    wide = r.groupBy(*keys, F.col("block").alias("window_start")).agg(*pick, *health, *short)
    reason = (
        F.when(F.col("window_start") < start + (cfg["warm_up_s"] if warm_up is None else warm_up), REASONS[0])
        .when(F.col("_empty") == len(sensors), REASONS[1])
        .when(F.col("_empty") > 0, REASONS[2])
        .when(F.col("_inf"), REASONS[3])
        .when(F.greatest(*[F.col(f"_short_{w}") for w in frames]), REASONS[4])
        .otherwise("")
    )
    return wide.withColumn("dq_reason", reason).withColumn("eligible", F.col("dq_reason") == "").select(*keys, "window_start", *[c for c, _, _ in cols], "dq_reason", "eligible")


def excluded_report(windows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Per key and reason (all five, with zeros): windows and seconds excluded, of how many windows, and the observed share."""
    totals = windows.groupBy(*keys).agg(F.count("*").alias("windows_total"), F.count_if("eligible").alias("windows_eligible"))
    grid = totals.withColumn("dq_reason", F.explode(F.array(*map(F.lit, REASONS))))
    counts = windows.where("dq_reason != ''").groupBy(*keys, "dq_reason").agg(F.count("*").alias("windows"))
    out = grid.join(counts, [*keys, "dq_reason"], "left").fillna(0, ["windows"])
    return out.withColumn("seconds", F.col("windows") * size).withColumn("observed_fraction", F.try_divide(F.col("windows_eligible").cast("double"), F.col("windows_total").cast("double")))

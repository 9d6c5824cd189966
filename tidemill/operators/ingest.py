"""Classification of raw messages into an auditable log.

Every message gets one of six categories.  Order of arrival decides, so each has a number:

* bad_payload: not one strict JSON object with exactly the declared keys, types and ranges
* unknown_tag: a well-formed message of a machine that isn't declared
* duplicate, reading_conflict: its (tag, second) has come before, with the same content or another
* out_of_order_rejected: not later than everything that came before from its machine
* accepted

One shuffle by tag gives both windows (first of its key, running maximum).  A machine's
messages meet in one partition, sorted and spilled there; the number of machines bounds the skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, SENSORS
from ..functions.columns import parse_ts, strict_json

CATEGORIES = ("accepted", "duplicate", "reading_conflict", "out_of_order_rejected", "unknown_tag", "bad_payload")


def _is_number(v: Column) -> Column:
    return F.schema_of_variant(v).rlike(r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$")


def parse(messages: DataFrame, cfg: dict = DEFAULT, raw: str = "raw") -> DataFrame:
    """messages with tag, ts_raw, ts_epoch, the sensors, content_hash and reason (NULL for a well-formed message).

    tag and ts_raw are kept from bad payloads too, where they are strings.
    """
    keys = sorted(["ts", "tag", "type", *SENSORS])
    v = F.col("_v")
    get = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    is_string = lambda name: F.coalesce(F.schema_of_variant(get(name)) == "STRING", F.lit(False))
    x = messages.withColumn("_v", strict_json(F.col(raw)))
    x = x.withColumn("_object", F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))
    x = x.withColumn("_keys", F.when(F.col("_object"), F.json_object_keys(F.col(raw))))
    for name in ("tag", "ts"):
        x = x.withColumn(f"_{name}", F.when(F.col("_object") & is_string(name), F.try_variant_get(v, f"$.{name}", "string")))
    x = x.withColumn("_when", parse_ts(F.col("_ts")))
    checks = [
        (~F.col("_object"), F.lit("not one strict JSON object")),
        (F.size(F.array_except(F.array(*map(F.lit, keys)), "_keys")) > 0, F.concat(F.lit("missing key "), F.array_sort(F.array_except(F.array(*map(F.lit, keys)), "_keys"))[0])),
        (F.size(F.array_except("_keys", F.array(*map(F.lit, keys)))) > 0, F.concat(F.lit("unexpected key "), F.try_element_at(F.array_sort(F.array_except("_keys", F.array(*map(F.lit, keys)))), F.lit(1)))),
        (~(is_string("type") & (F.try_variant_get(v, "$.type", "string") == "SENSOR")), F.lit("type is not SENSOR")),
        (F.coalesce(F.col("_tag") == "", F.lit(True)), F.lit("tag is no text")),
        (F.col("_when").isNull(), F.lit("ts is no time with a zone")),
        (F.col("_when") != F.floor("_when"), F.lit("ts is no whole second")),
    ]
    present = F.lit(False)
    for s in SENSORS:
        low, high = cfg["ranges"][s]
        null = F.is_variant_null(get(s))
        value = F.try_variant_get(v, f"$.{s}", "double")
        present |= ~null
        checks += [
            (~null & ~(_is_number(get(s)) & F.coalesce(F.abs(value) < float("inf"), F.lit(False))), F.lit(f"{s} is no finite number")),
            (~null & ~value.between(low, high), F.lit(f"{s} is out of range")),
        ]
        x = x.withColumn(s, F.when(F.col("_object") & ~null & _is_number(get(s)), value))
    checks.append((~present, F.lit("no sensor has a value")))
    reason = F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), text) for bad, text in checks])
    x = x.withColumn("reason", reason).withColumn("ts_epoch", F.when(F.col("reason").isNull(), F.floor("_when").cast("long")))
    x = x.withColumn("content_hash", F.when(F.col("reason").isNull(), F.sha2(F.to_json("_v"), 256)))
    good = F.col("reason").isNull()
    return x.select(*messages.columns, F.col("_tag").alias("tag"), F.col("_ts").alias("ts_raw"), "ts_epoch", *[F.when(good, F.col(s)).alias(s) for s in SENSORS], "content_hash", "reason")


def declared(tags: list[str] | Column) -> Column:
    """Whether tag is a declared machine's: one of a list, or by a rule over the column tag where machines are too many to list."""
    return tags if isinstance(tags, Column) else F.col("tag").isin(tags)


def classify(messages: DataFrame, tags: list[str] | Column, cfg: dict = DEFAULT, raw: str = "raw", arrival: str = "arrival_seq") -> DataFrame:
    """The parsed messages with their category and, where it isn't accepted, a reason."""
    x = parse(messages, cfg, raw)
    known = declared(tags)
    x = x.withColumn("_valid", F.col("reason").isNull() & known)
    # rows that don't take part are spread by their arrival, not gathered under one key
    lane = F.when(F.col("_valid"), F.col("tag")).otherwise(F.concat(F.lit("\0"), F.pmod(F.xxhash64(arrival), F.lit(1024)).cast("string")))
    x = x.withColumn("_lane", lane)
    same = Window.partitionBy("_lane", "ts_epoch").orderBy(arrival)
    before = Window.partitionBy("_lane").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({"_mark": F.max(F.when(F.col("_valid"), F.col("ts_epoch"))).over(before), "_n": F.row_number().over(same), "_first": F.first("content_hash").over(same)})
    category = (
        F.when(F.col("reason").isNotNull(), "bad_payload")
        .when(~known, "unknown_tag")
        .when((F.col("_n") > 1) & (F.col("content_hash") == F.col("_first")), "duplicate")
        .when(F.col("_n") > 1, "reading_conflict")
        .when(F.col("ts_epoch") > F.coalesce(F.col("_mark"), F.lit(-(1 << 62))), "accepted")
        .otherwise("out_of_order_rejected")
    )
    why = F.coalesce(
        "reason",
        F.when(F.col("category") == "unknown_tag", F.concat(F.lit("unknown tag "), F.col("tag")))
        .when(F.col("category") == "duplicate", "the same content has come before")
        .when(F.col("category") == "reading_conflict", "other content has come before")
        .when(F.col("category") == "out_of_order_rejected", F.format_string("second %d is not after %d", "ts_epoch", "_mark")),
    )
    return x.withColumn("category", category).withColumn("reason", why).drop("_valid", "_lane", "_mark", "_n", "_first")


def readings(log: DataFrame, arrival: str = "arrival_seq") -> DataFrame:
    """The fact rows of a log: its accepted messages, so that the two can't disagree."""
    return log.where("category = 'accepted'").select(F.col(arrival).alias("log_id"), F.col("tag").alias("machine"), "ts_epoch", *SENSORS)


def reconciliation(log: DataFrame) -> DataFrame:
    """(category, n) of all six categories, and whether their sum is the number of messages (always, and shown)."""
    spark = log.sparkSession
    names = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    counts = log.groupBy("category").agg(F.count("*").alias("n"))
    both = names.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))
    return both.withColumn("handled", F.sum("n").over(Window.partitionBy()))


def reconciled(log: DataFrame, facts: DataFrame, lines: int | None = None) -> DataFrame:
    """One row that says whether nothing was lost: messages handled, their categories, facts, and the lines of the source if known.

    consistent: the categories add up to the messages, every accepted message is a fact and no other, and every line was handled.
    """
    counts = [F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES]
    x = log.agg(F.count("*").alias("handled"), *counts).join(F.broadcast(facts.agg(F.count("*").alias("facts"))))  # a row each
    total = sum((F.col(c) for c in CATEGORIES), F.lit(0))
    same = (total == F.col("handled")) & (F.col("facts") == F.col("accepted"))
    x = x.withColumn("source_lines", F.lit(lines).cast("long"))
    return x.withColumn("consistent", same & F.coalesce(F.col("source_lines") == F.col("handled"), F.lit(True)))


def summary(log: DataFrame) -> DataFrame:
    """Per tag: messages by category, accepted rows and the newest accepted second."""
    counts = [F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES]
    return log.where("tag is not null").groupBy("tag").agg(*counts, F.max(F.when(F.col("category") == "accepted", F.col("ts_epoch"))).alias("last_epoch"))

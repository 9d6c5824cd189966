"""Column functions: missing values, ratios, time, strict JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def is_inf(x: Column) -> Column:
    """Whether x is infinite; NULL and NaN are not."""
    return F.coalesce(F.abs(x) == float("inf"), F.lit(False)) & ~F.coalesce(F.isnan(x), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0: a metric without a denominator has no value."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def epoch_seconds(ts: str) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"


def parse_ts(s: Column) -> Column:
    """Seconds since 1970 as a decimal of an ISO-8601 text with a zone; NULL for any other."""
    return F.when(s.rlike(ISO), F.unix_micros(F.try_to_timestamp(s)).cast("decimal(30,6)") / 1_000_000)


def iso_utc(t: Column) -> Column:
    """ISO-8601 text of whole epoch seconds in UTC, with +00:00."""
    days = F.floor(t / 86400)
    s = t - days * 86400
    part = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    return F.concat(F.date_format(F.date_from_unix_date(days.cast("int")), "yyyy-MM-dd"), F.lit("T"), part(F.floor(s / 3600)), F.lit(":"), part(F.floor(s / 60) % 60), F.lit(":"), part(s % 60), F.lit("+00:00"))


def strict_json(raw: Column) -> Column:
    """raw as VARIANT; NULL for anything but one JSON value without duplicate keys, NaN, Infinity or trailing text."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    keyed = F.try_parse_json(F.concat(F.lit('{"w":'), raw, F.lit("}")))
    # alone in an array and as a value; the text is parsed twice, not once more
    return F.when(keyed.isNotNull() & F.try_variant_get(wrapped, "$[1]", "variant").isNull(), F.try_variant_get(wrapped, "$[0]", "variant"))


def compared(x: Column, digits: int = 6, offset: float = 1e-9) -> Column:
    """An output convention for comparison with another engine only: rounded, off the ties that two-decimal inputs sit on."""
    return F.round(x + offset, digits)


def html_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s

"""Secret scan: fixed patterns, and sliding-window Shannon entropy per character class.

A candidate is a run of at least ``window`` characters of ``[A-Za-z0-9+/_=-]``
with both a letter and a digit.  Each class looks at the runs of its own
characters in a candidate: a window moves over them character by character, and
the sum of ``c * log2(c)`` over its character counts is updated by what enters
and what leaves.  Windows at or over the class's entropy are joined to spans.
The allow-list drops spans that are known to be harmless.

Nulls and empty texts have no spans, an empty table no rows.  Repeated rows, also of repeated or null ids, give equal results.
Spans that begin together stand in the order of ``KINDS``.  Other columns are not looked at, whatever their names; ``redact`` passes them on.
Time is linear in the text; memory is that of one text, however long.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fields, mapped, named, only

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Class: its characters, and the least entropy of a window in bits a character.
CLASSES = {
    "hex": (re.compile(r"[0-9a-fA-F]+"), 3.0),
    "alnum": (re.compile(r"[A-Za-z0-9]+"), 3.6),
    "base64": (re.compile(r"[A-Za-z0-9+/_=-]+"), 3.9),
}
WINDOW = 20
KINDS = ("assign", "access", "hex", "entropy")

#: What looks random and is harmless: UUIDs, dates and times, long numbers, paths of plain words.
ALLOW = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[0-9+/_=-]+",
    r"[A-Za-z]+([+/_=-][A-Za-z]+)*[+/_=-]*[0-9]{0,4}",
    r"([0-9A-Za-z])\1+",
)


def _logs(window: int) -> list[float]:
    return [0.0] + [c * math.log2(c) for c in range(1, window + 2)]


_LOG = _logs(WINDOW)


def entropy_windows(run: str, window: int, least: float) -> Iterator[tuple[int, int]]:
    """Joined spans of the windows of ``run`` with at least ``least`` bits a character.

    entropy = log2(n) - sum(c * log2(c)) / n over the counts c of the n characters.
    """
    if len(run) < window:
        return
    counts: dict[str, int] = {}
    log = _LOG if window <= WINDOW else _logs(window)
    total, most = 0.0, window * (math.log2(window) - least) + 1e-9
    start = end = -1
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        total += log[c + 1] - log[c]
        counts[ch] = c + 1
        if i >= window:
            old = run[i - window]
            c = counts[old]
            total += log[c - 1] - log[c]
            counts[old] = c - 1
        if i >= window - 1 and total <= most:
            if start >= 0 and i - window + 1 <= end:
                end = i + 1
            else:
                if start >= 0:
                    yield start, end
                start, end = i - window + 1, i + 1
    if start >= 0:
        yield start, end


def _entropy_spans(text: str, window: int, classes: dict, allow: list[re.Pattern]) -> list[tuple[int, int]]:
    found = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % window, text):
        run = m[0]
        if any(a.fullmatch(run) for a in allow) or not (re.search("[0-9]", run) and re.search("[A-Za-z]", run)):
            continue
        spans = []
        for inside, least in classes.values():
            for part in inside.finditer(run):
                for a, b in entropy_windows(part[0], window, least):
                    if not any(x.fullmatch(part[0][a:b]) for x in allow):
                        spans.append((m.start() + part.start() + a, m.start() + part.start() + b))
        for a, b in sorted(spans):
            if found and a <= found[-1][1] and found[-1][0] >= m.start():
                found[-1] = (found[-1][0], max(b, found[-1][1]))
            else:
                found.append((a, b))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three fixed patterns, by start, then kind."""
    spans = []
    if ":" in text or "=" in text:
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def find_spans(text: str | None, window: int = WINDOW, classes: dict = CLASSES, allow: tuple[str, ...] = ALLOW) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start, then kind."""
    if not text:
        return []
    spans = base_spans(text)
    spans += [("entropy", a, b) for a, b in _entropy_spans(text, window, classes, [re.compile(x) for x in allow])]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def redact_text(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with each maximal run of overlapping spans replaced by the mark."""
    if not text:
        return text
    out, at, end = [], 0, -1
    for _, a, b in sorted(find_spans(text), key=lambda s: s[1]):
        if a < end:
            end = max(end, b)
            at = end
            continue
        out += [text[at:a], mark]
        at = end = b
    return "".join([*out, text[at:]])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and its spans (kind, start, end, matched text)."""

    def each(part):
        found = [[(k, a, b, (t or "")[a:b]) for k, a, b in find_spans(t)] for t in part.column(1).to_pylist()]
        return {id_col: part.column(0), "spans": [[{"kind": k, "start": a, "end": b, "match": m} for k, a, b, m in x] for x in found]}

    return mapped(df.select(named(id_col), named(text_col).alias("_text")), each, fields(df, (id_col,), "spans array<struct<kind:string,start:bigint,end:bigint,match:string>>"), "_text")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """All columns of df, with secrets in the text replaced by the mark; other columns are untouched."""

    def each(part):
        only("secrets", dict)
        out = dict(zip(part.schema.names, part.columns, strict=True))
        out[text_col] = [redact_text(t, mark) for t in part.column(part.schema.get_field_index(text_col)).to_pylist()]
        return out

    return mapped(df, each, df.schema, text_col)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document; odd rows go as the module says."""
    found = scan(documents(spark, sf_dir, "doc_id", "text"))
    parts = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")).alias("name")))
    base = F.filter("s", lambda x: x["kind"] != "entropy")
    n = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", parts.alias("s")).select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(F.array_join(F.transform(base, lambda x: x["name"]), ","), 256).alias("base_sha256"), F.array_join(F.transform("s", lambda x: x["name"]), ",").alias("spans")
    )


QUERIES = {"op8_secret_scan": op8_secret_scan}
SQL: dict[str, str] = {}

"""Scalar functions over log fields, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import DEDUP_FIELDS, LEVEL_ALIASES, LEVEL_RANK

#: What the message normaliser replaces, in this order ((?U): Unicode classes).
VOLATILE = (
    (r"(?iU)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"),
    (r"(?iU)\b[0-9a-f]{32,}\b", "<hex>"),
    (r"(?U)\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b", "<ts>"),
    (r"(?iU)\b(?:req(?:uest)?(?:[_-]?id)?|requestid|trace[_-]?id|span[_-]?id)\s*[=:]\s*[A-Za-z0-9._:-]+\b", "<req>"),
)
MESSAGE_CHARS = 500


def strip(c: Column) -> Column:
    """Without white space of any kind at either end (trim() knows spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def level(c: Column) -> Column:
    """A known level in upper case; aliases folded, anything else INFO; no trimming."""
    return F.coalesce(F.try_element_at(_map({name: name for name in LEVEL_RANK} | LEVEL_ALIASES), F.upper(c)), F.lit("INFO"))


def rank(c: Column) -> Column:
    """Severity rank of a level text; null counts as 0."""
    ranks = LEVEL_RANK | {alias: LEVEL_RANK[name] for alias, name in LEVEL_ALIASES.items()}
    return F.when(c.isNull(), 0).otherwise(F.coalesce(F.try_element_at(_map(ranks), F.upper(c)), F.lit(LEVEL_RANK["INFO"])))


def message(c: Column) -> Column:
    out = strip(F.coalesce(c, F.lit("")))
    for pattern, to in VOLATILE:
        out = F.regexp_replace(out, pattern, to)
    return F.substring(F.regexp_replace(F.lower(out), r"(?U)\s+", " "), 1, MESSAGE_CHARS)


def label_text(labels: Column) -> Column:
    """key=value pairs, trimmed and in lower case, in the order of lower-cased keys, joined by |."""
    order = lambda a, b: F.when(F.lower(a["key"]) < F.lower(b["key"]), -1).when(F.lower(a["key"]) > F.lower(b["key"]), 1).otherwise(0)
    pair = lambda e: F.concat(F.lower(strip(e["key"])), F.lit("="), F.lower(strip(F.coalesce(e["value"], F.lit("")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(labels), order), pair), "|"), F.lit(""))


def field(name: str) -> Column:
    """The part of the fingerprint's material that a configured field stands for; columns of log_event."""
    key = name.strip()
    low = key.lower()
    lowered = lambda c, other="": F.lower(strip(F.coalesce(F.col(c), F.lit(other))))
    if low in ("level", "severity"):
        return F.concat(F.lit("level="), F.col("level"))
    if low == "service":
        given = F.when(F.col("service") == "", F.lit(None)).otherwise(F.col("service"))
        return F.concat(F.lit("service="), F.lower(strip(F.coalesce(given, F.lit("unknown")))))
    if low == "message":
        return F.concat(F.lit("message="), message(F.col("message")))
    if low == "labels":
        return F.concat(F.lit("labels={"), label_text(F.col("labels")), F.lit("}"))
    if low in ("error_code", "host", "trace_id"):
        return F.concat(F.lit(f"{low}="), lowered(low))
    for lead in ("label:", "labels."):
        if low.startswith(lead):
            wanted = key[len(lead) :].strip().lower()
            found = F.get(F.filter(F.map_entries("labels"), lambda e: F.lower(e["key"]) == wanted), F.lit(0))["value"]
            return F.concat(F.lit(f"label.{wanted}="), F.lower(strip(F.coalesce(found, F.lit("")))))
    return F.lit(f"unknown.{low}=")


def fields_of(given: str | Sequence[str] | None) -> list[str]:
    """Configured fields: a list or a comma-separated text; blanks are left out, nothing means the default ones."""
    parts = given.split(",") if isinstance(given, str) else list(given or ())
    return [p for p in (str(x).strip() for x in parts) if p] or list(DEDUP_FIELDS)


def fingerprint(fields: Sequence[str] | None = None) -> Column:
    """The first 32 hex digits of SHA-256 over the fields' parts, joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", *[field(f) for f in fields_of(fields)]), 256), 1, 32)


def title() -> Column:
    code, text = F.col("error_code"), F.col("message")
    lead = F.concat(F.lit("["), F.col("service"), F.lit("] "))
    return F.when(F.coalesce(code, F.lit("")) != "", F.concat(lead, code, F.lit(": "), F.substring(text, 1, 120))).otherwise(F.concat(lead, F.substring(text, 1, 140)))


def incident_id(*parts: Column) -> Column:
    """A UUID-shaped id from a hash, so that every engine computes the same one."""
    h = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def idempotency_key(alert_id: Column, channel: Column, count: Column) -> Column:
    return F.concat_ws(":", alert_id, channel, count.cast("string"))


def backoff_seconds(attempts: Column, base: float = 2.0, cap: float = 300.0) -> Column:
    return F.least(F.lit(float(cap)), F.pow(F.lit(float(base)), F.greatest(F.lit(1), attempts).cast("double")))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, cut off, never below zero."""
    return F.greatest(F.lit(0), F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1_000_000)).cast("long")


def epoch_guess(n: Column) -> Column:
    """A timestamp from a number of seconds (below 1e12), milliseconds (below 1e14) or nanoseconds; null for anything else."""
    v = n.cast("decimal(38,0)")
    micros = F.when(v < F.lit(10**12), v * 1_000_000).when(v < F.lit(10**14), v * 1000).otherwise(F.floor(v / 1000))
    return F.timestamp_micros(F.expr("0").cast("long") + micros.cast("long"))


def headers(text: Column) -> Column:
    """A map from a JSON object of headers; anything else gives an empty one."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))

"""Raw JSON log records to log_event rows, with a branch for what can't be parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import level

RAW_CHARS = 4000
#: Times on the wire keep their microseconds.
WIRE_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
#: Aliases of each field, in order.
ALIASES = {
    "level": ("level", "severity", "log_level"),
    "message": ("message", "msg", "error", "text"),
    "service": ("service", "app", "application", "$.labels.service"),
    "host": ("host", "hostname", "pod"),
    "error_code": ("error_code", "code"),
    "trace_id": ("trace_id", "traceId"),
    "timestamp": ("timestamp", "@timestamp", "time"),
}
DEFAULTS = {"level": "INFO", "message": "", "service": "unknown", "host": "unknown"}


#: The aliases as fields of one struct, so that a record is read once; values keep their JSON text.
FIELDS = ", ".join(f"`{n}` string" for n in dict.fromkeys(["labels", *(p for paths in ALIASES.values() for p in paths if not p.startswith("$"))]))
#: Texts of which one can't tell whether the record has a string or something else.
UNCLEAR = r"^(-?[0-9][0-9.eE+-]*|true|false|\[\]|\{\})$"


def _text(j: Column, name: str) -> Column:
    return F.get_json_object(j["labels"], "$.service") if name == "$.labels.service" else j[name]


def _kind(v: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, name if name.startswith("$") else f"$['{name}']", "variant"))


def _truthy(j: Column, v: Column, names: tuple[str, ...]) -> Column:
    """t (as text) and k (kind) of the first value that is anything but null, "", 0, false, [] and {}; null if there is none.

    j is the record as a struct of texts, v the same one as a variant, which is looked at only where a text's kind is unclear.
    """
    values = F.array(*[F.struct(_text(j, n).alias("t"), F.when(_text(j, n).rlike(UNCLEAR), _kind(v, n)).otherwise("STRING").alias("k")) for n in names])
    some = lambda x: (x["t"] != "") & ((x["k"] == "STRING") | ~x["t"].isin("0", "0.0", "false", "[]", "{}"))
    return F.get(F.filter(values, some), F.lit(0))


def alias(j: Column, v: Column, field: str) -> Column:
    """The first truthy alias; for fields without a default the last alias counts even if it isn't truthy."""
    names = ALIASES[field]
    if field in DEFAULTS:
        return F.coalesce(_truthy(j, v, names)["t"], F.lit(DEFAULTS[field]))
    return F.coalesce(_truthy(j, v, names[:-1])["t"], _text(j, names[-1]))


def timestamp(given: Column, now: Column) -> Column:
    """Null or "" is now; numbers are seconds, or milliseconds above 1e12; text is ISO 8601, UTC where it names no zone.

    given: t and k of the value (see ``given_time``). Null for text that is no timestamp.
    """
    text, number = given["t"], given["t"].try_cast("double")
    seconds = F.when(number > 1e12, number / 1000).otherwise(number)
    full = F.when(text.rlike("^[0-9]{4}-"), text).when(text.rlike(BASIC), _extended(text))
    stamp = F.try_to_timestamp(F.regexp_replace(full, "T([0-9]{2}:[0-9]{2})(?=$|Z|[+-])", "T$1:00"))
    return F.when(given.isNull(), now).when(given["k"] == "STRING", stamp).otherwise(F.timestamp_micros(F.round(seconds * 1_000_000).cast("long")))


#: ISO 8601 in its basic form, without marks between the parts.
BASIC = r"^[0-9]{8}(T[0-9]{2}([0-9]{2}([0-9]{2}([.,][0-9]{1,6})?)?)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)?)?$"


def _extended(text: Column) -> Column:
    """The extended form of a timestamp in basic form."""
    out = F.regexp_replace(text, "^([0-9]{4})([0-9]{2})([0-9]{2})", "$1-$2-$3")
    out = F.regexp_replace(out, "T([0-9]{2})(?=$|Z|[+-])", "T$1:00")
    out = F.regexp_replace(out, "T([0-9]{2})([0-9]{2})(?![0-9])", "T$1:$2")
    out = F.regexp_replace(out, "T([0-9]{2})([0-9]{2})([0-9]{2})", "T$1:$2:$3")
    return F.regexp_replace(F.regexp_replace(out, "([+-][0-9]{2}):?([0-9]{2})$", "$1:$2"), "(T.*[+-][0-9]{2})$", "$1:00")


def record(text: Column) -> Column:
    return F.from_json(text, FIELDS)


def given_time(j: Column, v: Column) -> Column:
    return _truthy(j, v, ALIASES["timestamp"])


def labels(j: Column) -> Column:
    """The labels object with its values as texts; anything else gives an empty map."""
    return F.coalesce(F.from_json(j["labels"], "map<string,string>"), F.create_map().cast("map<string,string>"))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, wherever they are used."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parse(df: DataFrame, value_col: str = "value", now: Column | None = None) -> DataFrame:
    """df with ``event`` (log_event struct, null if unparseable) and ``reason`` (null, unparseable or invalid_timestamp)."""
    now = F.current_timestamp() if now is None else now
    # Of a key that an object has twice, the last value counts, in both readers.
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    text = F.col(value_col).cast("string")
    # Records are read, and times found, in rows of generated arrays: a filter on reason or event isn't pushed below those, where
    # it would read the record again for each mention of it.
    out = _once(df, _v=F.try_parse_json(text), _j=record(text))
    j, v = F.col("_j"), F.col("_v")
    out = _once(out, _ok=F.coalesce(v.isNotNull() & text.rlike(r"^\s*\{"), F.lit(False)), _given=given_time(j, v))
    out = out.withColumns({"_level": level(alias(j, v, "level")), "_labels": labels(j), **{f"_{c}": alias(j, v, c) for c in ("service", "host", "message", "error_code", "trace_id")}})
    out = _once(out, _timestamp=timestamp(F.col("_given"), now))
    reason = F.when(~F.col("_ok"), "unparseable").when(F.col("_timestamp").isNull(), "invalid_timestamp")
    names = ("timestamp", "level", "service", "host", "message", "error_code", "trace_id", "labels")
    out = out.withColumn("reason", reason).withColumn("event", F.when(F.col("reason").isNull(), F.struct(*[F.col(f"_{c}").alias(c) for c in names])))
    return out.drop("_v", "_j", "_ok", "_given", *[f"_{c}" for c in names])


def events(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is null").select(*[c for c in parsed.columns if c not in ("event", "reason", "value")], "event.*")


def dead_letters(parsed: DataFrame, value_col: str = "value") -> DataFrame:
    """reason and payload of the records that can't be used."""
    return parsed.where("reason is not null").select(*[c for c in parsed.columns if c not in ("event", "reason", value_col)], "reason", F.substring(F.col(value_col).cast("string"), 1, RAW_CHARS).alias("payload"))


def unwired(df: DataFrame, value_col: str = "value", now: Column | None = None) -> DataFrame:
    """log_event rows of the records of a log topic."""
    return events(parse(df.select(F.col(value_col).alias("value")), now=now))


def wire(df: DataFrame) -> DataFrame:
    """key and value of the records that a log topic takes."""
    return df.select(F.coalesce("service", F.lit("unknown")).alias("key"), F.to_json(F.struct("*"), {"timestampFormat": WIRE_TIME}).alias("value"))

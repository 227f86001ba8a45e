"""Read queries over the incident, dispatch and widget tables."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..model import SEVERE

SNAPSHOT_ROWS, RECENT, PER_ALERT = 2000, 100, 50


def listed(csv: str) -> list[str]:
    return [x for x in (p.strip() for p in csv.split(",")) if x]


def has_labels(specs: Sequence[dict[str, str]], labels: Column) -> Column:
    """All of the specs hold: the key is there and, where a value is asked for, has it; upper and lower case are the same."""
    entries = F.map_entries(labels)
    out = F.lit(True)
    for spec in specs:
        key, value = spec.get("key", "").strip().lower(), spec.get("value", "").strip().lower()
        if key:
            out = out & F.coalesce(_entry(entries, key, value), F.lit(False))
    return out


def _entry(entries: Column, key: str, value: str) -> Column:
    return F.exists(entries, lambda e: (F.lower(e["key"]) == key) & ((F.lower(e["value"]) == value) if value else F.lit(True)))


def searched() -> Column:
    """The text of an incident that a search looks at, in lower case."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "sample_message", "fingerprint", "error_code", "service")]))


def contains(q: str) -> Column:
    return F.contains(searched(), F.lit(q.strip().lower()))


def snapshot(alerts: DataFrame, rows: int = SNAPSHOT_ROWS) -> DataFrame:
    """The newest incidents; a read model of bounded size by definition."""
    return alerts.orderBy(F.desc("last_seen"), "id").limit(rows)


def filtered(alerts: DataFrame, status: str = "", severity: str = "", service: str = "", labels: Sequence[dict[str, str]] = (), label_key: str = "", label_value: str = "", q: str = "") -> DataFrame:
    out = alerts
    if listed(status):
        out = out.where(F.col("status").isin(*listed(status)))
    if listed(severity):
        out = out.where(F.upper("severity").isin(*[x.upper() for x in listed(severity)]))
    if service:
        out = out.where(F.col("service") == service)
    specs = list(labels) or ([{"key": label_key, "value": label_value}] if label_key.strip() else [])
    if specs:
        out = out.where(has_labels(specs, F.col("labels")))
    if q.strip():
        out = out.where(contains(q))
    return out


@dataclass
class Page:
    rows: DataFrame
    page: int
    page_size: int
    total: int

    @property
    def pages(self) -> int:
        return -(-self.total // self.page_size)

    @property
    def has_next(self) -> bool:
        return self.page < self.pages

    @property
    def has_prev(self) -> bool:
        return self.page > 1


def page_rows(df: DataFrame, order: Sequence[Column | str], page: int = 1, page_size: int = 25) -> DataFrame:
    page, size = max(1, page), min(200, max(1, page_size))
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_of(df: DataFrame, order: Sequence[Column | str], page: int = 1, page_size: int = 25) -> Page:
    return Page(page_rows(df, order, page, page_size), max(1, page), min(200, max(1, page_size)), df.count())


def page_from_offset(limit: int, offset: int) -> tuple[int, int]:
    """(page, page_size) of an offset, which is cut down to a whole page."""
    size = min(200, max(1, limit))
    return max(0, offset) // size + 1, size


def alerts_page(alerts: DataFrame, page: int = 1, page_size: int = 25, rows: int = SNAPSHOT_ROWS, **filters) -> DataFrame:
    shown = filtered(snapshot(alerts, rows), **filters)
    newest = F.coalesce("last_seen", "first_seen") if "first_seen" in shown.columns else F.col("last_seen")
    return page_rows(shown, [F.desc(newest), "id"], page, page_size)


def view(table: DataFrame) -> DataFrame:
    """Stored rows as readers see them: labels from their JSON text (nothing readable: none), and defaults where a value is missing."""
    kind = dict(table.dtypes)["labels"]
    labels = F.from_json("labels", "map<string,string>") if kind == "string" else F.col("labels")
    filled = {"labels": F.coalesce(labels, F.create_map().cast("map<string,string>")), "occurrence_count": F.coalesce("occurrence_count", F.lit(0)), **{c: F.coalesce(c, F.lit("")) for c in ("title", "sample_message")}}
    return table.withColumns(filled)


def dispatch_counts(dispatches: DataFrame) -> DataFrame:
    return dispatches.groupBy("alert_id").agg(F.count_if(F.col("success") == 1).alias("dispatch_ok"), F.count_if(F.col("success") == 0).alias("dispatch_failed"))


def with_dispatch_counts(alerts: DataFrame, dispatches: DataFrame) -> DataFrame:
    got = dispatch_counts(dispatches).withColumnRenamed("alert_id", "id")
    return alerts.join(got, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("dispatch_ok", "dispatch_failed")})


def newest_dispatches(dispatches: DataFrame, per_alert: int = PER_ALERT) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("alert_id").orderBy(F.desc("created_at"), F.desc("idempotency_key")))
    return dispatches.withColumn("place", place).where(F.col("place") <= per_alert)


def recent_dispatches(dispatches: DataFrame, limit: int = RECENT) -> DataFrame:
    return dispatches.orderBy(F.desc("created_at"), F.desc("idempotency_key")).limit(limit)


def alert_by_id(alerts: DataFrame, alert_id: str) -> DataFrame:
    return alerts.where(F.col("id") == alert_id).limit(1)


def dispatches_of(dispatches: DataFrame, alerts: DataFrame) -> DataFrame:
    """The dispatch rows of some alerts; a semi-join, so alerts may be of any number."""
    return dispatches.join(alerts.select(F.col("id").alias("alert_id")), "alert_id", "left_semi")


def dispatch_page(dispatches: DataFrame, alert_id: str | None = None, page: int = 1, page_size: int = 25) -> DataFrame:
    """A page of one alert's dispatches, newest first, or without an alert of all of them."""
    of = dispatches if alert_id is None else dispatches.where(F.col("alert_id") == alert_id)
    return page_rows(of, [F.desc("created_at"), F.desc("idempotency_key")], page, page_size)


def stats(alerts: DataFrame, dispatches: DataFrame) -> DataFrame:
    """One row; the table is scanned once for all counts."""
    a = alerts.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("open", "updated", "acknowledged", "resolved")],
        F.count_if(F.col("severity").isin(*SEVERE)).alias("n_severe"), F.max("last_seen").alias("last_seen"), F.count_distinct("service").alias("n_services"),
    )
    d = dispatches.agg(F.count_if(F.col("success") == 1).alias("dispatch_ok"), F.count_if(F.col("success") == 0).alias("dispatch_failed"))
    return a.crossJoin(d)  # one row each


def services(alerts: DataFrame) -> DataFrame:
    return alerts.select("service").distinct().orderBy("service")


def widgets(table: DataFrame) -> DataFrame:
    return table.orderBy("sort_order", "title")


def check_widget(row: DataFrame) -> None:
    if not row.where(F.size("labels") < 1).isEmpty():
        raise ValueError("a widget needs at least one label")


def save_widget(table: DataFrame, row: DataFrame) -> DataFrame:
    """Insert or replace by id; a widget needs a label."""
    check_widget(row)
    return table.join(row.select("id"), "id", "left_anti").unionByName(row)


def drop_widget(table: DataFrame, widget_id: str) -> DataFrame:
    return table.where(F.col("id") != widget_id)


def widget_matches(table: DataFrame, alerts: DataFrame, per_widget: int = 10) -> DataFrame:
    """For each widget its newest incidents: those that have all of its labels (blank keys are skipped), and one of its statuses.

    Relational division: different specs (key, value or any value) meet the incidents' labels by equality, so each incident has the list of specs that
    it satisfies. A widget meets the incidents of its rarest spec, and keeps those whose list holds all the others. A widget without a
    spec takes any incident: its newest ones are among the newest of each status, which are a few rows.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    given = F.array_distinct(F.filter(F.transform("labels", lambda s: F.struct(low(s["key"]).alias("key"), low(s["value"]).alias("value"))), lambda s: s["key"] != ""))
    states = F.filter(F.transform(F.split(F.coalesce("status_filter", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    w = table.select(F.col("id").alias("widget_id"), "status_filter", given.alias("specs"), states.alias("_states"))
    fits = (F.size("_states") == 0) | F.array_contains("_states", F.col("status"))
    # What each incident satisfies: its labels with their values, and with any value.
    entries = F.transform(F.map_entries("labels"), lambda e: F.struct(F.lower(e["key"]).alias("key"), F.lower(e["value"]).alias("value")))
    both = F.array_distinct(F.concat(entries, F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.lit("").alias("value")))))
    asked = w.select(F.explode("specs").alias("spec")).distinct()
    has = alerts.select("id", F.explode(both).alias("spec")).join(asked, "spec", "left_semi")
    often = has.groupBy("spec").agg(F.count("*").alias("n"))
    # A spec that no incident satisfies leaves its widget out: the join with the counts loses it, and the count of specs tells.
    known = w.select("widget_id", F.size("specs").alias("need"), F.explode("specs").alias("spec")).join(often, "spec")
    rarest = known.groupBy("widget_id").agg(F.min_by("spec", "n").alias("spec"), F.count("*").alias("n"), F.max("need").alias("need")).where("n = need").select("widget_id", "spec")
    lists = has.groupBy("id").agg(F.collect_set("spec").alias("_has"))
    anchors = w.where(F.size("specs") > 0).join(rarest, "widget_id")
    met = has.join(anchors, "spec").join(lists, "id").where(F.size(F.array_except("specs", "_has")) == 0).drop("spec", "_has")
    hit = met.join(alerts, "id").where(fits)
    newest = F.row_number().over(Window.partitionBy("status").orderBy(F.desc("last_seen"), "id"))
    few = alerts.withColumn("_n", newest).where(F.col("_n") <= per_widget).drop("_n")
    free = w.where(F.size("specs") == 0).join(F.broadcast(few), fits)
    place = F.row_number().over(Window.partitionBy("widget_id").orderBy(F.desc("last_seen"), "id"))
    return hit.unionByName(free).drop("_states").withColumn("place", place).where(F.col("place") <= per_widget)


# Pages by place, not by number: a page begins behind the last row of the one before it.


def token_of(row: Row | None, order: Sequence[tuple[str, bool]]) -> str | None:
    """Where a page ended, for the next one; None after the last row. order: (column, descending)."""
    return None if row is None else base64.urlsafe_b64encode(json.dumps([_plain(row[c]) for c, _ in order]).encode()).decode()


def _plain(v):
    """A JSON value; a time as the microseconds of its instant (one without a zone is in the machine's, as collected rows are)."""
    return {"t": (v.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)} if isinstance(v, datetime) else v


def _literal(v) -> Column:
    return F.timestamp_micros(F.lit(v["t"])) if isinstance(v, dict) else F.lit(v)


def seek(df: DataFrame, order: Sequence[tuple[str, bool]], token: str | None = None, page_size: int = 25) -> DataFrame:
    """The rows behind a token's place in an order, whose last column is unique; nulls come last.

    The place is a filter, which goes down to the scan; rows before it aren't sorted, and rows that are added there move nothing.
    """
    rows = df
    if token is not None:
        try:
            at = json.loads(base64.urlsafe_b64decode(token.encode()))
        except ValueError as e:
            raise ValueError("a page's token can't be read") from e
        if not isinstance(at, list) or len(at) != len(order):
            raise ValueError("a page's token is of another order")
        behind, same = F.lit(False), F.lit(True)
        for (c, down), v in zip(order, at, strict=True):
            if v is None:  # nulls are last: nothing but nulls is behind or beside
                same = same & F.col(c).isNull()
                continue
            behind = behind | (same & (F.col(c).isNull() | (F.col(c) < _literal(v) if down else F.col(c) > _literal(v))))
            same = same & (F.col(c) == _literal(v))
        first, down = order[0]
        if at[0] is not None:  # the part of it that statistics of files can use
            rows = rows.where(F.col(first).isNull() | (F.col(first) <= _literal(at[0]) if down else F.col(first) >= _literal(at[0])))
        rows = rows.where(behind)
    return rows.orderBy(*[F.desc_nulls_last(c) if d else F.asc_nulls_last(c) for c, d in order]).limit(min(200, max(1, page_size)))


NEWEST_ALERTS = (("last_seen", True), ("id", False))
NEWEST_DISPATCHES = (("created_at", True), ("idempotency_key", True))
NEWEST_OUTBOX = (("updated_at", True), ("idempotency_key", True))


def alerts_after(alerts: DataFrame, token: str | None = None, page_size: int = 25, **filters) -> tuple[DataFrame, str | None]:
    """(a page of the filtered incidents, newest first, the token of the next page). The page is computed once, for its token."""
    rows = seek(filtered(alerts, **filters), NEWEST_ALERTS, token, page_size).collect()  # at most 200
    page = alerts.sparkSession.createDataFrame(rows, alerts.schema)
    return page, token_of(rows[-1] if len(rows) == min(200, max(1, page_size)) else None, NEWEST_ALERTS)

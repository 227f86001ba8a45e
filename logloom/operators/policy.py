"""Layered policy: defaults, overridden per service, overridden per error code."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fields_of, fingerprint, level, rank, title

#: Key, type and built-in default.
KEYS = {
    "min_level": ("string", "ERROR"), "dedup_window_seconds": ("int", 300), "refire_interval_seconds": ("int", 60),
    "suppress_dispatch_while_acknowledged": ("boolean", True), "allow_reopen_after_resolve": ("boolean", True), "dedup_fields": ("string", None),
}


def _layer(given: Mapping[str, Any] | None) -> dict[str, Any]:
    given = dict(given or {})
    if "update_interval_seconds" in given:
        given.setdefault("refire_interval_seconds", given["update_interval_seconds"])
    out = {k: given[k] for k in KEYS if given.get(k) is not None}
    for k in ("dedup_window_seconds", "refire_interval_seconds"):
        if k in out and int(out[k]) < 1:
            raise ValueError(f"{k} must be 1 at least")
    if "dedup_fields" in out:
        out["dedup_fields"] = ",".join(fields_of(out["dedup_fields"]))
    return out


@dataclass
class Policy:
    defaults: dict[str, Any] = field(default_factory=dict)
    services: dict[str, dict[str, Any]] = field(default_factory=dict)
    error_codes: dict[str, dict[str, Any]] = field(default_factory=dict)

    @classmethod
    def of(cls, document: Mapping[str, Any] | None) -> Policy:
        document = document or {}
        layers = lambda name: {str(k): _layer(v) for k, v in (document.get(name) or {}).items()}
        return cls(_layer(document.get("defaults")), layers("services"), layers("error_codes"))

    @classmethod
    def load(cls, *paths: str) -> Policy:
        """The first file that exists; built-in defaults if none does."""
        import yaml

        for path in paths:
            if Path(path).is_file():
                return cls.of(yaml.safe_load(Path(path).read_text()))
        return cls()

    def _lookup(self, layers: dict[str, dict[str, Any]], by: Column, key: str) -> Column:
        kind = KEYS[key][0]
        out = F.lit(None).cast(kind)
        for name, layer in layers.items():
            if key in layer:
                out = F.when(by == name, F.lit(layer[key]).cast(kind)).otherwise(out)
        return out

    def column(self, key: str) -> Column:
        """The setting for a row with ``service`` and ``error_code``: layers have tens of entries, so they are CASE branches."""
        default = self.defaults.get(key, KEYS[key][1])
        return F.coalesce(self._lookup(self.error_codes, F.col("error_code"), key), self._lookup(self.services, F.col("service"), key), F.lit(default).cast(KEYS[key][0]))

    def field_lists(self) -> list[str]:
        return sorted({x["dedup_fields"] for x in (self.defaults, *self.services.values(), *self.error_codes.values()) if "dedup_fields" in x})

    def resolve(self, logs: DataFrame) -> DataFrame:
        return logs.withColumns({k: self.column(k) for k in KEYS})


#: The policy that the project ships (fixed values).
SHIPPED = Policy.of(
    {
        "defaults": {"min_level": "ERROR", "dedup_window_seconds": 300, "refire_interval_seconds": 60},
        "services": {
            "payments-api": {"min_level": "ERROR", "dedup_window_seconds": 600, "refire_interval_seconds": 120},
            "checkout": {"dedup_window_seconds": 180, "refire_interval_seconds": 30},
            "inventory": {"min_level": "CRITICAL", "dedup_window_seconds": 900, "refire_interval_seconds": 300},
        },
        "error_codes": {
            "DB_CONN": {"dedup_window_seconds": 900, "refire_interval_seconds": 180},
            "RATE_LIMIT": {"dedup_window_seconds": 120, "refire_interval_seconds": 60},
        },
    }
)


def enrich(logs: DataFrame, policy: Policy = SHIPPED, fields: list[str] | None = None) -> DataFrame:
    """logs (with a normalised level) that pass their minimum level, with policy, fingerprint and title.

    fields overrides the policy's field lists.
    """
    out = policy.resolve(logs).where(rank(F.col("level")) >= rank(level(F.col("min_level"))))
    made = fingerprint(fields)
    for listed in [] if fields else policy.field_lists():
        made = F.when(F.col("dedup_fields") == listed, fingerprint(listed.split(","))).otherwise(made)
    return out.withColumn("fingerprint", made).withColumn("title", title()).withColumnRenamed("dedup_window_seconds", "window_seconds")

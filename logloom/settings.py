"""Settings of a deployment, from environment variables with checks."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

PREFIX = "LOGLOOM_"


@dataclass(frozen=True)
class Settings:
    """Each field is read from LOGLOOM_<NAME>; lists are comma-separated."""

    source: str = "auto"
    input_path: str = ""
    files_per_batch: int = 1000
    topic_servers: str = ""
    topic: str = "logs"
    tables: str = ""
    checkpoint: str = ""
    policy_paths: tuple[str, ...] = ()
    channels: tuple[str, ...] = ("webhook",)
    addresses: tuple[str, ...] = ()
    outbox_batch: int = 50
    max_attempts: int = 8
    stale_seconds: int = 120
    snapshot_rows: int = 2000
    future_seconds: int = 300
    settle_seconds: int = 604_800
    range_url: str = ""
    range_query: str = '{job=~".+"}'
    range_seconds: int = 15
    range_lookback: int = 60
    range_limit: int = 1000

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, int) and value < 1:
                raise ValueError(f"{f.name} must be at least 1, not {value}")
        if self.source not in ("auto", "files", "topic", "range"):
            raise ValueError("source must be files, topic, range or auto")
        if any("=" not in x for x in self.addresses):
            raise ValueError("addresses must be channel=address pairs")
        if self.range_url and not self.range_url.startswith(("http://", "https://")):
            raise ValueError("range_url must be an http or https address")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        """Variables that are unset or empty leave the default; a number that can't be read is an error."""
        env = os.environ if env is None else env
        given = {}
        for f in fields(cls):
            text = env.get(PREFIX + f.name.upper(), "").strip()
            if not text:
                continue
            kind = type(f.default)
            try:
                given[f.name] = tuple(x.strip() for x in text.split(",") if x.strip()) if kind is tuple else kind(text)
            except ValueError as e:
                raise ValueError(f"{PREFIX}{f.name.upper()} is not a number: {text!r}") from e
        return cls(**given)

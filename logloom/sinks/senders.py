"""Senders of notifications: each posts a claimed row's payload to its channel's address, with a timeout and a few tries."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ALERT
from ..operators import channels

TIMEOUT_SECONDS, TRIES, PAUSE_SECONDS = 15.0, 3, 0.5

#: Payload of each kind of channel, over alert columns.
PAYLOADS = {"webhook": channels.webhook, "card": channels.card, "paging": channels.paging}


def with_payload(claimed: DataFrame, kinds: Mapping[str, str] | None = None) -> DataFrame:
    """claimed outbox rows with ``payload``, the body that their channel takes; kinds names the kind of channels called otherwise."""
    kinds = {k: k for k in PAYLOADS} | dict(kinds or {})
    alert = F.from_json("payload_json", ALERT)
    rows = claimed.select(F.struct(*claimed.columns).alias("_row"), alert.alias("_alert")).select("_row", "_alert.*")
    body = F.col("_row.payload_json")
    for channel, kind in kinds.items():
        body = F.when(F.col("_row.channel") == channel, PAYLOADS[kind]()).otherwise(body)
    return rows.select("_row.*", body.alias("payload"))


def post(url: str, body: str, headers: Mapping[str, str], timeout: float) -> tuple[int, str]:
    """Status and text of the answer; OSError where there is none."""
    request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json", **headers}, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


@dataclass
class HttpSender:
    """Posts a row's payload. Answers of 500 and more, 429 and none at all are tried again; others are final."""

    url: str
    headers: dict[str, str] = field(default_factory=dict)
    timeout: float = TIMEOUT_SECONDS
    tries: int = TRIES
    pause: float = PAUSE_SECONDS
    post: Callable[[str, str, Mapping[str, str], float], tuple[int, str]] = post
    #: The pause between tries; replaced in tests.
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, row: Mapping) -> dict:
        body, error, code, text = row.get("payload") or row["payload_json"], None, None, None
        for k in range(self.tries):
            if k:
                self.sleep(self.pause * 2 ** (k - 1))
            try:
                code, text = self.post(self.url, body, self.headers, self.timeout)
            except OSError as e:
                code, text, error = None, None, str(e) or type(e).__name__
                continue
            if 200 <= code < 300:
                return {"success": True, "status_code": code, "response_body": text, "error_message": None}
            error = f"HTTP {code}"
            if code < 500 and code != 429:
                break
        return {"success": False, "status_code": code, "response_body": text, "error_message": error}


def registry(addresses: Mapping[str, str], headers: Mapping[str, str] | str | None = None, **options) -> dict[str, HttpSender]:
    """A sender for each channel that has an address; headers may be a JSON object, and anything else in its place means none."""
    if isinstance(headers, str):
        try:
            given = json.loads(headers)
        except ValueError:
            given = {}
        headers = {str(k): str(v) for k, v in given.items()} if isinstance(given, dict) else {}
    return {channel: HttpSender(url, dict(headers or {}), **options) for channel, url in addresses.items() if url}

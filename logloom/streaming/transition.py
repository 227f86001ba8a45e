"""The dedup rule for one event after another; ground truth of the tests and body of the stateful processor.

What happens follows from two questions about the state before: has its window passed (or is there none), and has the refire
interval passed since the last event that was let through.
"""

from __future__ import annotations

from typing import Any

from ..model import LEVEL_RANK

SECOND = 1_000_000
#: What an incident keeps from its first event.
FIRST = ("fingerprint", "title", "service", "host", "error_code", "labels")


def decide(state: dict[str, Any] | None, event: dict[str, Any]) -> str:
    """new, update or suppress. Gaps are strict on both sides: a gap as long as the window is inside, one as long as the refire is due."""
    if state is None or event["clock"] > state["last_seen"] + state["window_seconds"] * SECOND:
        return "new"
    due = event["clock"] >= state["last_emitted"] + max(0, int(event["refire_interval_seconds"])) * SECOND
    return "update" if due else "suppress"


def transition(state: dict[str, Any] | None, event: dict[str, Any], late: str = "rewind") -> tuple[str, dict[str, Any]]:
    """(action, new state). Times are microseconds; ``clock`` is the event's time after the future clamp.

    ``late="rewind"`` lets a late event move last_seen back; ``"max"`` is an extension that keeps the newest time.
    """
    action = decide(state, event)
    old = None if action == "new" else state
    origin = old or {k: event.get(k) for k in FIRST} | {"first_seen": event["micros"], "first_event": event["event_id"], "occurrence_count": 0, "severity": event["level"], "last_seen": event["micros"]}
    higher = max(origin["severity"], event["level"], key=lambda x: LEVEL_RANK.get(x, 0))  # the label that was there first on ties
    return action, origin | {
        "occurrence_count": origin["occurrence_count"] + 1,
        "severity": higher,
        "sample_message": event["message"],
        "trace_id": event.get("trace_id") or (old["trace_id"] if old else event.get("trace_id")),
        "window_seconds": max(1, int(event["window_seconds"])),
        "last_seen": max(event["micros"], origin["last_seen"]) if late == "max" else event["micros"],
        "last_emitted": origin["last_emitted"] if action == "suppress" else event["clock"],
    }

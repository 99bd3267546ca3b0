"""Durations and time expressions, parsed on the driver into nanoseconds."""

from __future__ import annotations

import re
from datetime import datetime, timezone

UNITS = {
    "ns": 1, "us": 10**3, "µs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9, "y": 365 * 86400 * 10**9,
}
WORDS = {"second": "s", "minute": "m", "hour": "h", "day": "d", "week": "w", "year": "y"}


def duration(text: str) -> int:
    """1h30m, 5m, 90s ... as nanoseconds."""
    text = text.strip()
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|[smhdwy])", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"no duration: {text!r}")
    return int(sum(float(a) * UNITS[b] for a, b in parts))


def moment(text: str, now: int) -> int:
    """now(), now()-1h, -1h (from now), an integer, or an ISO time, as nanoseconds."""
    text = text.strip().strip("'\"")
    if m := re.fullmatch(r"now\(\)\s*(?:([+-])\s*(.+))?", text, re.I):
        if not m[1]:
            return now
        return now + (1 if m[1] == "+" else -1) * interval(m[2])
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if re.fullmatch(r"-?\d+[a-zµ].*", text):
        return now - duration(text[1:]) if text[0] == "-" else now + duration(text)
    when = datetime.fromisoformat(text.replace("Z", "+00:00"))
    when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
    delta = when - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86400 + delta.seconds) * 10**9 + delta.microseconds * 1000


def interval(text: str) -> int:
    """INTERVAL 5 MINUTE, or a duration."""
    if m := re.fullmatch(r"interval\s+'?(\d+)'?\s+([a-z]+)", text.strip(), re.I):
        word = m[2].lower().rstrip("s")
        if word not in WORDS:
            raise ValueError(f"unknown unit {m[2]!r}")
        return int(m[1]) * UNITS[WORDS[word]]
    return duration(text)


def epoch(text: str, now: int) -> int:
    """Like ``moment``, where integers below 10**12 are seconds."""
    out = moment(text, now)
    return out * 10**9 if re.fullmatch(r"\d+", text.strip()) and out < 10**12 else out

"""Ranges and buckets of a report, in a named time zone. All of it is a report's few parameters, so it runs on the driver."""

from __future__ import annotations

from calendar import monthrange
from dataclasses import dataclass
from datetime import UTC, date, datetime, time, timedelta
from itertools import pairwise
from zoneinfo import ZoneInfo

MOST_BUCKETS = 100_000
FIVE_MINUTES, HOUR = timedelta(minutes=5), timedelta(hours=1)


@dataclass(frozen=True)
class Range:
    """Half open, in microseconds; None for both is all time."""

    start_us: int | None
    end_us: int | None

    def __post_init__(self) -> None:
        if (self.start_us is None) != (self.end_us is None) or self.start_us is not None and self.start_us >= self.end_us:
            raise ValueError("a range starts before it ends")


def us(at: datetime) -> int:
    return (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def wall_time(text: str, zone: str) -> datetime:
    """The instant of a local time, or of a text that names its offset; a local time that the clock skips or shows twice is an error."""
    at = datetime.fromisoformat(text)
    if at.tzinfo is None:
        at = at.replace(tzinfo=ZoneInfo(zone))
        before, after = at.utcoffset(), at.replace(fold=1).utcoffset()
        if before != after:  # the clock is changed around this time
            raise ValueError("the clock shows this time twice" if before > after else "the clock skips this time")
    return at.astimezone(UTC)


def _midnight(day: date, zone: str) -> int:
    return us(datetime.combine(day, time(), ZoneInfo(zone)))


def preset(name: str, now: datetime, zone: str) -> Range:
    """The whole month, week (from Monday), day or hour of the clock that ``now`` lies in, or all."""
    if name == "all":
        return Range(None, None)
    local = now.astimezone(ZoneInfo(zone))
    today = local.date()
    if name == "hour":
        start = us(local) - (local.minute * 60 + local.second) * 1_000_000 - local.microsecond
        return Range(start, start + HOUR // timedelta(microseconds=1))
    month = today.replace(day=1)
    first, last = {
        "month": (month, month + timedelta(days=monthrange(today.year, today.month)[1])),
        "week": (today - timedelta(days=today.weekday()), today + timedelta(days=7 - today.weekday())),
        "day": (today, today + timedelta(days=1)),
    }[name]
    return Range(_midnight(first, zone), _midnight(last, zone))


def bucket_size(wanted: Range) -> str:
    if wanted.start_us is None:
        return "day"
    length = timedelta(microseconds=wanted.end_us - wanted.start_us)
    return "five_minutes" if length <= HOUR else "hour" if length <= 48 * HOUR else "day"


def axis(start_us: int, end_us: int, bucket: str, zone: str, clip: bool = True) -> list[tuple[int, int]]:
    """(start, end) of the buckets that meet [start, end): local days from midnight to midnight, or fixed steps from the local hour."""
    local = (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=start_us)).astimezone(ZoneInfo(zone))
    if bucket == "day":
        edge = lambda i: _midnight(local.date() + timedelta(days=i), zone)
    else:
        step = (HOUR if bucket == "hour" else FIVE_MINUTES) // timedelta(microseconds=1)
        offset = local.utcoffset() // timedelta(microseconds=1)
        edge = lambda i: ((start_us + offset) // step + i) * step - offset
    edges = [edge(0)]
    while edges[-1] < end_us:
        if len(edges) > MOST_BUCKETS:
            raise ValueError(f"a report has {MOST_BUCKETS} buckets at most")
        edges.append(edge(len(edges)))
    if clip and len(edges) > 1:
        edges[0], edges[-1] = max(edges[0], start_us), min(edges[-1], end_us)
    return list(pairwise(edges))

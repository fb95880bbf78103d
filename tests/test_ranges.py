"""Ranges, axes and the ledger's rules."""

from datetime import UTC, datetime

import pytest

from tallyforge.functions import validate
from tallyforge.plans import ranges as R

HOUR = 3_600_000_000


def test_wall_times():
    assert R.wall_time("2026-03-28T12:00", "Europe/Kyiv") == datetime(2026, 3, 28, 10, tzinfo=UTC)
    assert R.wall_time("2026-10-25T03:30+02:00", "Europe/Kyiv") == datetime(2026, 10, 25, 1, 30, tzinfo=UTC)
    for text in ("2026-03-29T03:30", "2026-10-25T03:30"):
        with pytest.raises(ValueError):
            R.wall_time(text, "Europe/Kyiv")


def test_days_follow_the_clock():
    start, end = R.us(R.wall_time("2026-03-28T00:00", "Europe/Kyiv")), R.us(R.wall_time("2026-03-31T00:00", "Europe/Kyiv"))
    assert [(b - a) // HOUR for a, b in R.axis(start, end, "day", "Europe/Kyiv")] == [24, 23, 24]
    inside = R.axis(start + HOUR, end - HOUR, "day", "Europe/Kyiv")
    assert (inside[0][0], inside[-1][1]) == (start + HOUR, end - HOUR)
    assert R.axis(start + HOUR, end - HOUR, "day", "Europe/Kyiv", clip=False)[0][0] == start


def test_steps_and_limits():
    assert R.bucket_size(R.Range(0, HOUR)) == "five_minutes" and R.bucket_size(R.Range(0, 2 * HOUR)) == "hour" and R.bucket_size(R.Range(0, 49 * HOUR)) == "day"
    assert [a for a, _ in R.axis(HOUR // 2, 3 * HOUR, "hour", "Asia/Kolkata", clip=False)] == [HOUR // 2, 3 * HOUR // 2, 5 * HOUR // 2]
    with pytest.raises(ValueError):
        R.axis(0, 200_000 * HOUR, "five_minutes", "UTC")
    with pytest.raises(ValueError):
        R.Range(5, 5)


def test_presets():
    now = datetime(2026, 9, 16, 12, 34, tzinfo=UTC)
    at = lambda *x: R.us(datetime(*x, tzinfo=UTC))
    assert R.preset("week", now, "UTC") == R.Range(at(2026, 9, 14), at(2026, 9, 21))
    assert R.preset("month", now, "Europe/Kyiv") == R.Range(at(2026, 8, 31, 21), at(2026, 9, 30, 21))
    assert R.preset("month", datetime(2026, 12, 31, 23, tzinfo=UTC), "UTC") == R.Range(at(2026, 12, 1), at(2027, 1, 1))
    assert R.preset("day", datetime(2026, 3, 29, 9, tzinfo=UTC), "Europe/Kyiv") == R.Range(at(2026, 3, 28, 22), at(2026, 3, 29, 21))
    assert R.preset("hour", now, "Asia/Kolkata") == R.Range(at(2026, 9, 16, 12, 30), at(2026, 9, 16, 13, 30))
    assert R.preset("all", now, "UTC") == R.Range(None, None)


def test_violations(spark):
    names = [f"{b}_{k}" for b in ("input", "output", "cache_read", "cache_write") for k in ("state", "amount")]
    schema = "observation_id string, time_kind string, at_us long, start_us long, decision string, " + ", ".join(f"{n} {'string' if n.endswith('state') else 'long'}" for n in names)
    good = ("known", 1) * 4
    rows = [("a", "point", 5, None, "selected", *good), ("b", "undated", 5, None, "maybe", *good), ("c", "interval", 5, 6, "selected", "unknown", 1, *good[2:])]
    found = sorted((r.observation_id, r.rule.split(":")[0]) for r in validate.violations(spark.createDataFrame(rows, schema)).collect())
    assert found == [("b", "decision"), ("b", "time"), ("c", "input"), ("c", "time")]
    assert validate.duplicates(spark.createDataFrame([(1,), (1,), (2,)], "k int"), "k").count() == 1

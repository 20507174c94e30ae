"""Time bounds on the ``hour`` partition column.

``hour`` is epoch seconds of the hour start and ``start_time`` epoch microseconds.  All
alignment is UTC integer arithmetic, done once on the driver: the bounds become literals on
the partition column, which is what lets the scan prune directories.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

HOUR = 3600
DAY = 24 * HOUR
MICROS = 1_000_000

_DAY_RANGE = re.compile(r"^(\d{8})-(\d{8})$")


def floor_to(epoch_s: int, aligner: int) -> int:
    return (int(epoch_s) // aligner) * aligner


def _check_hours(hours) -> int:
    if isinstance(hours, bool) or not isinstance(hours, int):
        try:
            if isinstance(hours, bool):
                raise TypeError
            hours = int(str(hours).strip())
        except (TypeError, ValueError):
            raise ValueError(f"hours must be an integer, got {hours!r}") from None
    if hours < 0:
        raise ValueError(f"hours cannot be negative, got {hours}")
    return hours


def hours_ago_bound(now: int, hours: int, full_days: bool = False) -> int:
    """Lowest ``hour`` kept: ``now - hours`` floored to the hour (or to the UTC day with
    ``full_days``, so every day before today is complete).  ``hours=0`` means the current
    hour (current day with ``full_days``)."""
    hours = _check_hours(hours)
    return floor_to(int(now) - HOUR * hours, DAY if full_days else HOUR)


def day_range_bounds(text: str) -> tuple[int, int]:
    """``YYYYMMDD-YYYYMMDD``, both days inclusive -> half-open ``[lo, hi)`` in epoch seconds."""
    m = _DAY_RANGE.match(text or "")
    if not m:
        raise ValueError(f"invalid day range {text!r}; expected YYYYMMDD-YYYYMMDD")
    try:
        start, end = (datetime.strptime(p, "%Y%m%d").replace(tzinfo=timezone.utc) for p in m.groups())
    except ValueError:
        raise ValueError(f"invalid day range {text!r}") from None
    if start > end:
        raise ValueError(f"invalid day range {text!r}: start is after end")
    return int(start.timestamp()), int((end + timedelta(days=1)).timestamp())


def window_bounds(now: int, hours_ago=None, day_range=None, full_days: bool = False):
    """Exactly one of ``hours_ago`` / ``day_range`` -> ``(lo, hi)``; ``hi`` is None for an
    hours-ago window (it has no upper bound)."""
    if (hours_ago is None) == (day_range is None):
        raise ValueError("exactly one of hours_ago and day_range must be set")
    if hours_ago is not None:
        return hours_ago_bound(now, hours_ago, full_days), None
    return day_range_bounds(day_range)


def strict_seam(now: int, hourly: bool) -> int:
    """Re-query point of a refresh: start of the current hour minus 1 hour (hourly runs) or
    24 hours (daily runs)."""
    return floor_to(now, HOUR) - HOUR * (1 if hourly else 24)


def catchup_seam(retention_floor: int, last_seen_hour: int | None) -> int:
    """Catch-up re-query point: the later of the retention floor and the last hour seen in
    the previous snapshot, so gaps left by missed runs are filled."""
    if last_seen_hour is None:
        return retention_floor
    return max(int(retention_floor), int(last_seen_hour))

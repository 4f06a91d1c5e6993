"""Time helpers (F3, F4, F5 and the duration rule Q3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_between(later, earlier, wrap_day: bool = False) -> Column:
    """Whole seconds from ``earlier`` to ``later`` (floored).

    ``wrap_day=False`` (default) gives the true total; ``wrap_day=True``
    reproduces the seconds-of-day component of a Python ``timedelta``
    (2 days + 7 s -> 7, -5 s -> 86395), see Q3.
    """
    later = F.col(later) if isinstance(later, str) else later
    earlier = F.col(earlier) if isinstance(earlier, str) else earlier
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    secs = F.floor(micros / F.lit(1_000_000.0)).cast("long")
    if wrap_day:
        secs = F.pmod(secs, F.lit(86_400)).cast("long")
    return secs


def parse_time(c, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """parse text by a fixed format."""
    c = F.col(c) if isinstance(c, str) else c
    return F.to_timestamp(c, fmt)


def normalise_zone(ts, zone) -> Column:
    """F4 (Q27): naive local times to UTC instants.

    Zone ``'0'`` means US/Eastern wall time, ``'UTC'`` and anything else is
    taken as UTC already.  Works on a TIMESTAMP read in a UTC session.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    zone = F.col(zone) if isinstance(zone, str) else zone
    return F.when(zone == F.lit("0"), F.to_utc_timestamp(ts, "US/Eastern")).otherwise(ts)


def minutes(seconds) -> Column:
    seconds = F.col(seconds) if isinstance(seconds, str) else seconds
    return seconds / F.lit(60.0)

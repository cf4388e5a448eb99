"""Ranges of time for reading logs: relative, absolute, since the last start of an application or since a run."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STARTED = r"Started \w+ in [0-9.]+ seconds"  #: fixed value: the message of an application that has started
_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def duration(span: str) -> timedelta:
    """30s, 10m, 1.5h or 2d; anything else is an error."""
    found = re.fullmatch(r"\s*(\d+(?:\.\d+)?)([smhd])\s*", span)
    if not found:
        raise ValueError(f"not a duration (30s, 10m, 1h, 2d): {span}")
    return timedelta(seconds=float(found[1]) * _UNITS[found[2]])


def user_time(given: str, now: datetime) -> datetime:
    """A time as a user writes it, in the zone of ``now`` unless it names its own.

    ISO with a T, ``YYYY-MM-DD HH:MM[:SS]``, or ``HH:MM[:SS]``: the last such time that is not after ``now``.
    """
    given = given.strip()
    if re.fullmatch(r"\d\d:\d\d(:\d\d)?", given):
        at = datetime.combine(now.date(), datetime.fromisoformat(f"2000-01-01T{given}").time(), tzinfo=now.tzinfo)
        return at if at <= now else at - timedelta(days=1)
    if not re.match(r"\d{4}-\d\d-\d\d(T| +\d\d:\d\d(:\d\d)?$)", given):
        raise ValueError(f"not a time: {given}")
    at = datetime.fromisoformat(re.sub(" +", "T", given))
    return at if at.tzinfo else at.replace(tzinfo=now.tzinfo)


def resolve(
    now: datetime,
    since: str | None = None,
    start: str | None = None,
    end: str | None = None,
    deployed: datetime | None = None,
    run: datetime | None = None,
    default: str | None = None,
    log_zone: str = "UTC",
) -> tuple[datetime | None, datetime | None]:
    """The ends of a range as wall times of the log's zone; an open end is None.

    ``now`` bears the user's zone.  At most one of ``since`` (a duration), ``start`` (a time), ``deployed`` (a wall time of the
    log, as ``last_start`` finds it) and ``run`` (an instant) may be given, ``default`` (a duration) holds if none is.
    """
    if sum(x is not None for x in (since, start, deployed, run)) > 1:
        raise ValueError("give one start only: since, start, deployed or run")
    if now.tzinfo is None or (run is not None and run.tzinfo is None):
        raise ValueError("now and run need a zone")
    wall = lambda at: at.astimezone(ZoneInfo(log_zone)).replace(tzinfo=None)
    span = since if since is not None else default
    if deployed is not None:
        first = deployed
    elif start is not None or run is not None:
        first = wall(user_time(start, now) if start is not None else run)
    else:
        first = wall(now - duration(span)) if span is not None else None
    return first, wall(user_time(end, now)) if end is not None else None


def last_start(records: DataFrame, at: str, message: str) -> datetime | None:
    """When the application last started, by its message; None if it never did.  One value comes to the driver."""
    return records.where(F.rlike(message, F.lit(STARTED))).agg(F.max(F.col(at).cast("timestamp_ntz"))).first()[0]


def between(records: DataFrame, at: str, first: datetime | None, last: datetime | None) -> DataFrame:
    """Records of a range, both ends included, as literals that reach the scan; a null time is in no range with an end."""
    kind = dict(records.dtypes)[at]
    when = lambda t: F.lit(t.isoformat(sep=" ")).cast(kind)
    if first is not None:
        records = records.where(F.col(at) >= when(first))
    return records if last is None else records.where(F.col(at) <= when(last))

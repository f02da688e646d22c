"""Date functions (F1-F5, C8, C9) and pushdown-friendly date predicates."""

from __future__ import annotations

import datetime as _dt
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import col_


def to_day(c) -> Column:
    """Timestamp (already UTC in a UTC session) -> calendar day."""
    return F.to_date(col_(c))


def month_key(c) -> Column:
    """'yyyy-MM' month label."""
    return F.date_format(col_(c), "yyyy-MM")


def month_start(c) -> Column:
    """first day of the month, as DATE."""
    return F.to_date(F.date_trunc("month", col_(c)))


def calendar_columns(c) -> dict[str, Column]:
    """The calendar features of the reference model.

    ``week`` is the ISO week; ``day_of_week`` counts Monday as 0.
    """
    d = col_(c)
    return {
        "year": F.year(d),
        "month": F.month(d),
        "week": F.weekofyear(d),
        "day_of_week": F.weekday(d),
        "quarter": F.quarter(d),
    }


def parse_mixed(c, formats: Sequence[str]) -> Column:
    """Coercing parse that tries each format in order; none -> NULL."""
    return F.coalesce(*[F.try_to_timestamp(col_(c), F.lit(f)) for f in formats])


_OFFSET_LETTERS = set("XxZOV")


def parse_utc_day(c, formats: Sequence[str]) -> Column:
    """C8 + C9: parse with the first matching format and keep the UTC day.

    Text with an offset is an instant: converted to UTC, then truncated.
    Text without one is a wall time read as UTC (as a tz-naive parse would),
    so the written day is kept. Neither depends on the session time zone.
    """
    outs = []
    for f in formats:
        local = F.try_to_timestamp(col_(c), F.lit(f)).cast("timestamp_ntz")
        if _OFFSET_LETTERS & set(f):
            outs.append(F.to_date(F.convert_timezone(None, F.lit("UTC"), local)))
        else:
            outs.append(F.to_date(local))
    return F.coalesce(*outs)


def _ts(d) -> Column:
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d)
    # A wall-clock literal: no process or session time zone is involved.
    return F.lit(f"{d.isoformat()} 00:00:00").cast("timestamp_ntz")


def ts_day_range(ts_col: str, start=None, end=None) -> Column | None:
    """P4 on the raw timestamp column: both ends inclusive *days*.

    Written against the stored column (no function around it) so the
    comparison reaches the Parquet scan as a pushed filter.
    """
    conds = []
    if start:
        conds.append(F.col(ts_col) >= _ts(start))
    if end:
        e = _dt.date.fromisoformat(end) if isinstance(end, str) else end
        conds.append(F.col(ts_col) < _ts(e + _dt.timedelta(days=1)))
    if not conds:
        return None
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def ts_year(ts_col: str, year: int) -> Column:
    """P3 as a range on the stored column: ``year(ts) = y`` made pushable."""
    return ts_day_range(ts_col, f"{int(year):04d}-01-01", f"{int(year):04d}-12-31")

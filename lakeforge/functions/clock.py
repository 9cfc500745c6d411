"""Run-date arithmetic and date parts.

Everything is a column expression evaluated per query (never frozen at import).
Functions take an explicit ``run_date`` / ``run_ts`` so tests and re-runs are
reproducible; the default is the query's current date/time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _date_col(run_date) -> Column:
    if run_date is None:
        return F.current_date()
    if isinstance(run_date, (dt.date, str)):
        return F.to_date(F.lit(str(run_date)))
    return run_date


def processing_date(days_back: int = -1, run_date=None) -> Column:
    """``run_date + days_back`` days. The sign is kept: -1 is the day before, +1 the day after."""
    return F.date_add(_date_col(run_date), days_back)


def date_parts(d) -> dict[str, Column]:
    """Zero-padded ``yyyy``, ``MM``, ``dd`` text of a date or timestamp column."""
    c = F.col(d) if isinstance(d, str) else d
    return {
        "year": F.date_format(c, "yyyy"),
        "month": F.date_format(c, "MM"),
        "day": F.date_format(c, "dd"),
    }


def day_parts_python(day: dt.date) -> tuple[str, str, str]:
    """The same parts for a driver-side date (used to build partition filters)."""
    return day.strftime("%Y"), day.strftime("%m"), day.strftime("%d")


def clock_parts(run_ts=None) -> dict[str, Column]:
    """Second, minute, hour, day, month and year of the run clock. Month is text,
    the others integers, as in the legacy constants."""
    ts = F.current_timestamp() if run_ts is None else (F.lit(run_ts) if not isinstance(run_ts, Column) else run_ts)
    return {
        "second": F.second(ts),
        "minute": F.minute(ts),
        "hour": F.hour(ts),
        "day": F.dayofmonth(ts),
        "month": F.month(ts).cast("string"),
        "year": F.year(ts),
    }

"""Landed-file path parsing as native column expressions (no Python UDF).

A landed file lives under a dated folder ``.../yyyy/mm/dd/<file>``; the parts are
plain text, exactly as the legacy helpers produced them:

* ``file_name``  - the text after the last ``yyyy/mm/dd/`` (whole path if none)
* ``file_date``  - drop every ``P_`` + 5 digits tag and every non-digit, keep the first 8 chars
* ``file_year`` / ``file_month`` / ``file_day`` - chars 1-4, 5-6, 7.. of the date text

A digit earlier in the path leaks into ``file_date`` (``/abc123/2021/04/03/f``
gives ``12320210``); that is the legacy result and is kept.  NULL gives NULL.
Digits are ASCII ``0-9``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values (patterns that must produce the legacy results):
#   dated folder prefix:  .*[0-9]{4}/[0-9]{2}/[0-9]{2}/
#   date noise:           P_[0-9]{5}|[^0-9]
#   date text length:     8
# The prefix pattern is applied anchored at line starts, "(?m)^" + pattern: ".*"
# never crosses a line end, so every match starts at a line start anyway; the
# anchor only stops the engine from retrying at every later position (3x faster).
DATED_PREFIX = r".*[0-9]{4}/[0-9]{2}/[0-9]{2}/"
DATE_NOISE = r"P_[0-9]{5}|[^0-9]"
DATE_TEXT_LEN = 8
_DATED_PREFIX_AT_LINE_START = "(?m)^" + DATED_PREFIX

_REST = 2_147_483_647  # "to the end of the string" for substring


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_name(path) -> Column:
    """Text after the last ``yyyy/mm/dd/`` folder. ``.*`` is greedy, so the match
    always ends at the last dated folder."""
    return F.regexp_replace(_c(path), _DATED_PREFIX_AT_LINE_START, "")


def file_date(path) -> Column:
    """Digits of the path without ``P_nnnnn`` tags, first 8 characters."""
    return F.substring(F.regexp_replace(_c(path), DATE_NOISE, ""), 1, DATE_TEXT_LEN)


def file_year(date_text) -> Column:
    return F.substring(_c(date_text), 1, 4)


def file_month(date_text) -> Column:
    return F.substring(_c(date_text), 5, 2)


def file_day(date_text) -> Column:
    return F.substring(_c(date_text), 7, _REST)


def with_path_parts(df: DataFrame, path_col: str = "path", prefix: str = "file_") -> DataFrame:
    """Add ``file_name, file_date, file_year, file_month, file_day`` for ``path_col``."""
    date = file_date(path_col)
    return df.select(
        "*",
        file_name(path_col).alias(f"{prefix}name"),
        date.alias(f"{prefix}date"),
        file_year(date).alias(f"{prefix}year"),
        file_month(date).alias(f"{prefix}month"),
        file_day(date).alias(f"{prefix}day"),
    )

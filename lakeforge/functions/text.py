"""Scalar text helpers: case, quote cleanup, newline removal, base64, UTF-8,
casts.  All native Spark expressions (whole-stage codegen, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def upper(c) -> Column:
    return F.upper(_c(c))


def lower(c) -> Column:
    return F.lower(_c(c))


def title(c) -> Column:
    """Title case (first letter of each word upper)."""
    return F.initcap(_c(c))


def strip_quotes(c) -> Column:
    """Delete single quotes, then turn back-quotes into single quotes
    (literal replacements on the UTF-8 bytes; no regex, no per-character map)."""
    return F.replace(F.replace(_c(c), F.lit("'"), F.lit("")), F.lit("`"), F.lit("'"))


def remove_newlines(c) -> Column:
    return F.replace(_c(c), F.lit("\n"), F.lit(""))


def to_utf8(c) -> Column:
    """Text to its UTF-8 bytes."""
    return F.encode(_c(c), "UTF-8")


def b64encode(c) -> Column:
    """Base64 text of a binary column (one line when ``spark.sql.chunkBase64String.enabled`` is false)."""
    return F.base64(_c(c))


def b64decode(c, strict: bool = True) -> Column:
    """Bytes of base64 text; ``strict=False`` gives NULL for malformed input."""
    return F.unbase64(_c(c)) if strict else F.try_to_binary(_c(c), F.lit("base64"))

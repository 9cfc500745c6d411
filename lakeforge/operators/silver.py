"""Silver layer: conform and cleanse, de-duplicate, flag current rows, match and
merge sources into a master, cross-reference keys, normalise.

Skew notes (one key may hold a third of all rows):

* ``dedupe_latest`` uses ``row_number() = 1``; Spark plans a partial group limit
  before the shuffle, so each map task sends at most one row per key; a hot key
  never reaches one task whole.
* ``dedupe_exact`` aggregates digests (partial ``min``) and touches whole rows
  only where a digest repeats.
* ``flag_active`` joins back on keys *plus* the order columns; that join key is
  near-unique, so hash partitioning spreads a hot key over all tasks.
* ``match_merge`` is one aggregation per key; each task reduces its rows of a hot
  key before the shuffle.
* ``cross_reference`` writes the per-group table (partial ``min``) and joins the
  re-read table, so a small one is broadcast before any row moves; otherwise AQE
  splits the skewed partitions of the sort-merge join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import measured

ACTIVE_FLAG = "Row_IsActive"


# --------------------------------------------------------------------------- L7 conform

@dataclass
class ConformRules:
    """Column rules applied in one projection (in this order per column):
    rename, trim + collapse spaces, case, cast, default.  A value that can't be
    cast fails the job if ``strict``, else becomes NULL."""

    renames: Mapping[str, str] = field(default_factory=dict)
    trim: Sequence[str] = ()
    upper: Sequence[str] = ()
    lower: Sequence[str] = ()
    title: Sequence[str] = ()
    casts: Mapping[str, str] = field(default_factory=dict)
    defaults: Mapping[str, object] = field(default_factory=dict)
    remove_newlines: Sequence[str] = ()
    strict: bool = False


def conform(df: DataFrame, rules: ConformRules) -> DataFrame:
    """Cleanse and conform columns (``just enough``) in a single select."""
    out = []
    for name in df.columns:
        new = rules.renames.get(name, name)
        c = F.col(name)
        if new in rules.remove_newlines:
            c = F.replace(c, F.lit("\n"), F.lit(""))
        if new in rules.trim:
            c = F.trim(F.regexp_replace(c, r"\s+", " "))
        if new in rules.upper:
            c = F.upper(c)
        if new in rules.lower:
            c = F.lower(c)
        if new in rules.title:
            c = F.initcap(c)
        if new in rules.casts:
            c = c.cast(rules.casts[new]) if rules.strict else c.try_cast(rules.casts[new])
        if new in rules.defaults:
            c = F.coalesce(c, F.lit(rules.defaults[new]))
        out.append(c.alias(new))
    return df.select(*out)


# --------------------------------------------------------------------------- L8 de-duplicate

def _desc(cols: Sequence[str]) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in cols]


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def dedupe_latest(df: DataFrame, keys: Sequence[str], order_desc: Sequence[str]) -> DataFrame:
    """Keep the latest row per key, latest = greatest ``order_desc`` values
    (NULLs count as oldest).  End ``order_desc`` with a unique column so the
    choice is deterministic.  Helper columns get names the data don't have."""
    w, rn = Window.partitionBy(*keys).orderBy(*_desc(order_desc)), fresh("_rn", df)
    return df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) == 1).drop(rn)


def dedupe_exact(df: DataFrame, subset: Sequence[str], keep_min: str) -> DataFrame:
    """Among rows equal on ``subset`` keep the one with the smallest ``keep_min`` (NULL last).

    Rows are equal if the SHA-256 of their ``subset`` is.  First only digests are
    aggregated, some 40 bytes a row; those that repeat are written down with their
    least ``keep_min``.  Then one left join lets pass what doesn't repeat and what
    is least; rows that tie there meet a join of their own, which Spark drops at run
    time where nothing ties.  Helper columns get names the data don't have.
    """
    d, k, least, n = (fresh(c, df) for c in ("_d", "_k", "_least", "_n"))
    digest = F.unhex(key_text(*subset, digest=True))
    counts = df.select(digest.alias(d), F.col(f"`{keep_min}`").alias(k)).groupBy(d, k).agg(F.count(F.lit(1)).alias(n))
    first = F.min(F.struct(F.col(k).isNull(), F.col(k).alias(least), F.col(n).alias(n))).alias("first")
    again = counts.groupBy(d).agg(F.sum(n).alias("all"), first).where(F.col("all") > 1).select(d, f"first.{least}", f"first.{n}")
    again = measured(again, "dedupe")
    rows, own = df.withColumn(d, digest), [F.col(f"`{c}`") for c in df.columns]
    is_least = F.col(f"`{keep_min}`").eqNullSafe(F.col(least))
    lone = rows.join(again, d, "left").where(F.col(n).isNull() | ((F.col(n) == 1) & is_least)).select(*own)
    tied, number = rows.join(again.where(F.col(n) > 1), d).where(is_least), fresh("_number", df)
    first_tied = tied.withColumn(number, F.row_number().over(Window.partitionBy(d).orderBy(F.lit(1)))).where(F.col(number) == 1).select(*own)
    return lone.unionByName(first_tied)


# --------------------------------------------------------------------------- L9 current-row flag

def flag_active(df: DataFrame, keys: Sequence[str], order_desc: Sequence[str], flag: str = ACTIVE_FLAG) -> DataFrame:
    """Every row plus a boolean ``flag`` that is true on the latest row per key.

    Exactly one row of a key is active: rows that tie on keys and order columns,
    repeated rows included, are numbered (by their other columns), and the first
    one counts.  Helper columns get names the data don't have.

    The latest key and order columns are found, with their number, on those columns
    alone (every task sends at most the rows that tie for latest), and the rows meet
    them in a join.  Rows that tie for latest meet them in a join of their own; only
    those are numbered.
    """
    cols = list(dict.fromkeys([*keys, *order_desc]))
    n, r = fresh("_n", df), fresh("_r", df)
    slim = df.select(*[F.col(f"`{c}`") for c in cols])
    latest = Window.partitionBy(*keys).orderBy(*_desc(order_desc))
    top = slim.withColumn(r, F.rank().over(latest)).where(F.col(r) == 1).groupBy(*cols).agg(F.count(F.lit(1)).alias(n))
    names = {c: fresh(f"_l_{c}", df) for c in cols}
    top = top.select(*[F.col(f"`{c}`").alias(names[c]) for c in cols], n)
    same, number = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(names[c])) for c in cols]), fresh("_number", df)
    own = [F.col(f"`{c}`") for c in df.columns]
    lone = df.join(top, same, "left").where(F.col(n).isNull() | (F.col(n) == 1)).select(*own, F.col(n).isNotNull().alias(flag))
    rest = [c for c, kind in df.dtypes if c not in cols and not kind.startswith(("map", "variant"))]
    by = Window.partitionBy(*[F.col(f"`{c}`") for c in cols]).orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in rest] or [F.lit(1)])
    tied = df.join(top.where(F.col(n) > 1), same).withColumn(number, F.row_number().over(by)).select(*own, (F.col(number) == 1).alias(flag))
    return lone.unionByName(tied)


def active_rows(df: DataFrame, flag: str = ACTIVE_FLAG) -> DataFrame:
    """Rows whose active flag is true (the published view's filter)."""
    return df.where(F.col(flag))


# --------------------------------------------------------------------------- L10 match and merge

def match_merge(left: DataFrame, right: DataFrame, on: Sequence[str], prefer: str = "left",
                source_col: str = "_matched") -> DataFrame:
    """Merge two conformed sources into one master with one row per key.

    Each attribute present in both takes the preferred source's value when not
    NULL, else the other's.  ``source_col`` says where the row came from:
    ``both``, ``left`` or ``right``.  A key that a source repeats is first reduced
    to that source's least row.  Rows with a NULL in the key match nothing and
    pass through.

    The sources are stacked and aggregated once by key, each task's rows first,
    so a hot key costs no task more than its own rows.
    """
    sides = {"left": left, "right": right}
    attrs = list(dict.fromkeys(c for df in sides.values() for c in df.columns if c not in on))
    kinds = {c: next(df.schema[c].dataType for df in sides.values() if c in df.columns) for c in attrs}

    def shaped(side: str) -> DataFrame:
        df = sides[side]
        return df.select(*on, F.struct(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in attrs] or [F.lit(1).alias("_")]).alias("_row"),
                         F.lit(side).alias("_side"))

    rows = shaped("left").unionByName(shaped("right"))
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on])
    least = {side: F.min(F.when(F.col("_side") == side, F.col("_row"))).alias(f"_{side}") for side in sides}
    matched = rows.where(keyed).groupBy(*on).agg(*least.values())
    lone = rows.where(~keyed).select(*on, *[F.when(F.col("_side") == side, F.col("_row")).alias(f"_{side}") for side in sides])
    order = ("_left", "_right") if prefer == "left" else ("_right", "_left")
    source = F.when(F.col("_left").isNull(), "right").when(F.col("_right").isNull(), "left").otherwise("both")
    return matched.unionByName(lone).select(*on, *[F.coalesce(*[F.col(s)[c] for s in order]).alias(c) for c in attrs], source.alias(source_col))


# --------------------------------------------------------------------------- L11 cross-reference

def cross_reference(df: DataFrame, match_keys: Sequence[str], key: str, master_col: str = "master_key") -> DataFrame:
    """Source key -> master key, the smallest key among rows that match on
    ``match_keys`` (NULL keys match each other).  One row per input row:
    ``key, *match_keys, master_key``.

    The per-group minimum (partial ``min`` in every task) is written down and
    joined as a table of known size, on one text that encodes the match keys
    without ambiguity and is never NULL.
    """
    rows = df.select(key, *match_keys, key_text(*match_keys).alias("_g"))
    groups = measured(rows.groupBy("_g").agg(F.min(key).alias(master_col)), "xref")
    return rows.join(groups, "_g").select(key, *match_keys, master_col)


# --------------------------------------------------------------------------- L12 normalise

def key_text(*cols: str, digest: bool = False) -> Column:
    """The columns as one text that differs whenever a column does: each value with
    its length in bytes before it, NULL as ``-``.  ``digest`` takes its SHA-256."""
    parts = []
    for c in cols:
        text = F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    whole = F.concat_ws(";", *parts)
    return F.sha2(whole, 256) if digest else whole


def hash_key(*cols: str) -> Column:
    """Hub / link key: SHA-256 of the business key columns."""
    return key_text(*cols, digest=True)


def normalise(df: DataFrame, entities: Mapping[str, tuple[Sequence[str], Sequence[str]]]) -> dict[str, DataFrame]:
    """Split a wide table into entity tables.

    ``entities`` maps a name to (business key columns, attribute columns); each
    entity is the distinct rows of key + attributes with a ``<name>_key`` hash
    column (a partial + final hash aggregate, duplicates removed map-side).
    """
    out = {}
    for name, (bkeys, attrs) in entities.items():
        cols = list(dict.fromkeys([*bkeys, *attrs]))
        out[name] = df.select(*cols).distinct().select(hash_key(*bkeys).alias(f"{name}_key"), *cols)
    return out

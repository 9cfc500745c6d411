"""Relational building blocks of the sample job: projection, filters, distinct,
ordering, top-k, first row, stacking.

All of them are thin DataFrame expressions on purpose: Catalyst pushes the
filters into the parquet scan, prunes columns, and plans ``distinct`` as a
partial (map-side) plus final hash aggregate, so duplicates are removed before
the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def select_all(df: DataFrame) -> DataFrame:
    """``SELECT *``."""
    return df.select("*")


def where_all(df: DataFrame, *conditions: Column) -> DataFrame:
    """Conjunction of conditions (``a AND b AND ...``); NULL counts as false."""
    if not conditions:
        return df
    return df.where(reduce(lambda a, b: a & b, conditions))


def not_equal(column: ColumnOrName, value) -> Column:
    """``col != value``; rows where ``col`` is NULL do not pass."""
    return _col(column) != F.lit(value)


def greater_than(column: ColumnOrName, value) -> Column:
    """``col > value``; a string literal is cast to the column's type (folded once)."""
    return _col(column) > F.lit(value)


def not_in(column: ColumnOrName, values: Iterable) -> Column:
    """``col NOT IN (...)``; NULL in the column does not pass (as in SQL)."""
    return ~_col(column).isin(list(values))


def distinct_rows(df: DataFrame) -> DataFrame:
    """GROUP BY every output column with no aggregate, i.e. distinct rows."""
    return df.distinct()


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """First ``k`` rows by ``order``. Planned as a per-partition top-k followed by
    a merge of at most ``k`` rows per partition (``TakeOrderedAndProject``); give a
    unique key as the last order column so ties are deterministic."""
    return df.orderBy(*order).limit(k)


def first_row(df: DataFrame) -> DataFrame:
    """The first row only (``head(1)``), as a DataFrame."""
    return df.limit(1)


def drop_columns(df: DataFrame, excluded: Iterable[str]) -> DataFrame:
    """Drop columns by name; names not present are ignored."""
    return df.drop(*[c for c in excluded if c])


def stack(frames: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def filter_distinct_sort(df: DataFrame, conditions: Sequence[Column], order_desc: Sequence[str]) -> DataFrame:
    """The sample job's shape: filter, group by every column, order descending.

    Rows are unique after the distinct, so the remaining columns are added as
    ascending tiebreaks: the order is deterministic and the range partitioning of
    the global sort can split a heavily repeated sort value over many tasks.
    """
    rows = distinct_rows(where_all(df, *conditions))
    rest = [c for c in rows.columns if c not in order_desc]
    return rows.orderBy(*[F.col(c).desc_nulls_last() for c in order_desc], *[F.col(c).asc() for c in rest])

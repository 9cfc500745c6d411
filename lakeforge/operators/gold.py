"""Gold layer: star-schema joins, data-quality rules, business marts, and
joins across marts.

Money is summed exactly and turned into ``double`` only at the end, so totals do
not depend on the order rows were added in or on the cluster size: as
``decimal`` (the source columns carry two decimals, so the cast is exact), or,
on the hottest path, as split 64-bit integer sums of cents (``exact_units_sum``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def cents(c) -> Column:
    """A two-decimal amount as an integer number of cents; an amount with more decimals raises."""
    scaled = (F.col(c) if isinstance(c, str) else c) * 100
    whole = F.round(scaled)
    # a double holds a two-decimal amount to a relative error below 1e-15
    more = F.abs(scaled - whole) > 1e-6 + F.abs(scaled) * 1e-14
    return F.when(more, F.raise_error(F.lit("amount has more than two decimals"))).otherwise(whole.cast("long"))


def money(c) -> Column:
    """A two-decimal amount as an exact decimal; an amount with more decimals raises."""
    return (cents(c).cast("decimal(20,0)") / F.lit(100)).cast(MONEY)


SPLIT_BITS = 24


def exact_units_sum(units: Column, scale: int) -> Column:
    """Exact sum of integer amounts (``scale`` implied decimals) as ``decimal(38, scale)``.

    Two 64-bit sums run in the aggregation buffer instead of one 38-digit decimal
    sum (which Spark adds through arbitrary-precision objects, about twice as
    slow): the high part ``units >> 24`` and the low part ``units & (2^24 - 1)``.
    Neither can overflow below ~5e11 rows per group even for amounts of 1e13
    units, so a hot group is still exact; the parts are recombined once per group.
    """
    b = 1 << SPLIT_BITS
    hi = F.sum(F.shiftright(units, SPLIT_BITS)).cast("decimal(38,0)")
    lo = F.sum(units.bitwiseAND(F.lit(b - 1))).cast("decimal(38,0)")
    return ((hi * F.lit(b) + lo) / F.lit(10 ** scale)).cast(f"decimal(38,{scale})")


# --------------------------------------------------------------------------- L13 star join

@dataclass
class Dimension:
    """A dimension to attach: its frame and the join columns (fact column, dim column)."""

    frame: DataFrame
    on: Sequence[tuple[str, str]]
    how: str = "inner"


def star_join(fact: DataFrame, dims: Sequence[Dimension]) -> DataFrame:
    """Denormalise a fact with its dimensions, in the order given.

    The strategy is Spark's: a dimension whose files are below the broadcast
    threshold is broadcast, another one is joined by a shuffle on the key, which
    AQE may turn into a broadcast from the measured size and whose skewed
    partitions it splits.  No job runs while the join is declared.  Put the
    dimensions that shrink or widen the fact least last.
    """
    out = fact
    for d in dims:
        cond = reduce(lambda a, b: a & b, [out[f] == d.frame[k] for f, k in d.on])
        out = out.join(d.frame, cond, d.how)
    return out


# --------------------------------------------------------------------------- L14 quality rules

def apply_quality(df: DataFrame, rules: Mapping[str, Column], failed_col: str = "_failed_rules"):
    """Evaluate named rules (true = pass; NULL counts as a failure).

    Returns ``(passed, rejected, report)``: ``passed`` holds the rows meeting every
    rule, ``rejected`` the others with the names of the failed rules, ``report``
    one row per rule with the number of failing rows and the total.  The report
    is a single global aggregate (partial counts per task, one tiny merge).
    """
    names = list(rules)
    ok = {n: F.coalesce(rules[n], F.lit(False)) for n in names}
    all_ok = reduce(lambda a, b: a & b, ok.values())
    # passed: the raw conjunction.  WHERE already drops rows where it is NULL, so
    # no coalesce is needed here, and simple comparisons reach the parquet scan.
    passed = df.where(reduce(lambda a, b: a & b, [rules[n] for n in names]))
    failed = F.filter(F.array(*[F.when(~ok[n], F.lit(n)) for n in names]), lambda x: x.isNotNull())
    rejected = df.where(~all_ok).withColumn(failed_col, failed)
    total = "_total"
    while total in names:
        total += "_"
    counts = df.agg(F.count(F.lit(1)).alias(total),
                    *[F.count_if(~ok[n]).alias(n) for n in names])
    report = counts.unpivot(total, names, "rule", "failed_rows").select(
        "rule", F.col("failed_rows").cast("bigint").alias("failed_rows"),
        F.col(total).cast("bigint").alias("total_rows"))
    return passed, rejected, report


def quality_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    return apply_quality(df, rules)[2]


# --------------------------------------------------------------------------- L15 mart

def mart(df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """Business mart, one row per key with the named aggregate measures."""
    return df.groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()])


# --------------------------------------------------------------------------- L16 cross mart

def cross_mart(marts: Sequence[DataFrame], on: Sequence[str], how: str = "full_outer") -> DataFrame:
    """Join marts that share conformed keys (``on``).

    A mart has one row per key, so no key is frequent here.
    """
    return reduce(lambda a, b: a.join(b, list(on), how), marts)


# --------------------------------------------------------------------------- L5, L14 measured while writing

def write_quality(df: DataFrame, rules: Mapping[str, Column], path: str, passed_col: str = "__passed",
                  failed_col: str = "_failed_rules") -> dict[str, int]:
    """Passed and quarantined rows written from one scan, and the counts taken by the same job.

    Below ``path`` lie ``<passed_col>=true`` and ``<passed_col>=false``, the latter with the names of the failed rules.
    Returns ``rows``, ``passed`` and the failing rows of each rule (``failed.<rule>``), as an ``Observation`` of the
    writing job; no row is read again for the report.
    """
    for c in (passed_col, failed_col):
        if c in df.columns:
            raise ValueError(f"the data have a column {c}; name another")
    ok = {n: F.coalesce(rule, F.lit(False)) for n, rule in rules.items()}
    failed = F.filter(F.array(*[F.when(~passes, F.lit(n)) for n, passes in ok.items()]), lambda x: x.isNotNull())
    seen = Observation()
    marked = df.withColumn(failed_col, failed).withColumn(passed_col, F.size(failed_col) == 0)
    watched = marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(passed_col)).alias("passed"),
                             *[F.count_if(F.array_contains(failed_col, n)).alias(f"failed.{n}") for n in ok])
    watched.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(passed_col).parquet(path)
    return {name: int(n) for name, n in seen.get.items()}

"""Transitive cross-reference.  Records that any of several rules matches, directly or through others, get one master."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import measured
from .silver import key_text


def rule_edges(df: DataFrame, rules: Sequence[Sequence[str]], key: str) -> DataFrame:
    """``u``, ``v``: per rule each record with the least key that shares its values: a star, however large the group.

    A rule with a NULL in a record's columns does not match it.
    """
    edges = None
    for rule in rules:
        have = F.lit(True)
        for c in rule:
            have = have & F.col(f"`{c}`").isNotNull()
        rows = df.where(have).select(F.col(f"`{key}`").alias("u"), key_text(*[f"`{c}`" for c in rule], digest=True).alias("g"))
        least = measured(rows.groupBy("g").agg(F.min("u").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "rule")
        star = rows.join(least, "g").where("u > v").select("u", "v")
        edges = star if edges is None else edges.unionByName(star)
    return edges.distinct()


def large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least node around that node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and the nodes below it are tied to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    met = edges.join(least, "u")
    return met.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u``, ``v``: every node that is not the least of its connected component, with that least node.

    Alternating large and small stars until nothing changes, some log(n) rounds.  Edges stay stars: a hot node meets a
    unique row on the other side of each join, so Spark splits it.  Each round is written to the shared folder.
    """
    def state(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = measured(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v"), "edges")
    now = state(edges)
    while True:
        edges = measured(small_star(large_star(edges)), "edges")
        before, now = now, state(edges)
        if now == before:
            return edges


def cross_reference_all(df: DataFrame, rules: Sequence[Sequence[str]], key: str, master_col: str = "master_key") -> DataFrame:
    """``key`` and ``master_key``, the least key among all records connected by the rules, for every row.

    Rows with a NULL key have a NULL master; repeated keys are one record, and each of their rows is given.
    """
    found = components(rule_edges(df.where(F.col(f"`{key}`").isNotNull()), rules, key)).select(F.col("u").alias("__u"), F.col("v").alias("__v"))
    rows = df.select(F.col(f"`{key}`"))
    return rows.join(found, F.col(f"`{key}`") == F.col("__u"), "left").select(F.col(f"`{key}`"), F.coalesce("__v", F.col(f"`{key}`")).alias(master_col))

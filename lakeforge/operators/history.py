"""What changed between snapshots, and the history of entities (hubs, links and satellites)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import hadoop_fs, measured
from .silver import fresh, key_text


# --------------------------------------------------------------------------- L3 changes between two snapshots

def snapshot_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], op: str = "op") -> DataFrame:
    """L3: the rows that differ between two snapshots of one table, with ``op``: ``insert``, ``update`` or ``delete``.

    Inserts and updates carry the new row, deletes the old one.  NULL keys match each other; a key that a snapshot
    repeats is compared as a whole (all its rows, in any order), and each of its rows is given.  Columns in one snapshot
    only count as NULL in the other.

    Only key and digest of a row are shuffled and compared, summed up per key in every task first; they are written
    down where they differ.  Of the wide rows only those of changed keys are wanted: Spark joins them by broadcast while
    the changed keys are few, and prunes by a filter over them otherwise.
    """
    columns = list(dict.fromkeys([*new.columns, *old.columns]))
    kinds = {c: (new if c in new.columns else old).schema[c].dataType for c in columns}
    key, side = fresh("key", old, new), fresh("side", old, new)

    def shaped(df: DataFrame, name: str) -> DataFrame:
        same = df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in columns])
        return same.select("*", F.unhex(key_text(*[f"`{k}`" for k in keys], digest=True)).alias(key), F.lit(name).alias(side))

    sides = {"old": shaped(old, "old"), "new": shaped(new, "new")}
    whole = key_text(*[f"`{c}`" for c in columns])

    def digests(name: str) -> DataFrame:
        rows = sides[name].select(F.col(key), F.xxhash64(whole).alias("h"), F.xxhash64(F.lit(1), whole).alias("g"))
        return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h"), F.bit_xor("g").alias("g"))

    before, after = digests("old").alias("o"), digests("new").alias("n")
    what = F.when(F.col("o.n").isNull(), "insert").when(F.col("n.n").isNull(), "delete").otherwise("update")
    same = (F.col("o.n") == F.col("n.n")) & (F.col("o.h") == F.col("n.h")) & (F.col("o.g") == F.col("n.g"))
    changed = before.join(after, key, "full").where(~F.coalesce(same, F.lit(False))).select(key, what.alias(op))
    changed = measured(changed, "changes")
    from_new = sides["new"].join(changed.where(F.col(op) != "delete"), key)
    from_old = sides["old"].join(changed.where(F.col(op) == "delete"), key)
    return from_new.unionByName(from_old).select(F.col(op), *[F.col(f"`{c}`") for c in columns])


# --------------------------------------------------------------------------- L12 hubs, links and satellites

def entity_key(cols: Sequence[str]) -> Column:
    """The hash key of a hub (one business key) or link (several)."""
    return key_text(*[f"`{c}`" for c in cols], digest=True)


def hub(df: DataFrame, business_keys: Sequence[str], seen: str, name: str) -> DataFrame:
    """An entity's ``<name>_key``, business key and ``first_seen``; also a link, given the keys it connects."""
    return df.groupBy(*business_keys).agg(F.min(seen).alias("first_seen")).select(entity_key(business_keys).alias(f"{name}_key"), *business_keys, "first_seen")


def versions(df: DataFrame, keys: Sequence[str], attributes: Sequence[str], valid_from: str, order: Sequence[str] = ()) -> DataFrame:
    """``entity_key``, keys, attributes, ``valid_from``, ``hash_diff``: one row per key and time.

    Of several rows at one time the one with the greatest ``order`` columns counts (end it with a unique column); rows
    without a time are left out, as nothing says when they held.  Rows are shuffled once, before the hashes are taken.
    """
    whole = key_text(*[f"`{c}`" for c in attributes])
    diff = F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(F.lit(1), whole).alias("b"))
    rank = [*order, *attributes]
    rows = df.where(F.col(valid_from).isNotNull()).select(
        key_text(*[f"`{c}`" for c in keys]).alias("key"), F.struct(*keys, *attributes, F.col(valid_from).alias("valid_from")).alias("row"),
        *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)])
    of_rank = [f"o{k}" if k < len(order) else f"row.`{c}`" for k, c in enumerate(rank)]
    last = Window.partitionBy("key", "row.valid_from").orderBy(*[F.desc(c) for c in of_rank])
    one = rows.withColumn("n", F.row_number().over(last)).where("n = 1").select("row.*")
    return one.select(entity_key(keys).alias("entity_key"), *keys, *attributes, "valid_from", diff.alias("hash_diff"))


#: Entities are counted in so many buckets; those of a bucket of more than ``HOT`` rows are worked on by spans of time.
BUCKETS, HOT = 65_536, 100_000


def _parted(rows: DataFrame, of: DataFrame, span: str) -> DataFrame:
    """``rows`` dealt by ``entity_key`` (as bytes) and ``__part``: the span of time where an entity of ``of`` may have many
    rows, else NULL.  One shuffle; the windows and joins by these two columns that follow need no other."""
    def bucket(df: DataFrame) -> Column:
        return F.pmod(F.xxhash64(df["entity_key"]), F.lit(BUCKETS)).cast("int").alias("__bucket")

    large = of.groupBy(bucket(of)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("__bucket", F.lit(True).alias("__hot"))
    dealt = rows.select("*", bucket(rows)).join(F.broadcast(large), "__bucket", "left")
    dealt = dealt.withColumn("__part", F.when(F.col("__hot"), F.date_trunc(span, "valid_from"))).withColumn("entity_key", F.unhex("entity_key"))
    return dealt.drop("__bucket", "__hot").repartition("entity_key", "__part")


def _inside() -> WindowSpec:
    return Window.partitionBy("entity_key", "__part").orderBy("valid_from")


def _across() -> WindowSpec:
    return Window.partitionBy("entity_key").orderBy("__part")


def _beginnings(part: DataFrame) -> DataFrame:
    """The rows of ``_parted`` rows that begin an interval: those that differ from the row before."""
    ends = part.where("__part IS NOT NULL").groupBy("entity_key", "__part").agg(F.max_by("hash_diff", "valid_from").alias("last"))
    ends = ends.select("entity_key", "__part", F.lag("last").over(_across()).alias("earlier"))
    marked = part.withColumn("n", F.row_number().over(_inside())).withColumn("before", F.lag("hash_diff").over(_inside())).join(ends, ["entity_key", "__part"], "left")
    before = F.when(F.col("n") == 1, F.col("earlier")).otherwise(F.col("before"))
    return marked.where(~before.eqNullSafe(F.col("hash_diff"))).drop("n", "before", "earlier")


def intervals(rows: DataFrame, span: str = "day") -> DataFrame:
    """Effective intervals.  ``rows`` as from ``versions``; runs of equal attributes become one row with
    ``valid_from`` and ``valid_to`` (NULL for the current one).

    Gaps and islands by windows over an entity's rows.  Where an entity may have many rows (a key with a third of all
    is no single task) in two steps: inside each (key, span of time), and between spans by one row per key and span.
    """
    kept = _beginnings(_parted(rows, rows, span))
    starts = kept.where("__part IS NOT NULL").groupBy("entity_key", "__part").agg(F.min("valid_from").alias("start"))
    starts = starts.select("entity_key", "__part", F.lead("start").over(_across()).alias("later"))
    closed = kept.withColumn("next", F.lead("valid_from").over(_inside())).join(starts, ["entity_key", "__part"], "left")
    closed = closed.withColumn("valid_to", F.coalesce("next", "later")).withColumn("entity_key", F.lower(F.hex("entity_key")))
    return closed.select(*rows.columns, "valid_to")


def load_satellite(path: str, changes: DataFrame, span: str = "day") -> int:
    """Add to the satellite at ``path`` what ``changes`` (as from ``versions``) tell that it doesn't hold; the rows added.

    Insert only: stored rows are never rewritten.  The history of the keys at hand, stored and new, is run together;
    what starts an interval there and isn't stored is appended.  So a reload adds nothing, and late rows find their
    place when the history is read (``read_satellite``).  ``changes`` is read more than once: write it down first if it
    costs more than a scan.
    """
    spark = changes.sparkSession
    fs, folder = hadoop_fs(spark, path)
    if not fs.exists(folder):
        fresh = _beginnings(_parted(changes, changes, span))
    else:
        stored = spark.read.schema(changes.schema).parquet(path)
        keys = measured(changes.select("entity_key").distinct(), "satellite-keys")
        own = stored.join(keys, "entity_key", "left_semi").withColumn("stored", F.lit(True))
        both = own.unionByName(changes.withColumn("stored", F.lit(False)))
        of = stored.select("entity_key").unionByName(changes.select("entity_key"))
        same = Window.partitionBy("entity_key", "__part", "valid_from").orderBy(F.desc("stored"))
        one = _parted(both, of, span).withColumn("n", F.row_number().over(same)).where("n = 1").drop("n")
        fresh = _beginnings(one).where("NOT stored")
    fresh = measured(fresh.withColumn("entity_key", F.lower(F.hex("entity_key"))).select(*changes.columns), "satellite")
    added = fresh.count()
    if added:
        fresh.write.mode("append").parquet(path)
    return added


def read_satellite(spark, path: str, span: str = "day") -> DataFrame:
    """The satellite's history with ``valid_from`` and ``valid_to``."""
    return intervals(spark.read.parquet(path), span)

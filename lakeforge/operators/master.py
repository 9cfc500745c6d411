"""A master table on disk that is brought up to date by key buckets (copy on write).

Rows are dealt into a fixed number of buckets by a hash of their key.  A bucket's rows lie in one folder per load that
wrote it; a small manifest per load names the folder that is current for every bucket.  An update

1. finds its own buckets (at most as many numbers as there are buckets),
2. reads only those, joins the update to them, and writes them to folders of its own,
3. publishes a manifest under the next number by a rename that fails if another load took it.

Until step 3 readers see the old state, a failed load leaves it as it was, and the files of other buckets are never
opened.  Inside, columns have names of the table's own, so no user column clashes with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.manifest import ManifestLog
from ..session import hadoop_fs
from .silver import dedupe_latest

#: Partition column of the files; the double underscore keeps it apart from user columns, and it is refused as one.
BUCKET = "__bucket"


class StoredMaster:
    """A master of one row per key below ``path``; rows with a NULL in the key match nothing and are kept as they come."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.log = ManifestLog(spark, self.path)

    def manifest(self) -> dict | None:
        """The current state: ``load``, ``schema``, ``buckets`` and ``folders`` (bucket -> load that wrote it)."""
        return self.log.latest()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _write(self, rows: DataFrame, load: int) -> list[int]:
        """Write rows (with their bucket) as the folders of a load; the buckets written."""
        folder = f"{self.path}/data/load={load}"
        rows.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(folder)
        fs, path = hadoop_fs(self.spark, folder)
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}="))

    def _folders(self, state: dict, buckets: Sequence[int]) -> list[str]:
        return [f"{self.path}/data/load={state['folders'][str(b)]}/{BUCKET}={b}" for b in buckets if str(b) in state["folders"]]

    def _read(self, state: dict, buckets: Sequence[int]) -> DataFrame:
        schema, folders = StructType.fromJson(state["schema"]), self._folders(state, buckets)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The master as of its last published load."""
        state = self.manifest()
        if state is None:
            raise ValueError(f"no master at {self.path}")
        return self._read(state, range(state["buckets"]))

    def upsert(self, updates: DataFrame, latest: Sequence[str] = ()) -> list[int]:
        """Merge ``updates`` into the master and publish it; the buckets rewritten.

        A value of the update that is not NULL replaces the master's.  A key that the update repeats counts with its
        latest row (greatest ``latest`` columns, then greatest row digest).  Columns the master lacks are added to it;
        those the update lacks stay.  The first load makes the master; an empty update publishes nothing.
        """
        if BUCKET in updates.columns:
            raise ValueError(f"a column may not be called {BUCKET}")
        state = self.manifest()
        if state is not None and (state["buckets"] != self.buckets or state["keys"] != self.keys):
            raise ValueError(f"the master at {self.path} has {state['buckets']} buckets by {state['keys']}")
        keyed = F.lit(True)
        for k in self.keys:
            keyed = keyed & F.col(f"`{k}`").isNotNull()
        digest = "__digest"
        ordered = updates.where(keyed).withColumn(digest, F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in updates.columns]))
        one = dedupe_latest(ordered, self.keys, [*latest, digest]).drop(digest).unionByName(updates.where(~keyed))
        columns = {f.name: f.dataType for f in (StructType.fromJson(state["schema"]) if state else StructType([])).fields}
        columns.update({f.name: f.dataType for f in updates.schema.fields if f.name not in columns})
        load = state["load"] + 1 if state else 0
        folders = dict(state["folders"]) if state else {}
        if state:
            touched = [r[0] for r in updates.select(self._bucket()).distinct().collect()]  # at most `buckets` numbers
            if not touched:
                return []
            old, new = self._read(state, touched).alias("old"), one.alias("new")
            on = [F.col(f"old.`{k}`") == F.col(f"new.`{k}`") for k in self.keys]
            has = {side: set(df.columns) for side, df in (("new", one), ("old", old))}
            merged = old.join(new, on, "full").select(*[
                F.coalesce(*[F.col(f"{side}.`{c}`").cast(kind) for side in ("new", "old") if c in has[side]]).alias(c) for c, kind in columns.items()])
        else:
            merged = one
        for b in self._write(merged.select("*", self._bucket()), load):
            folders[str(b)] = load
        schema = StructType()
        for c, kind in columns.items():
            schema = schema.add(c, kind)
        self.log.publish({"load": load, "keys": self.keys, "buckets": self.buckets, "schema": schema.jsonValue(), "folders": folders})
        return sorted(int(b) for b, of in folders.items() if of == load)

"""A mart on disk that is kept as partial states per day, so a refresh reads the days it is given and no other.

For every day and key the mart stores what its measures can be put together from: counts, exact sums, least and greatest
values, and, for a distinct count, the distinct values themselves.  A refresh

1. reads the given days of the source (a range filter that reaches the scan),
2. writes their states to folders of its own, all in one load,
3. publishes a manifest that names the load that is current for each day.

Other days' states stay as they are, unread.  Reading merges the states of all days: sums of sums, least of least, and
one row per distinct value and key.  States are small (a row per day and key, or per day, key and value), sums are exact
and merging is order-free, so a mart refreshed day by day equals one made from all rows.

Defined results: rows whose day is NULL belong to a day of their own, ``None``; NULL keys are a key like any other; NULL
values take no part in a measure, as in SQL (a sum of none is NULL, a count 0); a day that has lost its rows loses its
states; an empty source gives an empty mart.  Inside, columns have names of the mart's own, so no user column clashes.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from ..plans.manifest import ManifestLog
from ..session import hadoop_fs

#: Partition column of the files, and the day of rows without one.
DAY, UNDATED = "__day", "undated"
#: How a measure's partial states are merged.
MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def _label(day: dt.date | None) -> str:
    return UNDATED if day is None else day.isoformat()


class DayMart:
    """A mart below ``path``: a row per ``keys`` with named measures.

    ``measures`` gives for each name how it is taken (``count``, ``sum``, ``min``, ``max`` or ``distinct``) and of which
    expression (a column's name or a ``Column``).  ``day`` is a date or timestamp column of the source.
    """

    def __init__(self, spark: SparkSession, path: str, day: str, keys: Sequence[str], measures: Mapping[str, tuple[str, Column | str]]):
        unknown = {how for how, _ in measures.values()} - {*MERGE, "distinct"}
        if unknown:
            raise ValueError(f"no such measures: {sorted(unknown)}")
        if set(keys) & set(measures) or len(set(keys)) < len(keys):
            raise ValueError("keys and measures need names of their own")
        self.spark, self.path, self.day, self.keys = spark, path.rstrip("/"), day, list(keys)
        self.measures = {name: (how, F.col(c) if isinstance(c, str) else c) for name, (how, c) in measures.items()}
        self.log = ManifestLog(spark, self.path)

    def days(self) -> list[dt.date | None]:
        """The days that the mart holds, the undated one last."""
        state = self.log.latest()
        found = sorted(state["days"]) if state else []
        return [dt.date.fromisoformat(d) for d in found if d != UNDATED] + [None] * (UNDATED in found)

    def _of(self, source: DataFrame, days: Sequence[dt.date | None]) -> DataFrame:
        c = F.col(self.day)
        parts = [c.isNull() if d is None else (c >= F.lit(d)) & (c < F.lit(d + dt.timedelta(days=1))) for d in days]
        return source.where(reduce(lambda a, b: a | b, parts))

    def _states(self, rows: DataFrame) -> dict[str, DataFrame]:
        """The tables of partial states: ``parts`` and one ``set<i>`` per distinct measure."""
        day = F.coalesce(F.date_format(self.day, "yyyy-MM-dd"), F.lit(UNDATED)).alias(DAY)
        keys = [F.col(k).alias(f"k{i}") for i, k in enumerate(self.keys)]
        base = rows.select(day, *keys, *[c.alias(f"m{i}") for i, (_, c) in enumerate(self.measures.values())])
        by, take, out = [DAY, *(f"k{i}" for i in range(len(keys)))], [], {}
        for i, (name, (how, _)) in enumerate(self.measures.items()):
            m = F.col(f"m{i}")
            if how == "sum" and isinstance(base.schema[f"m{i}"].dataType, (FloatType, DoubleType)):
                raise ValueError(f"{name}: a sum of floating-point numbers depends on its order; cast to a decimal")
            if how == "distinct":
                out[f"set{i}"] = base.where(m.isNotNull()).select(*by, f"m{i}").distinct()
            else:
                take.append({"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}[how](m).alias(f"m{i}"))
        out["parts"] = base.groupBy(*by).agg(*take) if take else base.select(*by).distinct()
        return out

    def refresh(self, source: DataFrame, days: Sequence[dt.date | None] | None = None) -> list[str]:
        """Replace the states of ``days`` (all days, if none are named) by those of ``source``; the days written."""
        if days is not None and not days:
            return []
        state = self.log.latest()
        rows = source if days is None else self._of(source, days)
        tables = self._states(rows)
        schemas = {t: df.drop(DAY).schema.jsonValue() for t, df in tables.items()}
        if state is not None and (state["keys"] != self.keys or state["measures"] != [[n, how] for n, (how, _) in self.measures.items()]):
            raise ValueError(f"the mart at {self.path} has keys {state['keys']} and measures {state['measures']}")
        if state is not None and days is not None and state["schemas"] != schemas:
            raise ValueError(f"the types of the mart at {self.path} have changed; refresh all days")
        # a folder of this load alone: a rival that takes the same number can't write into it
        load = f"{state['load'] + 1 if state else 0}-{uuid.uuid4().hex[:8]}"
        for t, df in tables.items():
            df.hint("rebalance", DAY).write.partitionBy(DAY).parquet(f"{self.path}/data/load={load}/{t}")
        fs, folder = hadoop_fs(self.spark, f"{self.path}/data/load={load}/parts")
        written = sorted(n.split("=", 1)[1] for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n.startswith(f"{DAY}="))
        gone = set(state["days"]) if state and days is None else {_label(d) for d in days or ()}
        current = {d: of for d, of in (state["days"] if state else {}).items() if d not in gone}
        current.update({d: load for d in written})
        self.log.publish({"load": state["load"] + 1 if state else 0, "keys": self.keys, "measures": [[n, how] for n, (how, _) in self.measures.items()],
                          "schemas": schemas, "days": current})
        return written

    def _stored(self, state: dict, table: str) -> DataFrame:
        """The current states of a table, only from the folders that hold days of it."""
        schema = StructType.fromJson(state["schemas"][table])
        of: dict[str, list[str]] = {}
        for day, load in state["days"].items():
            of.setdefault(load, []).append(day)
        frames = []
        for load, days in of.items():
            rows = self.spark.read.schema(StructType(schema.fields).add(DAY, "string")).parquet(f"{self.path}/data/load={load}/{table}")
            frames.append(rows.where(F.col(DAY).isin(days)).drop(DAY))
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The mart over all its days."""
        state = self.log.latest()
        if state is None:
            raise ValueError(f"no mart at {self.path}")
        by, names = [f"k{i}" for i in range(len(self.keys))], list(self.measures)
        merged = self._stored(state, "parts")
        for i, name in enumerate(names):
            if self.measures[name][0] == "distinct":
                # counted by key before it meets the other measures: a row per key and distinct value is shuffled, once
                each = self._stored(state, f"set{i}").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias(f"m{i}"))
                merged = merged.unionByName(each, allowMissingColumns=True)
        take = []
        for i, name in enumerate(names):
            how = self.measures[name][0]
            whole = MERGE.get(how, F.sum)(f"m{i}")
            take.append((F.coalesce(whole, F.lit(0)).cast("long") if how in ("count", "distinct") else whole).alias(name))
        keys = [F.col(f"k{i}").alias(k) for i, k in enumerate(self.keys)]
        if not by:
            return merged.agg(*take)
        return merged.groupBy(*by).agg(*take).select(*keys, *names)

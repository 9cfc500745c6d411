"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import hadoop_fs, shared_root

#: Rows per Arrow batch.  Texts average a few kilobytes; Spark also closes a batch at
#: ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB), so long texts stay bounded too.
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the operators: bounded Arrow batches, shuffle files of a finished step are removed."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text of an Arrow column; null is the empty text."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def text_values(column: pa.Array) -> list[str]:
    """Each text of an Arrow column; null is the empty text."""
    return ["" if v is None else v for v in column.to_pylist()]


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string (on the driver: parsing needs the session)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def give_back() -> None:
    """Memory that a task has freed, to the system.

    Spark reuses Python workers for later stages, and the allocators keep what was freed: beside the JVM of an executor
    the workers of all its cores would stay as large as their largest task.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], done: Callable[[], object] | None = None):
    """``run`` for ``mapInArrow``, followed by ``done`` and ``give_back`` at the end of each task."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        if done:
            done()
        give_back()

    return whole


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], dict[str, object]], schema: str, done: Callable[[], object] | None = None) -> DataFrame:
    """``mapInArrow`` with ``work(batch) -> {column: values}``; values may be lists or Arrow/numpy arrays.  ``done`` is
    called at the end of each task."""
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in target], schema=target)

    return df.mapInArrow(giving_back(run, done), schema)


def text_key(text: Column) -> tuple[Column, Column]:
    """A 128-bit key of a text as two longs, so that rows are told apart by what they say, not by their ids."""
    return F.xxhash64(text), F.xxhash64(F.lit(20011), text)


class Scratch:
    """Tables written below the folder of ``spark.checkpoint.dir`` to cut lineage between steps.

    A lost executor costs nothing that was written here.  ``drop`` removes a table once a later one replaces it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/lakeforge-llm/{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            fs, path = hadoop_fs(self.spark, f"{self.root}/{name}")
            fs.delete(path, True)

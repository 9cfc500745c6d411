"""Incremental landing (L3) with Structured Streaming.

New files in a landing folder are picked up by the file stream source, stamped
with load metadata, and appended to the bronze table.  The checkpoint records
which files were taken, so a re-run only lands files that arrived since: run it
with ``trigger(availableNow=True)`` from a scheduler and each run is a bounded,
exactly-once batch job; run it without ``once`` for a continuous stream.

The checkpoint and target must sit on shared storage (for example under
``spark.checkpoint.dir``) so a restarted driver or lost executor resumes from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.bronze import LOAD_DAY, LOAD_TS, RUN_ID, SOURCE_FILE

#: Files of one micro-batch.
MAX_FILES_PER_TRIGGER = 10_000


def stream_with_metadata(spark: SparkSession, source_dir: str, schema: StructType, run_id: str,
                         fmt: str = "parquet", max_files_per_trigger: int = MAX_FILES_PER_TRIGGER) -> DataFrame:
    """A streaming DataFrame of the landing folder plus load metadata columns."""
    df = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).load(source_dir)
    ts = F.current_timestamp().cast("timestamp_ntz")
    return df.select(
        "*",
        ts.alias(LOAD_TS),
        F.lit(run_id).alias(RUN_ID),
        F.regexp_extract(F.col("_metadata.file_path"), r"[^/]*$", 0).alias(SOURCE_FILE),
        F.date_format(ts, "yyyy-MM-dd").alias(LOAD_DAY),
    )


def land_incremental(spark: SparkSession, source_dir: str, schema: StructType, target_path: str,
                     checkpoint: str, run_id: str, fmt: str = "parquet", partition_by=(LOAD_DAY,),
                     once: bool = True, max_files_per_trigger: int = MAX_FILES_PER_TRIGGER):
    """L3: land the files that arrived since the last run (``once``: wait for the
    bounded run to finish and return the finished query; else return the running
    query).  A backlog is taken in micro-batches of ``max_files_per_trigger`` files,
    each committed before the next."""
    stream = stream_with_metadata(spark, source_dir, schema, run_id, fmt, max_files_per_trigger)
    writer = (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
              .outputMode("append"))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if once:
        writer = writer.trigger(availableNow=True)
    query = writer.start(target_path)
    if once:
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
    return query

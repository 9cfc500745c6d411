"""Bronze layer: land source data as-is, with load metadata, as an append-only
archive that can be audited and replayed.

Landing is a map-only job (scan -> add literal columns -> write); the archive is
partitioned by load day and run, so a replay of some days or runs reads only those folders.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOAD_TS = "_load_ts"
RUN_ID = "_run_id"
SOURCE_FILE = "_source_file"
LOAD_DAY = "_load_day"


def _ts_col(run_ts) -> Column:
    """Load time as ``timestamp_ntz`` wall-clock in the session time zone (UTC)."""
    if run_ts is None:
        return F.current_timestamp().cast("timestamp_ntz")
    if isinstance(run_ts, Column):
        return run_ts
    return F.lit(str(run_ts)).cast("timestamp_ntz")


def with_load_metadata(df: DataFrame, run_id: str, run_ts=None, source_file: bool = True,
                       file_name_only: bool = True) -> DataFrame:
    """L2: add load time, process (run) id, source file and load day.

    ``source_file`` needs a file-based source (``_metadata.file_path``); with
    ``file_name_only`` the folder is dropped so the value does not depend on
    where the files were mounted.
    """
    ts = _ts_col(run_ts)
    cols = [F.col("*"), ts.alias(LOAD_TS), F.lit(run_id).alias(RUN_ID)]
    if source_file:
        path = F.col("_metadata.file_path")
        cols.append((F.regexp_extract(path, r"[^/]*$", 0) if file_name_only else path).alias(SOURCE_FILE))
    cols.append(F.date_format(ts, "yyyy-MM-dd").alias(LOAD_DAY))
    return df.select(*cols)


def land(df: DataFrame, path: str, mode: str = "append", partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """L1: write the source rows unchanged (no column is altered)."""
    writer = df.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def archive(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """L4: write a run to the history archive, partitioned by load day and run.

    Only the (load day, run) folders present in ``df`` are replaced: other runs of
    the same day stay, and a run that is retried is there once.
    """
    (df.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(LOAD_DAY, RUN_ID).save(path))


def load_audit(landed: DataFrame, event_ts: str | None = None, by: Sequence[Column] = ()) -> DataFrame:
    """Rows per run, source file and load day (and ``by``), with load time and
    the event-time range.

    One hash aggregate with map-side partial counts; output is one row per
    group, tiny next to the data.
    """
    aggs = [F.count(F.lit(1)).alias("row_count"), F.min(LOAD_TS).alias("loaded_at")]
    if event_ts:
        aggs += [F.min(event_ts).alias("min_event_ts"), F.max(event_ts).alias("max_event_ts")]
    return landed.groupBy(RUN_ID, SOURCE_FILE, LOAD_DAY, *by).agg(*aggs)


def replay(spark: SparkSession, path: str, days: Iterable[str] | None = None,
           run_ids: Iterable[str] | None = None, fmt: str = "parquet") -> DataFrame:
    """Re-read archived rows for some load days and/or runs, without going back
    to the source.  Both filters prune partitions (other folders are never opened)."""
    df = spark.read.format(fmt).load(path)
    if days is not None:
        df = df.where(F.col(LOAD_DAY).isin([str(d) for d in days]))
    if run_ids is not None:
        df = df.where(F.col(RUN_ID).isin(list(run_ids)))
    return df

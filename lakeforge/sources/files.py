"""File listing and file reads with load metadata.

``list_files`` (S8) is a table of ``path, length, modificationTime`` of every file
below a folder, hidden and empty ones included (Spark's own file sources skip
those).  Folders are listed by tasks, one level of the tree at a time: what a level
holds is written to the shared folder, its sub-folders are the next level.  The
driver sees neither files nor folders; it counts the folders of a level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import hadoop_fs, work_path

#: Rows of an Arrow batch of the listing.
BATCH = 10_000


def _opened(folder: str):
    """The Arrow file system of a qualified folder and the folder's path in it."""
    from pyarrow import fs

    uri = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    return fs.FileSystem.from_uri(uri.replace("%", "%25").replace(" ", "%20").replace("#", "%23").replace("?", "%3F"))


def _list_level(batches):
    """Arrow batches of folders to batches of what lies in them: files, and folders with a NULL length."""
    import pyarrow as pa
    from pyarrow import fs

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                                           pa.array([r[2] for r in rows], pa.timestamp("us", "UTC"))], names=["path", "length", "modificationTime"])

    for batch in batches:
        for folder in batch.column("path").to_pylist():
            system, at = _opened(folder)
            rows = []
            for info in system.get_file_info(fs.FileSelector(at)):
                rows.append((f"{folder.rstrip('/')}/{info.base_name}", info.size if info.type == fs.FileType.File else None,
                             info.mtime if info.type == fs.FileType.File else None))
                if len(rows) == BATCH:
                    yield emit(rows)
                    rows = []
            if rows:
                yield emit(rows)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file (not folder) below ``root``, in no particular order.

    The store must be one that Arrow's file systems read (local, HDFS, S3, GCS); one folder is listed by one task.
    """
    fs, path = hadoop_fs(spark, root)
    if not fs.exists(path):
        raise FileNotFoundError(root)
    schema = "path string, length long, modificationTime timestamp"
    level, out, depth = spark.createDataFrame([(fs.makeQualified(path).toString(),)], "path string"), work_path(spark, "listing"), 0
    while True:
        level.select("path").mapInArrow(_list_level, schema).write.parquet(f"{out}/level={depth}")
        found = spark.read.schema(schema).parquet(f"{out}/level={depth}")
        folders = found.where("length IS NULL")
        n = folders.count()
        if not n:
            break
        # a folder per task while there are few: listing waits for the store, not for the processor
        level, depth = folders.select("path").repartition(min(n, 4 * spark.sparkContext.defaultParallelism)), depth + 1
    return spark.read.schema(schema).parquet(*[f"{out}/level={k}" for k in range(depth + 1)]).where("length IS NOT NULL")


def read_with_source(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """Read files and keep each row's source file path as ``_source_path``."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return df.select("*", F.col("_metadata.file_path").alias("_source_path"))

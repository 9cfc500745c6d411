"""Session settings and the shared working folder.

Every operator takes the ``SparkSession`` as an argument; nothing here builds a
session at import time.  ``configure`` applies the SQL settings the library
relies on, ``local_session`` is the builder used by tests and ``bench.py``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library depends on (runtime SQL confs, safe to set on a live session).
#  - partition values such as P_Month=04 stay strings (type inference would turn them to 4)
#  - an overwrite replaces only the partitions present in the written data
#  - base64 output is one unbroken line (the legacy cipher output has no line breaks)
#  - one time zone for every date/time expression
REQUIRED_SQL_CONF = {
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.chunkBase64String.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
}

# Planner settings that matter at scale: runtime re-planning, skew splitting,
# small-partition coalescing.  They are Spark defaults in 4.x; set explicitly so a
# cluster profile that turned them off is visible in the plan.
SCALE_SQL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the library's SQL settings to ``spark`` and return it."""
    for key, value in {**REQUIRED_SQL_CONF, **SCALE_SQL_CONF}.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "lakeforge") -> SparkSession:
    """A local session for tests and benchmarks (UI off, Arrow on)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LAKEFORGE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**REQUIRED_SQL_CONF, **SCALE_SQL_CONF}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    On a cluster this is a distributed file system path visible to every
    executor, and it must be set: rows written to a folder of one machine would be
    missing on the others.  Only a local session (tests) without one gets a
    temporary folder, registered so that ``DataFrame.checkpoint()`` agrees.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        current = sc.getCheckpointDir()
        if current:
            base = current.rsplit("/", 1)[0]
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lakeforge-ckpt-")
        sc.setCheckpointDir(base)
        sc._conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str, unique: bool = True) -> str:
    """A path below the shared folder; ``unique`` appends a fresh id so runs never collide."""
    suffix = f"-{uuid.uuid4().hex[:12]}" if unique else ""
    return f"{shared_root(spark)}/lakeforge/{name}{suffix}"


def hadoop_fs(spark: SparkSession, path: str):
    """(FileSystem, Path) for ``path`` through the session's Hadoop configuration."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def measured(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back.

    For the derived side of a join: the planner then knows its size before any row
    of the other side is moved, and a retry need not compute it again.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> str:
    """Make this package importable by Python workers on every executor.

    Cluster images usually install it, or it is passed with ``--py-files``; for an
    ad-hoc session this zips the package into the shared folder and adds it with
    ``SparkContext.addPyFile`` (Arrow UDFs such as the cipher import it on the
    executors).  Returns the zip path.
    """
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    base = work_path(spark, "pyfiles")
    fs, path = hadoop_fs(spark, base)
    fs.mkdirs(path)
    local_zip = os.path.join(tempfile.mkdtemp(prefix="lakeforge-zip-"), "lakeforge.zip")
    with zipfile.ZipFile(local_zip, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("lakeforge", os.path.relpath(full, pkg_dir)))
    jvm = spark.sparkContext._jvm
    target = f"{base}/lakeforge.zip"
    fs.copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(local_zip), jvm.org.apache.hadoop.fs.Path(target))
    spark.sparkContext.addPyFile(target)
    return target

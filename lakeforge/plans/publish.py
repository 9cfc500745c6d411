"""Publish the tables of an application database.

For every table of an application database this builds the published objects
and *executes* them on Spark (the legacy tool only printed statement text):

* external mode: a table over the application table's files (``LOCATION``),
  its partitions discovered (``MSCK REPAIR``), and an active-rows view; columns
  with reserved names, or typed columns read out of a semi-structured one, are
  published through a view over that table;
* internal mode: a table created if absent, one day's partition loaded into it
  (partition-pruned read, the day is replaced, so a re-run never duplicates it)
  or, without day columns, the whole table replaced, and an active-rows view.

Only catalog-sized metadata (table and column lists) is handled on the driver;
the data moves in Spark jobs.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import date_parts, day_parts_python
from ..operators.silver import ACTIVE_FLAG
from ..session import hadoop_fs
from ..sources.tables import create_database, drop_table_and_data, quote_ident, quote_text, table_location
from .catalog import DAY_PARTITION_COLUMNS, RESERVED_RENAMES, list_tables, rename_reserved

VIEW_SUFFIX = "_v"
FILES_SUFFIX = "_files"  # the table over the files where the published object is a view


# --------------------------------------------------------------------------- day-partitioned layout

def with_day_partitions(df: DataFrame, ts_col: str) -> DataFrame:
    """Add ``P_Year, P_Month, P_Day`` (zero-padded text) from a date/time column."""
    p = date_parts(ts_col)
    return df.withColumns({"P_Year": p["year"], "P_Month": p["month"], "P_Day": p["day"]})


def write_day_partitioned(df: DataFrame, path: str, rows_per_file: int = 1_000_000, mode: str = "overwrite",
                          rebalance: bool = True) -> None:
    """Write under ``P_Year=/P_Month=/P_Day=`` folders.

    ``rebalance=True`` (rows of a day spread over all tasks, e.g. after a join):
    the ``rebalance`` hint lets AQE shuffle rows towards their day so each day
    gets few files, while splitting a hot day over several tasks (no single task
    holds a day that carries a third of the data).

    ``rebalance=False`` (input already clustered by day, e.g. landed per day):
    no shuffle; each task sorts its rows by day and writes one file per day it
    holds.

    ``maxRecordsPerFile`` caps file size; dynamic overwrite replaces only the
    days present.
    """
    out = (df.hint("rebalance", *DAY_PARTITION_COLUMNS) if rebalance
           else df.sortWithinPartitions(*DAY_PARTITION_COLUMNS))
    (out.write.format("parquet").mode(mode)
        .option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*DAY_PARTITION_COLUMNS).save(path))


def day_filter(day):
    """Partition filter on the three day columns, compared as text (prunes folders).
    ``day`` is a date or a list of dates (a backfill)."""
    days = [day] if isinstance(day, dt.date) else list(day)
    conds = []
    for one in days:
        y, m, d = day_parts_python(one)
        conds.append((F.col("P_Year") == y) & (F.col("P_Month") == m) & (F.col("P_Day") == d))
    return reduce(lambda a, b: a | b, conds)


# --------------------------------------------------------------------------- DDL pieces

def _ddl_columns(spark: SparkSession, name: str, excluded: Sequence[str] = (), rename: bool = False) -> tuple[list[str], list[str]]:
    """(column definitions, partition column names) of a catalog table."""
    cols, parts = [], []
    for c in spark.catalog.listColumns(name):
        if c.isPartition:
            parts.append(c.name)
            continue
        if c.name in excluded:
            continue
        cname = RESERVED_RENAMES.get(c.name, c.name) if rename and c.dataType == "string" else c.name
        cols.append(f"{quote_ident(cname)} {c.dataType}")
    return cols, parts


# --------------------------------------------------------------------------- S11-S17

def create_external_table(spark: SparkSession, name: str, location: str, columns: Sequence[str] | None,
                          partition_cols: Sequence[str] = DAY_PARTITION_COLUMNS, provider: str = "parquet") -> None:
    """Replace ``name`` by a table over ``location``.

    Partition columns are declared as strings.  For file tables the partitions
    are discovered right away (the "refresh on create" of parquet); a provider
    with its own log (such as delta, when its jar is present) needs no repair.
    """
    spark.sql(f"DROP TABLE IF EXISTS {quote_ident(name)}")
    defs = list(columns or [])
    if defs:
        defs += [f"{quote_ident(p)} string" for p in partition_cols]
    cols = f" ({', '.join(defs)})" if defs else ""
    # without a column list Spark infers columns and partitioning from the folder layout
    part = f" PARTITIONED BY ({', '.join(quote_ident(p) for p in partition_cols)})" if partition_cols and defs else ""
    spark.sql(f"CREATE TABLE {quote_ident(name)}{cols} USING {provider}{part} LOCATION {quote_text(location)}")
    if partition_cols and provider in ("parquet", "orc", "csv", "json"):
        refresh_external_table(spark, name)


def refresh_external_table(spark: SparkSession, name: str) -> None:
    """Pick up new partition folders and new files of an external table."""
    spark.sql(f"MSCK REPAIR TABLE {quote_ident(name)}")
    spark.sql(f"REFRESH TABLE {quote_ident(name)}")


def _folder_specs(spark: SparkSession, location: str, columns: Sequence[str]) -> set[str]:
    """The partition folders below ``location`` (``a=1/b=2``), listed level by level; a missing location has none."""
    level = [""]
    for column in columns:
        below = []
        for parent in level:
            fs, path = hadoop_fs(spark, f"{location}/{parent}")
            if not fs.exists(path):
                continue
            names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
            below += [f"{parent}/{n}".lstrip("/") for n in names if n.startswith(f"{column}=")]
        level = below
    return set(level)


def _spec_clause(folder: str) -> str:
    """``PARTITION (...)`` of a partition folder, whose values are escaped as Spark writes them."""
    pairs = [part.split("=", 1) for part in folder.split("/")]
    value = lambda v: "NULL" if v == "__HIVE_DEFAULT_PARTITION__" else quote_text(unquote(v))
    return f"PARTITION ({', '.join(f'{quote_ident(c)} = {value(v)}' for c, v in pairs)})"


#: Partitions named in one statement of a refresh.
SPECS_PER_STATEMENT = 200


def refresh_changed_partitions(spark: SparkSession, name: str) -> tuple[list[str], list[str]]:
    """Bring an external table's partitions in line with its folders; (folders added, folders dropped).

    What the catalog knows is held against the folders that are there, and only the difference is added or dropped.  Files
    are not listed: only folders are, a call for each but the last level (with day columns, one a month).  New files in a
    known folder are seen by the next read.  A table without partitions is only read afresh.
    """
    table = spark.catalog.getTable(name)
    if table.tableType != "EXTERNAL":
        raise ValueError(f"{name} is not external: its folders are its own")
    columns = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    added: list[str] = []
    dropped: list[str] = []
    if columns:
        known = {r.partition for r in spark.sql(f"SHOW PARTITIONS {quote_ident(name)}").toLocalIterator()}
        there = _folder_specs(spark, table_location(spark, name), columns)
        added, dropped = sorted(there - known), sorted(known - there)
        for folders, verb, sep in ((added, "ADD IF NOT EXISTS", " "), (dropped, "DROP IF EXISTS", ", ")):
            for k in range(0, len(folders), SPECS_PER_STATEMENT):
                spark.sql(f"ALTER TABLE {quote_ident(name)} {verb} {sep.join(_spec_clause(f) for f in folders[k:k + SPECS_PER_STATEMENT])}")
    spark.sql(f"REFRESH TABLE {quote_ident(name)}")
    return added, dropped


def create_internal_table(spark: SparkSession, name: str, columns: Sequence[str],
                          partition_cols: Sequence[str] = DAY_PARTITION_COLUMNS) -> None:
    """Create the published table if it does not exist (day columns as text)."""
    defs = list(columns) + [f"{quote_ident(p)} string" for p in partition_cols]
    part = f" PARTITIONED BY ({', '.join(quote_ident(p) for p in partition_cols)})" if partition_cols else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {quote_ident(name)} ({', '.join(defs)}) USING parquet{part}")


def load_day(spark: SparkSession, source: DataFrame, target: str, day,
             excluded: Sequence[str] = ()) -> None:
    """Replace one day of ``target`` by that day of ``source``.

    The day filter is on the partition columns, so only that day's folders are
    read.  A date is written as a static ``INSERT OVERWRITE`` of its partition: a
    day loaded twice is there once, a day whose source is now empty becomes
    empty.  ``day`` may be a list of dates: one pruned job stages all of them, then
    the catalog is switched (``_switch_days``), so a load that fails changes nothing.
    """
    days = [day] if isinstance(day, dt.date) else list(day)
    src = rename_reserved(source.where(day_filter(days)).drop(*[c for c in excluded if c not in DAY_PARTITION_COLUMNS]))
    rows = src.select(*spark.table(target).columns)
    spec = lambda parts: ", ".join(f"{quote_ident(c)} = {quote_text(v)}" for c, v in zip(DAY_PARTITION_COLUMNS, parts))
    if len(days) == 1:
        view = f"load_{uuid.uuid4().hex}"
        rows.drop(*DAY_PARTITION_COLUMNS).createTempView(view)
        try:
            spark.sql(f"INSERT OVERWRITE TABLE {quote_ident(target)} PARTITION ({spec(day_parts_python(days[0]))}) SELECT * FROM {view}")
        finally:
            spark.catalog.dropTempView(view)
        return
    _switch_days(spark, rows, target, [spec(day_parts_python(d)) for d in days], ["/".join(f"{c}={v}" for c, v in zip(DAY_PARTITION_COLUMNS, day_parts_python(d))) for d in days])


def _partition_location(spark: SparkSession, target: str, spec: str) -> str | None:
    """Where a partition's files lie; None if the table has no such partition."""
    if spark.sql(f"SHOW PARTITIONS {quote_ident(target)} PARTITION ({spec})").isEmpty():
        return None
    found = spark.sql(f"DESCRIBE TABLE EXTENDED {quote_ident(target)} PARTITION ({spec})").where("col_name = 'Location'").first()
    return found.data_type


def _switch_days(spark: SparkSession, rows: DataFrame, target: str, specs: Sequence[str], folders: Sequence[str]) -> None:
    """Replace the named days by ``rows``: staged first, then switched.

    One job reads the source and writes every day to a folder of this load; a failure there leaves the table as it was.
    Then the catalog is pointed to the new folders, an empty one for a day without rows; if that fails on the way, the days
    already switched are pointed back.  The old folders go last.
    """
    staged = f"{table_location(spark, target)}/.loads/{uuid.uuid4().hex}"
    rows.hint("rebalance", *DAY_PARTITION_COLUMNS).write.partitionBy(*DAY_PARTITION_COLUMNS).parquet(staged)
    before = {spec: _partition_location(spark, target, spec) for spec in specs}
    switched: list[str] = []
    try:
        for spec, folder in zip(specs, folders):
            fs, path = hadoop_fs(spark, f"{staged}/{folder}")
            fs.mkdirs(path)
            switched.append(spec)
            how = f"ADD PARTITION ({spec}) LOCATION" if before[spec] is None else f"PARTITION ({spec}) SET LOCATION"
            spark.sql(f"ALTER TABLE {quote_ident(target)} {how} {quote_text(f'{staged}/{folder}')}")
    except Exception:
        for spec in switched:
            back = f"DROP IF EXISTS PARTITION ({spec})" if before[spec] is None else f"PARTITION ({spec}) SET LOCATION {quote_text(before[spec])}"
            spark.sql(f"ALTER TABLE {quote_ident(target)} {back}")
        raise
    spark.sql(f"REFRESH TABLE {quote_ident(target)}")
    for old in before.values():
        if old is not None:
            fs, path = hadoop_fs(spark, old)
            fs.delete(path, True)


def load_whole(spark: SparkSession, source: DataFrame, target: str, excluded: Sequence[str] = ()) -> None:
    """S15 for a table without day columns: replace all its rows by those of ``source``."""
    src = rename_reserved(source.drop(*excluded))
    src.select(*spark.table(target).columns).write.option("partitionOverwriteMode", "static").insertInto(target, overwrite=True)


def create_renaming_view(spark: SparkSession, view: str, table: str, columns: Sequence[tuple[str, str]] | None = None,
                         value_col: str | None = None) -> None:
    """Publish ``table`` as a view with reserved names renamed, and, given
    ``columns`` (name, type), with these read out of the JSON text in ``value_col``."""
    out = []
    for f in spark.table(table).schema.fields:
        if f.name == value_col:
            out += [f"try_variant_get(try_parse_json({quote_ident(value_col)}), {quote_text('$.' + name)}, {quote_text(kind)}) AS {quote_ident(name)}"
                    for name, kind in columns or ()]
            continue
        new = RESERVED_RENAMES.get(f.name) if f.dataType.simpleString() == "string" else None
        out.append(f"{quote_ident(f.name)} AS {quote_ident(new)}" if new else quote_ident(f.name))
    spark.sql(f"CREATE OR REPLACE VIEW {quote_ident(view)} AS SELECT {', '.join(out)} FROM {quote_ident(table)}")


def create_active_view(spark: SparkSession, name: str, flag: str = ACTIVE_FLAG) -> str:
    """``<name>_v`` = the rows of ``name`` with the active flag set."""
    view = f"{name}{VIEW_SUFFIX}"
    spark.sql(f"CREATE OR REPLACE VIEW {quote_ident(view)} AS SELECT * FROM {quote_ident(name)} WHERE {quote_ident(flag)} = true")
    return view


def remove_objects(spark: SparkSession, name: str, delete_data: bool = False) -> None:
    """S17 (+S9): drop the published views, then the table.

    ``delete_data`` also deletes the table's files.  An external table's files
    belong to whoever wrote them, so for one that is refused.
    """
    spark.sql(f"DROP VIEW IF EXISTS {quote_ident(name + VIEW_SUFFIX)}")
    for table in (name, name + FILES_SUFFIX):
        if not spark.catalog.tableExists(table):
            continue
        kind = spark.catalog.getTable(table).tableType
        if kind == "VIEW":
            spark.sql(f"DROP VIEW {quote_ident(table)}")
        elif delete_data and kind != "MANAGED":
            raise ValueError(f"{table} is external: its files are not deleted")
        elif delete_data:
            drop_table_and_data(spark, table)
        else:
            spark.sql(f"DROP TABLE IF EXISTS {quote_ident(table)}")


# --------------------------------------------------------------------------- S18

def published_table_name(target_db: str, app: str, table: str) -> str:
    return f"{target_db}.{app}_{table}".lower()


def _publish_table(spark: SparkSession, app_db: str, t: str, target_db: str, mode: str, app: str,
                   day, excluded: Sequence[str], provider: str, flag: str,
                   on_read: Mapping[str, tuple[str, Sequence[tuple[str, str]]]]) -> list[tuple[str, str, str]]:
    src_name = f"{app_db}.{t}"
    if spark.catalog.getTable(src_name).tableType == "VIEW":
        return [(t, "skip_view", src_name)]
    steps = []
    source = spark.table(src_name)
    name = published_table_name(target_db, app, t)
    if mode == "external":
        cols, parts = _ddl_columns(spark, src_name, excluded)
        reserved = any(f.name in RESERVED_RENAMES and f.dataType.simpleString() == "string" for f in source.schema.fields)
        files = name + FILES_SUFFIX if reserved or t in on_read else name
        create_external_table(spark, files, table_location(spark, src_name), cols, parts, provider)
        steps.append((t, "create_external_table", files))
        if files != name:
            value_col, columns = on_read.get(t, (None, None))
            create_renaming_view(spark, name, files, columns, value_col)
            steps.append((t, "create_view", name))
    else:
        cols, parts = _ddl_columns(spark, src_name, excluded, rename=True)
        create_internal_table(spark, name, cols, parts)
        steps.append((t, "create_internal_table", name))
        if all(p in parts for p in DAY_PARTITION_COLUMNS):
            load_day(spark, source, name, day, excluded)
            days = [day] if isinstance(day, dt.date) else day
            steps.append((t, "load_day", f"{name}@{','.join(d.isoformat() for d in days)}"))
        else:
            load_whole(spark, source, name, excluded)
            steps.append((t, "load_whole", name))
    if flag in source.columns:
        steps.append((t, "create_view", create_active_view(spark, name, flag)))
    return steps


def publish(spark: SparkSession, app_db: str, target_db: str, mode: str = "internal", app: str | None = None,
            day: dt.date | None = None, days_back: int = -1, excluded: Sequence[str] = (),
            provider: str = "parquet", target_location: str | None = None, flag: str = ACTIVE_FLAG,
            max_parallel_tables: int = 4, tables: Sequence[str] | None = None,
            on_read: Mapping[str, tuple[str, Sequence[tuple[str, str]]]] | None = None) -> DataFrame:
    """Publish every table of ``app_db`` (or ``tables``) into ``target_db``;
    returns a report with one row per step (table, step, object).  A view of the
    application is not published and has a ``skip_view`` row.

    ``mode="external"`` points tables at the application files; ``"internal"``
    copies one day (``day``, default today + ``days_back``) of the day-partitioned
    tables, and the others whole, into managed tables.  ``on_read`` names, for
    external tables that hold JSON text, its column and the typed columns to read.

    Tables are published concurrently (``max_parallel_tables`` driver threads,
    each submitting its own Spark jobs), so an application with many small
    tables keeps the cluster busy; within a table the steps keep their order
    (table before view).
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    app = app or app_db
    create_database(spark, target_db, target_location)
    if day is None:
        day = dt.date.today() + dt.timedelta(days=days_back)
    tables = list_tables(spark, app_db) if tables is None else tables
    one = inheritable_thread_target(spark)(lambda t: _publish_table(spark, app_db, t, target_db, mode, app, day, excluded, provider, flag, on_read or {}))
    with ThreadPoolExecutor(max_workers=max(1, max_parallel_tables)) as pool:
        results = list(pool.map(one, tables))
    steps = [s for r in results for s in r]
    return spark.createDataFrame(steps, "table string, step string, object string")

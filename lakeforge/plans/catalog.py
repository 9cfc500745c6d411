"""Catalog metadata as DataFrames.

The catalog walk is the only driver-side step and is catalog-sized (one row per
column of each table).  Everything after it (filters, clause text, ordered
gathering per table, relative paths) is DataFrame expressions.  No pandas, no
Python UDF, and partition columns are recognised by their flag, never by
position.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from ..sources.tables import quote_ident, table_location

# Legacy layout names
DAY_PARTITION_COLUMNS = ("P_Year", "P_Month", "P_Day")
DEFAULT_EXCLUDED = ("",)
RESERVED_RENAMES = {"value": "raw_value"}  # reserved column name -> published name (string columns)

METADATA_SCHEMA = StructType([
    StructField("database", StringType(), False),
    StructField("table", StringType(), False),
    StructField("location", StringType(), True),
    StructField("ordinal", IntegerType(), False),
    StructField("col_name", StringType(), False),
    StructField("data_type", StringType(), False),
    StructField("is_partition", BooleanType(), False),
])


def list_tables(spark: SparkSession, database: str) -> list[str]:
    """M1: names of the persistent tables and views of a database (temp views skipped)."""
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)


def column_metadata(spark: SparkSession, database: str, tables: Iterable[str] | None = None) -> DataFrame:
    """M2, M3, M8: one row per column of every table of ``database``:
    database, table, location, ordinal, col_name, data_type, is_partition."""
    rows = []
    for t in (tables if tables is not None else list_tables(spark, database)):
        name = f"{database}.{t}"
        loc = table_location(spark, name)
        for i, c in enumerate(spark.catalog.listColumns(name)):
            rows.append((database, t, loc, i, c.name, c.dataType, bool(c.isPartition)))
    return spark.createDataFrame(rows, METADATA_SCHEMA)


def exclude_columns(meta: DataFrame, excluded: Sequence[str] = DEFAULT_EXCLUDED) -> DataFrame:
    """M4: drop metadata rows whose column name is in ``excluded``."""
    return meta.where(~F.col("col_name").isin(list(excluded)))


def published_name(warehouse_db: str, warehouse_schema: str, app: str) -> Column:
    """M5: ``DB.SCHEMA.APP_TABLE`` in upper case."""
    return F.upper(F.concat_ws(".", F.lit(warehouse_db), F.lit(warehouse_schema),
                               F.concat(F.lit(f"{app}_"), F.col("table"))))


def _published_col() -> Column:
    renamed = F.col("col_name")
    for old, new in RESERVED_RENAMES.items():
        renamed = F.when((F.col("col_name") == old) & (F.col("data_type") == "string"), F.lit(new)).otherwise(renamed)
    return renamed


def column_clause() -> Column:
    """M6 (+M11): ``"name type"``; a string column named ``value`` is published as ``raw_value``."""
    return F.concat_ws(" ", _published_col(), F.col("data_type"))


def column_clause_on_read() -> Column:
    """M7 text form: ``"name type as (Value:name::type)"`` for semi-structured external tables."""
    return F.format_string("%s %s as (Value:%s::%s)", _published_col(), F.col("data_type"),
                           F.col("col_name"), F.col("data_type"))


def gather_columns(meta: DataFrame, clause: Column | None = None, keys: Sequence[str] = ("database", "table", "location")) -> DataFrame:
    """M9: per table, the list of column clauses in column order (``column_ddl``)
    and the parenthesised DDL text (no trailing comma for one column)."""
    clause = column_clause() if clause is None else clause
    gathered = meta.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("ordinal"), clause.alias("clause")))).alias("_c"))
    ddl = F.transform(F.col("_c"), lambda x: x["clause"])
    return gathered.select(*keys, ddl.alias("column_ddl"),
                           F.concat(F.lit("("), F.array_join(ddl, ", "), F.lit(")")).alias("column_ddl_text"),
                           F.size(ddl).alias("n_columns"))


def relative_path(location: Column, app: str) -> Column:
    """Strip everything through the last ``<app>/`` of a location (``app`` is
    quoted as a literal) and publish it as ``/internal/<app>/<rest>/``."""
    rest = F.regexp_replace(location, ".*" + re.escape(app) + "/", "")
    return F.concat(F.lit(f"/internal/{app}/"), rest, F.lit("/"))


def rename_reserved(df: DataFrame) -> DataFrame:
    """M11 on data: rename string columns with reserved names (``value`` -> ``raw_value``)."""
    for f in df.schema.fields:
        if f.name in RESERVED_RENAMES and isinstance(f.dataType, StringType):
            df = df.withColumnRenamed(f.name, RESERVED_RENAMES[f.name])
    return df


def schema_on_read(df: DataFrame, value_col: str, columns: Sequence[tuple[str, str]],
                   keep: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """M7, F18 on data: typed columns pulled out of a JSON text column
    (``Value:name::type``) through a variant.  Text that is no JSON and values that
    do not fit the type fail the job if ``strict``, else become NULL."""
    parse, get = (F.parse_json, F.variant_get) if strict else (F.try_parse_json, F.try_variant_get)
    v = parse(F.col(value_col))
    return df.select(*keep, *[get(v, f"$.{name}", typ).alias(name) for name, typ in columns])

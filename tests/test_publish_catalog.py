import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from lakeforge import registry as R
from lakeforge.plans import catalog as C
from lakeforge.plans import publish as P

from .conftest import SF_CHECK, SF_SMALL
from .helpers import plan_text, scratch

DAY = dt.date(2024, 1, 3)


@pytest.fixture(scope="module")
def app(spark):
    return R._build_app(spark, SF_CHECK)[0]


def test_app_tables(spark, app):
    ev = spark.table(f"{app}.events")
    assert ev.count() == 10_000
    assert dict(ev.dtypes)["P_Month"] == "string"
    assert ev.where(P.day_filter(DAY)).count() == 333
    assert ev.where("Row_IsActive").count() == 150


def test_internal_publish_twice_is_once(spark, app):
    wh = f"wh_{uuid.uuid4().hex}"
    name = P.published_table_name(wh, "sales_app", "events")
    loc = scratch() + "/it's a warehouse.db"  # quotes and spaces in a path
    rep1 = P.publish(spark, app, wh, "internal", app="sales_app", day=DAY, target_location=loc)
    n1 = spark.table(name).count()
    P.publish(spark, app, wh, "internal", app="sales_app", day=DAY, target_location=loc)
    assert n1 == spark.table(name).count() == 333
    steps = {(r.table, r.step) for r in rep1.collect()}
    assert {("events", "load_day"), ("events", "create_view"), ("single", "create_internal_table"), ("single", "load_whole")} <= steps
    assert spark.table(P.published_table_name(wh, "sales_app", "single")).count() == 10_000
    assert "raw_value" in spark.table(P.published_table_name(wh, "sales_app", "metrics")).columns
    view = spark.table(name + P.VIEW_SUFFIX)
    assert view.count() == spark.table(name).where("Row_IsActive").count()


def test_views_of_the_application_are_reported(spark, app):
    spark.sql(f"CREATE OR REPLACE VIEW {app}.recent AS SELECT * FROM {app}.single")
    try:
        report = P.publish(spark, app, f"wh_{uuid.uuid4().hex}", "internal", app="sales_app", day=DAY, target_location=scratch() + "/w.db", tables=["recent"])
        assert [(r.table, r.step) for r in report.collect()] == [("recent", "skip_view")]
    finally:
        spark.sql(f"DROP VIEW {app}.recent")


def test_external_data_is_not_deleted(spark, app):
    wh = f"wh_{uuid.uuid4().hex}"
    P.publish(spark, app, wh, "external", app="sales_app", day=DAY, target_location=scratch() + "/w.db")
    name = P.published_table_name(wh, "sales_app", "events")
    with pytest.raises(ValueError):
        P.remove_objects(spark, name, delete_data=True)
    P.remove_objects(spark, name)
    assert not spark.catalog.tableExists(name) and spark.table(f"{app}.events").count() == 10_000
    metrics = P.published_table_name(wh, "sales_app", "metrics")
    assert spark.table(metrics).columns == ["event_id", "raw_value", "P_Year", "P_Month", "P_Day"]
    P.remove_objects(spark, metrics)
    assert not spark.catalog.tableExists(metrics) and not spark.catalog.tableExists(metrics + P.FILES_SUFFIX)


def test_results_stay_as_they_were(spark):
    """All publish queries first, then every result against its SQL."""
    import duckdb

    from tools.check_oracle import rows_of

    names = ["external_table", "day_load", "external_metrics", "published_view", "day_load_metrics", "publish_undated", "day_reload_empty", "publish_on_read",
             "remove_published", "day_load_twice"]
    frames = {n: R.QUERIES[n](spark, SF_SMALL) for n in names}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF_SMALL}/events.parquet')")
    for n, df in frames.items():
        want = con.sql(R.ORACLE_SQL[n])
        assert rows_of(df.columns, [tuple(r) for r in df.collect()], 9) == rows_of(want.columns, want.fetchall(), 9), n


def test_load_day_prunes_partitions(spark, app):
    df = spark.table(f"{app}.events").where(P.day_filter(DAY))
    text = plan_text(df)
    assert "PartitionFilters: [isnotnull(P_Year" in text and "(P_Day#" in text


def test_external_table_needs_repair_then_refresh(spark, app):
    loc = scratch() + "/ext_events"
    spark.table(f"{app}.events").where(P.day_filter(DAY)).write.partitionBy(*C.DAY_PARTITION_COLUMNS).parquet(loc)
    cols = ["event_id bigint", "ts timestamp_ntz", "user_id bigint", "event_type string", "value double",
            "props string", "Row_IsActive boolean"]
    spark.sql(f"DROP TABLE IF EXISTS {app}.ext_probe")
    spark.sql(f"CREATE TABLE {app}.ext_probe ({', '.join(cols)}, P_Year string, P_Month string, P_Day string) "
              f"USING parquet PARTITIONED BY (P_Year, P_Month, P_Day) LOCATION '{loc}'")
    assert spark.table(f"{app}.ext_probe").count() == 0  # partitions not yet known
    P.refresh_external_table(spark, f"{app}.ext_probe")
    assert spark.table(f"{app}.ext_probe").count() == 333
    spark.table(f"{app}.events").where(P.day_filter(DAY)).write.mode("append") \
        .partitionBy(*C.DAY_PARTITION_COLUMNS).parquet(loc)
    P.refresh_external_table(spark, f"{app}.ext_probe")
    assert spark.table(f"{app}.ext_probe").count() == 666
    P.create_external_table(spark, f"{app}.ext_probe", loc, cols)
    assert spark.table(f"{app}.ext_probe").count() == 666
    P.remove_objects(spark, f"{app}.ext_probe")
    assert not spark.catalog.tableExists(f"{app}.ext_probe")


def test_column_metadata_uses_partition_flag(spark, app):
    meta = C.column_metadata(spark, app, ["events", "metrics", "single"])
    parts = {(r.table, r.col_name) for r in meta.where("is_partition").collect()}
    assert parts == {(t, p) for t in ("events", "metrics") for p in C.DAY_PARTITION_COLUMNS}
    g = {r.table: r for r in C.gather_columns(C.exclude_columns(meta, C.DAY_PARTITION_COLUMNS)).collect()}
    assert g["single"].column_ddl_text == "(event_id bigint)"  # no trailing comma
    assert g["metrics"].column_ddl == ["event_id bigint", "raw_value string"]
    assert g["events"].column_ddl[0] == "event_id bigint" and g["events"].n_columns == 7
    on_read = C.gather_columns(meta.where("table = 'single'"), C.column_clause_on_read()).first()
    assert on_read.column_ddl == ["event_id bigint as (Value:event_id::bigint)"]


def test_relative_path_and_names(spark):
    df = spark.createDataFrame([("dbfs:/mnt/sales_app/x/sales_app/tbl",), ("/no/app/here",)], "location string")
    got = [r[0] for r in df.select(C.relative_path(F.col("location"), "sales_app")).collect()]
    assert got == ["/internal/sales_app/tbl/", "/internal/sales_app//no/app/here/"]
    one = spark.createDataFrame([("orders",)], "table string").select(C.published_name("db", "sch", "app")).first()[0]
    assert one == "DB.SCH.APP_ORDERS"


def test_schema_on_read_bad_values(spark):
    df = spark.createDataFrame([(1, '{"k": 5}'), (2, '{"k": "x"}'), (3, "not json"), (4, None)], "id int, props string")
    got = {r.id: r.k for r in C.schema_on_read(df, "props", [("k", "int")], keep=["id"]).collect()}
    assert got == {1: 5, 2: None, 3: None, 4: None}
    with pytest.raises(Exception, match="MALFORMED_RECORD|INVALID_VARIANT_CAST|malformed"):
        C.schema_on_read(df, "props", [("k", "int")], keep=["id"], strict=True).collect()


def test_rename_reserved(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "id int, value string, other double")
    assert C.rename_reserved(df).columns == ["id", "raw_value", "other"]
    df2 = spark.createDataFrame([(1, 2.0)], "id int, value double")
    assert C.rename_reserved(df2).columns == ["id", "value"]


def test_column_clauses_are_native(spark, app):
    meta = C.column_metadata(spark, app, ["single"])
    text = plan_text(C.gather_columns(meta))
    assert "Python" not in text and "ArrowEvalPython" not in text


def test_load_days_backfill_in_one_job(spark, app):
    days = [dt.date(2024, 1, 3), dt.date(2024, 1, 4), dt.date(2024, 1, 5)]
    src = spark.table(f"{app}.events")
    text = plan_text(src.where(P.day_filter(days)))
    assert "PartitionFilters: [" in text
    cols = ["event_id bigint", "ts timestamp_ntz", "user_id bigint", "event_type string", "value double",
            "props string", "Row_IsActive boolean"]
    spark.sql(f"DROP TABLE IF EXISTS {app}.backfill")
    P.create_internal_table(spark, f"{app}.backfill", cols)
    P.load_day(spark, src, f"{app}.backfill", days)
    P.load_day(spark, src, f"{app}.backfill", days[1:])  # re-run of two days replaces them
    want = src.where(P.day_filter(days)).count()
    assert spark.table(f"{app}.backfill").count() == want
    assert spark.table(f"{app}.backfill").select("P_Day").distinct().count() == 3
    left = src.where("P_Day <> '04'")
    P.load_day(spark, left, f"{app}.backfill", days[1])  # a day that has become empty
    P.load_day(spark, left.where("P_Day <> '05'"), f"{app}.backfill", days)
    assert {r.P_Day for r in spark.table(f"{app}.backfill").select("P_Day").distinct().collect()} == {"03"}
    spark.sql(f"DROP TABLE {app}.backfill")

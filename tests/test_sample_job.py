import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StringType, StructField, StructType

from lakeforge.operators import query as Q
from lakeforge.sources import tables as T

from .helpers import plan_text, scratch

SCHEMA = StructType([
    StructField("AirportCode", StringType(), False),
    StructField("Date", DateType(), False),
    StructField("TempHighF", IntegerType(), False),
    StructField("TempLowF", IntegerType(), False),
])
ROWS = [
    ("BLI", dt.date(2021, 4, 3), 52, 43), ("BLI", dt.date(2021, 4, 2), 50, 38), ("BLI", dt.date(2021, 4, 1), 52, 41),
    ("PDX", dt.date(2021, 4, 3), 64, 45), ("PDX", dt.date(2021, 4, 2), 61, 41), ("PDX", dt.date(2021, 4, 1), 66, 39),
    ("SEA", dt.date(2021, 4, 3), 57, 43), ("SEA", dt.date(2021, 4, 2), 54, 39), ("SEA", dt.date(2021, 4, 1), 56, 41),
]
EXPECTED = [
    ("PDX", dt.date(2021, 4, 3), 64, 45), ("PDX", dt.date(2021, 4, 2), 61, 41),
    ("SEA", dt.date(2021, 4, 3), 57, 43), ("SEA", dt.date(2021, 4, 2), 54, 39),
]
QUERY = ("SELECT * FROM demo_temps_table WHERE AirportCode != 'BLI' AND Date > '2021-04-01' "
         "GROUP BY AirportCode, Date, TempHighF, TempLowF ORDER BY TempHighF DESC")


def test_sample_job_sql(spark):
    T.create_database(spark, "temps_db", scratch() + "/temps_db")
    T.use_database(spark, "temps_db")
    try:
        temps = T.from_rows(spark, ROWS, SCHEMA)
        T.drop_table(spark, "demo_temps_table")
        T.save_table(temps, "demo_temps_table")
        got = [tuple(r) for r in spark.sql(QUERY).collect()]
        assert got == EXPECTED
        assert [tuple(r) for r in T.preview(spark.sql(QUERY), 20).collect()] == EXPECTED
        # plain saveAsTable refuses to overwrite; the re-creatable form replaces
        import pytest
        with pytest.raises(Exception):
            T.save_table(temps, "demo_temps_table")
        T.save_table(temps, "demo_temps_table", replace=True)
        assert T.read_table(spark, "demo_temps_table").count() == 9
        T.drop_table(spark, "demo_temps_table", if_exists=False)
        assert not spark.catalog.tableExists("demo_temps_table")
    finally:
        T.use_database(spark, "default")


def test_sample_job_dataframe_with_duplicates_and_nulls(spark):
    schema = "AirportCode string, Date date, TempHighF int, TempLowF int"
    rows = ROWS + [ROWS[3], (None, dt.date(2021, 4, 3), 70, 50), ("SEA", None, 80, 60)]
    df = spark.createDataFrame(rows, schema)
    out = Q.filter_distinct_sort(df, [Q.not_equal("AirportCode", "BLI"), Q.greater_than("Date", "2021-04-01")],
                                 ["TempHighF"])
    assert [tuple(r) for r in out.collect()] == EXPECTED


def test_top_k_first_row_stack(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    top = Q.top_k(df, 2, [F.col("TempHighF").desc(), F.col("AirportCode"), F.col("Date")]).collect()
    assert [(r.AirportCode, r.TempHighF) for r in top] == [("PDX", 66), ("PDX", 64)]
    assert Q.first_row(df).count() == 1
    assert Q.stack([df, df]).count() == 18
    assert Q.drop_columns(df, ["", "TempLowF"]).columns == ["AirportCode", "Date", "TempHighF"]
    assert df.where(Q.not_in("AirportCode", ["BLI", "SEA"])).count() == 3


def test_pushdown_in_plan(spark):
    path = scratch() + "/temps"
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(path)
    df = spark.read.parquet(path)
    out = Q.filter_distinct_sort(df, [Q.not_equal("AirportCode", "BLI"), Q.greater_than("Date", "2021-04-01")],
                                 ["TempHighF"])
    text = plan_text(out)
    assert "PushedFilters: [IsNotNull(AirportCode), IsNotNull(Date), Not(EqualTo(AirportCode,BLI)), GreaterThan(Date,2021-04-01)]" in text

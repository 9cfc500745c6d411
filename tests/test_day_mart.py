"""Marts kept by day, and external tables brought in line with their folders."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakeforge.operators.day_mart import DayMart
from lakeforge.plans import publish as P
from lakeforge.session import hadoop_fs
from lakeforge.sources import files, tables

from .helpers import plan_text, scratch

DDL = "k string, at timestamp_ntz, amount decimal(12,2), who int, m0 int"
MEASURES = {"n": ("count", "who"), "total": ("sum", "amount"), "least": ("min", "amount"), "most": ("max", "who"), "people": ("distinct", "who")}


def _rows(seed, n=300):
    r = random.Random(seed)
    return [(r.choice(["a", "b", None]), r.choice([None, *(dt.datetime(2024, 3, d, h) for d in range(1, 6) for h in (0, 23))]),
             r.choice([None, Decimal(r.randint(-500, 500)) / 100]), r.choice([None, *range(12)]), 0) for _ in range(n)]


def _plain(rows):
    out = {}
    for k in {x[0] for x in rows}:
        who = [x[3] for x in rows if x[0] == k and x[3] is not None]
        amount = [x[2] for x in rows if x[0] == k and x[2] is not None]
        out[k] = (k, len(who), sum(amount) if amount else None, min(amount, default=None), max(who, default=None), len(set(who)), len(set(amount)))
    return out


def _mart(spark, keys=("k",)):
    return DayMart(spark, scratch() + "/mart", "at", keys, {**MEASURES, "amounts": ("distinct", F.col("amount") * 2)})


def _read(mart):
    return {r.k: tuple(r) for r in mart.read().collect()}


def test_refreshed_days_equal_the_whole(spark):
    old, new = _rows(1), _rows(2)
    day = lambda x: x[1].date() if x[1] else None
    mart = _mart(spark)
    mart.refresh(spark.createDataFrame(old, DDL))
    assert _read(mart) == _plain(old)
    today, source = old, spark.createDataFrame(new, DDL)
    for days in ([dt.date(2024, 3, 2)], [None, dt.date(2024, 3, 5)]):
        mart.refresh(source, days)
        today = [x for x in today if day(x) not in days] + [x for x in new if day(x) in days]
        assert _read(mart) == _plain(today)
    assert mart.days() == [*(dt.date(2024, 3, d) for d in range(1, 6)), None]
    mart.refresh(source)
    assert _read(mart) == _plain(new)


def test_other_days_are_neither_read_nor_written(spark):
    path = scratch() + "/source"
    spark.createDataFrame(_rows(3), DDL).write.parquet(path)
    mart, source = _mart(spark), spark.read.parquet(path)
    mart.refresh(source)
    listed = lambda: {r.path: (r.length, r.modificationTime) for r in files.list_files(spark, mart.path).collect()}
    before = listed()
    assert mart.refresh(source, [dt.date(2024, 3, 4)]) == ["2024-03-04"]
    after = listed()
    assert all(after[p] == before[p] for p in before)
    assert {p.split("__day=")[1].split("/")[0] for p in after if p not in before and "__day=" in p} == {"2024-03-04"}
    assert "PushedFilters: [Or" in plan_text(mart._of(source, [dt.date(2024, 3, 4), dt.date(2024, 3, 5)])) or "GreaterThanOrEqual(at" in plan_text(mart._of(source, [dt.date(2024, 3, 4)]))


def test_mart_of_nothing_lost_days_and_failures(spark):
    mart, source = _mart(spark), spark.createDataFrame(_rows(4), DDL)
    with pytest.raises(ValueError):
        mart.read()
    mart.refresh(source.limit(0))
    assert mart.read().count() == 0 and mart.days() == [] and mart.refresh(source, []) == []
    mart.refresh(source)
    kept = _read(mart)
    with pytest.raises(Exception, match="broken"):
        mart.refresh(source.withColumn("amount", F.expr("if(who = 3, raise_error('broken'), amount)").cast("decimal(12,2)")))
    assert _read(mart) == kept
    mart.refresh(source.where("at < '2024-03-02'"), [dt.date(2024, 3, d) for d in (1, 2, 3)])
    assert mart.days() == [dt.date(2024, 3, 1), dt.date(2024, 3, 4), dt.date(2024, 3, 5), None]
    with pytest.raises(RuntimeError):  # the number is taken
        mart.log.publish({**mart.log.latest(), "load": 0})
    with pytest.raises(ValueError):
        DayMart(spark, mart.path, "at", ["who"], MEASURES).refresh(source)
    with pytest.raises(ValueError):
        DayMart(spark, scratch(), "at", ["k"], {"x": ("sum", F.col("amount").cast("double"))}).refresh(source)
    with pytest.raises(ValueError):
        DayMart(spark, scratch(), "at", ["k"], {"k": ("sum", "amount")})


def test_mart_without_keys(spark):
    mart, rows = _mart(spark, ()), _rows(5)
    mart.refresh(spark.createDataFrame(rows, DDL))
    assert [tuple(r) for r in mart.read().collect()] == [_plain([("all", *x[1:]) for x in rows])["all"][1:]]


def test_only_changed_partitions_are_refreshed(spark):
    path, db = scratch() + "/ext", f"ext_{random.randrange(10**9)}"
    rows = spark.range(40).select("id", F.concat(F.lit("a b:"), F.col("id") % 4).alias("p"), (F.col("id") % 2).cast("string").alias("q"))
    write = lambda df: df.write.mode("append").partitionBy("p", "q").parquet(path)
    write(rows.where("id % 4 < 2"))
    tables.create_database(spark, db, path + ".db")
    P.create_external_table(spark, f"{db}.t", path, ["id bigint"], ["p", "q"])
    assert P.refresh_changed_partitions(spark, f"{db}.t") == ([], [])
    write(rows.where("id % 4 >= 2"))
    first = [s for s in P._folder_specs(spark, path, ["p", "q"]) if s.startswith("p=a b%3A0/")]
    fs, gone = hadoop_fs(spark, f"{path}/{first[0]}")
    fs.delete(gone, True)
    added, dropped = P.refresh_changed_partitions(spark, f"{db}.t")
    assert dropped == first and len(added) == 2 and spark.table(f"{db}.t").count() == 30
    write(rows.where("id = 1"))  # a new file in a known folder
    assert P.refresh_changed_partitions(spark, f"{db}.t") == ([], []) and spark.table(f"{db}.t").count() == 31
    spark.sql(f"CREATE TABLE {db}.own (id bigint) USING parquet")
    with pytest.raises(ValueError):
        P.refresh_changed_partitions(spark, f"{db}.own")

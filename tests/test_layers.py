import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakeforge.operators import bronze as B
from lakeforge.operators import gold as G
from lakeforge.operators import silver as S

from .helpers import plan_text, scratch

T0 = dt.datetime(2024, 1, 1)


def _events(spark):
    rows = [(1, 10, T0, "a"), (2, 10, T0 + dt.timedelta(hours=1), "b"), (3, 10, None, "c"),
            (4, None, T0, "d"), (5, None, T0 + dt.timedelta(hours=2), "e"), (6, 20, T0, "f"), (7, 20, T0, "g")]
    return spark.createDataFrame(rows, "id int, k int, ts timestamp_ntz, v string")


def test_dedupe_latest_nulls_oldest(spark):
    got = {r.k: r.id for r in S.dedupe_latest(_events(spark), ["k"], ["ts", "id"]).collect()}
    assert got == {10: 2, None: 5, 20: 7}


def test_flag_active_matches_dedupe(spark):
    df = S.flag_active(_events(spark), ["k"], ["ts", "id"])
    assert {r.id for r in df.where("Row_IsActive").collect()} == {2, 5, 7}
    assert df.count() == 7 and dict(df.dtypes)["Row_IsActive"] == "boolean"
    assert S.active_rows(df).count() == 3


def test_dedupe_exact(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, None), (5, None)], "id int, t string")
    assert sorted(tuple(r) for r in S.dedupe_exact(df, ["t"], "id").collect()) == [(1, "x"), (2, "y"), (4, None)]
    ties = spark.createDataFrame([(1, "x", "p"), (1, "x", "q"), (None, "x", "r"), (None, "y", "s"), (None, "y", "t")], "id int, t string, o string")
    got = S.dedupe_exact(ties, ["t"], "id").collect()
    assert sorted((r.t, r.id) for r in got) == [("x", 1), ("y", None)]
    assert S.dedupe_exact(ties.limit(0), ["t"], "id").count() == 0


def test_conform(spark):
    df = spark.createDataFrame([("  ann  LEE ", "12", None, "x\ny")], "name string, n string, seg string, txt string")
    rules = S.ConformRules(renames={"n": "num"}, trim=["name"], title=["name"], casts={"num": "int"},
                           defaults={"seg": "UNKNOWN"}, remove_newlines=["txt"])
    r = S.conform(df, rules).first()
    assert (r.name, r.num, r.seg, r.txt) == ("Ann Lee", 12, "UNKNOWN", "xy")
    dirty = spark.createDataFrame([("x",)], "n string")
    assert S.conform(dirty, S.ConformRules(casts={"n": "int"})).first().n is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        S.conform(dirty, S.ConformRules(casts={"n": "int"}, strict=True)).collect()


def test_match_merge(spark):
    left = spark.createDataFrame([(1, "a", None), (2, "b", 5.0)], "k int, name string, bal double")
    right = spark.createDataFrame([(2, "B", 7.0), (3, "C", 1.0)], "k int, name string, bal double")
    got = {r.k: (r.name, r.bal, r._matched) for r in S.match_merge(left, right, ["k"]).collect()}
    assert got == {1: ("a", None, "left"), 2: ("b", 5.0, "both"), 3: ("C", 1.0, "right")}
    got_r = {r.k: r.name for r in S.match_merge(left, right, ["k"], prefer="right").collect()}
    assert got_r[2] == "B"


def test_cross_reference_null_groups(spark):
    df = spark.createDataFrame([(5, "a"), (3, "a"), (9, None), (7, None), (1, "b")], "key int, g string")
    got = {r.key: r.master_key for r in S.cross_reference(df, ["g"], "key").collect()}
    assert got == {5: 3, 3: 3, 9: 7, 7: 7, 1: 1}


def test_normalise(spark):
    df = spark.createDataFrame([(1, 2, "x"), (1, 2, "y"), (1, 3, "z")], "a int, b int, c string")
    ent = S.normalise(df, {"link": (["a", "b"], [])})["link"]
    rows = ent.collect()
    assert len(rows) == 2 and all(len(r.link_key) == 64 for r in rows)


def test_quality_split(spark):
    df = spark.createDataFrame([(1, 5.0), (2, -1.0), (3, None)], "id int, v double")
    passed, rejected, report = G.apply_quality(df, {"positive": F.col("v") > 0, "small_id": F.col("id") < 3})
    assert [r.id for r in passed.collect()] == [1]
    assert {r.id: r._failed_rules for r in rejected.collect()} == {2: ["positive"], 3: ["positive", "small_id"]}
    assert {r.rule: (r.failed_rows, r.total_rows) for r in report.collect()} == {"positive": (2, 3), "small_id": (1, 3)}


def test_flag_active_has_one_active_row_under_ties(spark):
    ev = _events(spark)
    doubled = ev.unionByName(ev)
    flagged = S.flag_active(doubled, ["k"], ["ts"])
    active = flagged.where("Row_IsActive").collect()
    assert sorted((r.k or 0, r.id) for r in active) == [(0, 5), (10, 2), (20, 6)] and flagged.count() == 14


def test_match_merge_repeated_and_null_keys(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (None, "n"), (None, "n")], "k int, name string")
    right = spark.createDataFrame([(1, 5.0), (1, 5.0), (None, 2.0)], "k int, bal double")
    got = sorted(((r.k, r.name, r.bal, r._matched) for r in S.match_merge(left, right, ["k"]).collect()), key=repr)
    assert got == sorted([(1, "a", 5.0, "both"), (None, "n", None, "left"), (None, "n", None, "left"), (None, None, 2.0, "right")], key=repr)


def test_hash_keys_differ_where_keys_do(spark):
    rows = [("a||b", None), ("a", "b"), ("a", None), (None, "a"), ("a||", "b"), ("", None), (None, ""), ("1:a", "b"), ("a;1:b", None)]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(S.hash_key("x", "y").alias("h")).distinct().count() == len(rows)


def test_star_join_leaves_the_strategy_to_spark(spark):
    fact = spark.range(1000).select(F.col("id"), (F.col("id") % 10).alias("d"))
    dim = spark.range(10).select(F.col("id").alias("dk"), F.col("id").cast("string").alias("name"))
    out = G.star_join(fact, [G.Dimension(dim, [("d", "dk")])])
    assert out.count() == 1000 and "ResolvedHint" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_mart_and_money(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", 1.05), ("c", None), ("d", 123456789012.34)], "k string, x double")
    got = {r.k: r.total for r in G.mart(df, ["k"], {"total": F.sum(G.money("x")).cast("double")}).collect()}
    assert got == {"a": 0.3, "b": 1.05, "c": None, "d": 123456789012.34}
    assert [r.c for r in df.select(G.cents("x").alias("c")).collect()] == [10, 20, 105, None, 12345678901234]
    with pytest.raises(Exception, match="more than two decimals"):
        spark.createDataFrame([(1.005,)], "x double").select(G.money("x")).collect()
    cm = G.cross_mart([G.mart(df, ["k"], {"n": F.count("*")}), spark.createDataFrame([("z", 1)], "k string, m int")], ["k"])
    assert cm.count() == 5


def test_bronze_land_archive_replay(spark):
    path = scratch() + "/bronze"
    src = scratch() + "/src"
    spark.range(100).withColumn("v", F.col("id") * 2).write.parquet(src)
    df = spark.read.parquet(src)
    B.archive(B.with_load_metadata(df, "r1", "2024-02-01 01:00:00"), path)
    B.archive(B.with_load_metadata(df, "r2", "2024-02-02 01:00:00"), path)
    B.archive(B.with_load_metadata(df, "r3", "2024-02-02 02:00:00"), path)  # another run of day 2
    B.archive(B.with_load_metadata(df, "r2", "2024-02-02 03:00:00"), path)  # a retry replaces its own run only
    assert spark.read.parquet(path).groupBy("_run_id").count().where("count <> 100").isEmpty()
    all_rows = spark.read.parquet(path).where("_run_id <> 'r3'")
    assert spark.read.parquet(path).count() == 300 and all_rows.count() == 200
    rp = B.replay(spark, path, days=["2024-02-02"], run_ids=["r2"])
    assert rp.count() == 100 and {r._run_id for r in rp.select("_run_id").distinct().collect()} == {"r2"}
    assert "PartitionFilters: [isnotnull(_load_day" in plan_text(rp)
    audit = B.load_audit(all_rows).groupBy("_run_id", "_load_day").agg(F.sum("row_count").alias("n"),
                                                                        F.count("_source_file").alias("files"))
    got = {(r._run_id, r._load_day): (r.n, r.files) for r in audit.collect()}
    n_files = len(spark.read.parquet(src).inputFiles())
    assert got == {("r1", "2024-02-01"): (100, n_files), ("r2", "2024-02-02"): (100, n_files)}
    B.land(df, scratch() + "/asis")

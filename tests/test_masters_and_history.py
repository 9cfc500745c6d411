"""Stored masters, changes between snapshots, satellites, transitive matches, staged loads, listing, observed writes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lakeforge.operators import gold as G
from lakeforge.operators import history as H
from lakeforge.operators import matching as X
from lakeforge.operators import silver as S
from lakeforge.operators.master import BUCKET, StoredMaster
from lakeforge.plans import publish as P
from lakeforge.session import hadoop_fs
from lakeforge.sources import files, tables

from .helpers import plan_text, scratch

T0 = dt.datetime(2024, 1, 1)


def _files(spark, path):
    return {r.path: (r.length, r.modificationTime) for r in files.list_files(spark, path).collect() if "/data/" in r.path}


def _as_dict(df, key="k"):
    return {r[key]: tuple(r) for r in df.collect()}


def test_master_rewrites_only_touched_buckets(spark):
    master = StoredMaster(spark, scratch() + "/m", ["k"], buckets=8)
    master.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("v")))
    before = _files(spark, master.path)
    touched = master.upsert(spark.createDataFrame([(3, "b", 1.5)], "k long, v string, extra double"))
    after = _files(spark, master.path)
    assert len(touched) == 1
    assert all(after[p] == before[p] for p in before)
    assert {p for p in after if p not in before and "part-" in p and ".crc" not in p and f"{BUCKET}={touched[0]}/" not in p} == set()
    got = _as_dict(master.read())
    assert len(got) == 200 and got[3] == (3, "b", 1.5) and got[4] == (4, "a", None)


def test_master_nulls_repeats_and_empty(spark):
    master = StoredMaster(spark, scratch() + "/m", ["k"], buckets=4)
    master.upsert(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "n", 0)], "k long, v string, at int"), latest=["at"])
    assert sorted(map(tuple, master.read().collect()), key=str) == [(1, "b", 2), (None, "n", 0)]
    master.upsert(spark.createDataFrame([(1, None, 3), (None, "n", 0)], "k long, v string, at int"))
    assert sorted(map(tuple, master.read().collect()), key=str) == [(1, "b", 3), (None, "n", 0), (None, "n", 0)]
    load = master.manifest()["load"]
    assert master.upsert(spark.createDataFrame([], "k long, v string, at int")) == [] and master.manifest()["load"] == load
    with pytest.raises(ValueError):
        master.upsert(spark.createDataFrame([(1, 2)], f"k long, {BUCKET} int"))


def test_master_failed_and_rival_loads_change_nothing(spark):
    master = StoredMaster(spark, scratch() + "/m", ["k"], buckets=4)
    master.upsert(spark.range(10).select(F.col("id").alias("k"), F.lit("a").alias("v")))
    with pytest.raises(Exception, match="broken"):
        master.upsert(spark.range(5).select(F.col("id").alias("k"), F.expr("if(id = 3, raise_error('broken'), 'z')").alias("v")))
    assert {r.v for r in master.read().collect()} == {"a"}
    with pytest.raises(RuntimeError):  # the number is taken
        master.log.publish({**master.manifest(), "load": 0})
    assert master.read().count() == 10


def test_snapshot_changes(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (None, "n", 1), (4, "x", 1), (4, "y", 1), (5, "x", 1), (5, "y", 1)], "k int, v string, op int")
    new = spark.createDataFrame([(1, "a", None), (2, "c", 1), (None, "n", 2), (6, "i", 1), (4, "y", 1), (4, "x", 1), (5, "x", 1)], "k int, v string, op int")
    got = sorted(map(tuple, H.snapshot_changes(old, new, ["k"], op="what").collect()), key=str)
    assert got == sorted([("update", 2, "c", 1), ("update", None, "n", 2), ("insert", 6, "i", 1), ("update", 5, "x", 1)], key=str)
    back = sorted(map(tuple, H.snapshot_changes(new, old.drop("v"), ["k"], op="what").where("k = 6 OR k = 1").collect()), key=str)
    assert back == [("delete", 6, 1, "i"), ("update", 1, None, None)]
    assert H.snapshot_changes(old, old, ["k"], op="what").isEmpty()
    assert H.snapshot_changes(old.limit(0), old.limit(0), ["k"], op="what").isEmpty()


def test_satellite_late_rows_ties_and_reload(spark):
    r = random.Random(5)
    rows = [(r.randint(1, 3), T0 + dt.timedelta(hours=r.randint(0, 400)), r.choice([None, "x", "y"]), n) for n in range(300)] + [(9, None, "x", 300)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, v string, n int")
    every = H.versions(df, ["k"], ["v"], "ts", ["n"])
    want, one = [], {}
    for k, ts, v, n in sorted((x for x in rows if x[1]), key=lambda x: x[3]):
        one[k, ts] = v
    for key in sorted({k for k, _ in one}):
        line = sorted(((ts, v) for (k, ts), v in one.items() if k == key), key=lambda x: x[0])
        kept = [x for i, x in enumerate(line) if i == 0 or line[i - 1][1] != x[1]]
        want += [(key, v, ts, kept[i + 1][0] if i + 1 < len(kept) else None) for i, (ts, v) in enumerate(kept)]
    path = scratch() + "/sat"
    for part in ("n % 3 = 1", "n % 3 = 0", "true"):
        times = df.where(part).select("k", F.col("ts").alias("valid_from")).distinct()
        H.load_satellite(path, every.join(times, ["k", "valid_from"], "left_semi").select(every.columns))
    assert H.load_satellite(path, every) == 0
    got = [tuple(x) for x in H.read_satellite(spark, path).select("k", "v", "valid_from", "valid_to").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_components_against_union_find(spark):
    r = random.Random(3)
    rows = [(k, r.choice([None, *range(120)]), r.randint(0, 150)) for k in range(300)] + [(k, 999, 1000 + k) for k in range(300, 500)] + [(None, 1, 1), (7, 5, 5)]
    parent = {k: k for k, _, _ in rows if k is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for col in (1, 2):
        groups = {}
        for row in rows:
            if row[0] is not None and row[col] is not None:
                groups.setdefault(row[col], []).append(row[0])
        for members in groups.values():
            for m in members:
                a, b = sorted((root(members[0]), root(m)))
                parent[b] = a
    df = spark.createDataFrame(rows, "k int, a int, b int")
    got = [(x.k, x.master_key) for x in X.cross_reference_all(df, [["a"], ["b"]], "k").collect()]
    assert sorted(got, key=str) == sorted([(k, None if k is None else root(k)) for k, _, _ in rows], key=str)
    assert X.cross_reference_all(df.limit(0), [["a"]], "k").isEmpty()


def test_rule_edges_are_stars(spark):
    hot = spark.range(2000).select(F.col("id").alias("k"), F.lit(1).alias("a"))
    assert X.rule_edges(hot, [["a"]], "k").count() == 1999
    long = spark.range(300).select(F.col("id").alias("k"), F.floor((F.col("id") + 1) / 2).alias("a"), F.floor(F.col("id") / 2).alias("b"))
    assert {r.master_key for r in X.cross_reference_all(long, [["a"], ["b"]], "k").collect()} == {0}


def test_clashing_helper_names(spark):
    df = spark.createDataFrame([(1, 1, "a", 7), (1, 2, "a", 8), (2, 1, "b", 9)], "k int, _rn int, _d string, _n int")
    assert S.dedupe_latest(df, ["k"], ["_rn"]).columns == df.columns
    assert sorted(map(tuple, S.dedupe_exact(df, ["_d"], "_rn").collect())) == [(1, 1, "a", 7), (2, 1, "b", 9)]
    flagged = S.flag_active(df.unionByName(df), ["k"], ["_rn"])
    assert flagged.columns == [*df.columns, "Row_IsActive"] and sorted(tuple(r)[:2] for r in flagged.where("Row_IsActive").collect()) == [(1, 2), (2, 1)]
    assert [tuple(r) for r in G.quality_report(df, {"_total": F.col("k") > 1}).collect()] == [("_total", 2, 3)]


def test_dedupe_exact_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", 2), ("a", 2), ("b", None), ("b", None), (None, 1)], "t string, n int")
    assert sorted(map(tuple, S.dedupe_exact(df, ["t"], "n").collect()), key=str) == sorted([("a", 2), ("b", None), (None, 1)], key=str)


def test_flag_active_numbers_only_ties(spark):
    """The window over whole rows lies above the filter on rows that tie for latest."""
    df = spark.createDataFrame([(1, 1, "wide"), (1, 2, "wide")], "k int, t int, w string")
    assert [tuple(r) for r in S.flag_active(df, ["k"], ["t"]).orderBy("t").collect()] == [(1, 1, "wide", False), (1, 2, "wide", True)]
    assert "> 1)" in plan_text(S.flag_active(df, ["k"], ["t"]))


def test_backfill_that_fails_changes_nothing(spark):
    db = f"staged_{random.randrange(10**9)}"
    tables.create_database(spark, db, scratch() + f"/{db}.db")
    P.create_internal_table(spark, f"{db}.t", ["id bigint", "v string"])
    cols = [F.lit("2024").alias("P_Year"), F.lit("01").alias("P_Month")]
    src = spark.range(30).select("id", F.lit("old").alias("v"), *cols, F.format_string("%02d", F.col("id") % 3 + 1).alias("P_Day"))
    days = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    P.load_day(spark, src, f"{db}.t", days)
    bad = src.withColumn("v", F.expr("if(id = 29, raise_error('broken'), 'new')"))
    with pytest.raises(Exception, match="broken"):
        P.load_day(spark, bad, f"{db}.t", days)
    assert {r.v for r in spark.table(f"{db}.t").collect()} == {"old"} and spark.table(f"{db}.t").count() == 30
    P.load_day(spark, src.where("P_Day <> '02'").withColumn("v", F.lit("new")), f"{db}.t", days)
    assert sorted((r.P_Day, r.v) for r in spark.table(f"{db}.t").select("P_Day", "v").distinct().collect()) == [("01", "new"), ("03", "new")]
    P.load_day(spark, src, f"{db}.t", days[1])
    assert spark.table(f"{db}.t").count() == 30


def test_failed_switch_points_back(spark, monkeypatch):
    db = f"switch_{random.randrange(10**9)}"
    tables.create_database(spark, db, scratch() + f"/{db}.db")
    P.create_internal_table(spark, f"{db}.t", ["id bigint"])
    cols = [F.lit("2024").alias("P_Year"), F.lit("01").alias("P_Month")]
    src = spark.range(20).select("id", *cols, F.format_string("%02d", F.col("id") % 2 + 1).alias("P_Day"))
    days = [dt.date(2024, 1, d) for d in (1, 2)]
    P.load_day(spark, src, f"{db}.t", days[0])
    real, calls = P.quote_text, []

    def failing(text):
        if ".loads/" in text:
            calls.append(text)
            if len(calls) == 2:
                raise RuntimeError("lost the catalog")
        return real(text)

    monkeypatch.setattr(P, "quote_text", failing)
    with pytest.raises(RuntimeError):
        P.load_day(spark, src.where("id > 100"), f"{db}.t", days)
    monkeypatch.undo()
    assert sorted(r.id for r in spark.table(f"{db}.t").collect()) == list(range(0, 20, 2))


def test_listing_holds_hidden_and_empty_files(spark):
    root = scratch() + "/a b"
    spark.range(10).withColumn("p", F.col("id") % 3).write.partitionBy("p").parquet(root)
    fs, path = hadoop_fs(spark, f"{root}/deep/er/.hidden")
    fs.create(path).close()
    got = {r.path.rsplit("/", 1)[1]: r.length for r in files.list_files(spark, root).collect()}
    assert got[".hidden"] == 0 and got["_SUCCESS"] == 0 and sum(n.startswith("part-") for n in got) >= 3
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, root + "/none")


def test_quality_is_written_and_counted_at_once(spark):
    df = spark.createDataFrame([(1, "a"), (-1, "b"), (None, "a")], "n int, v string")
    path = scratch() + "/q"
    assert G.write_quality(df, {"positive": F.col("n") > 0, "a": F.col("v") == "a"}, path) == {"rows": 3, "passed": 1, "failed.positive": 2, "failed.a": 1}
    bad = spark.read.parquet(path).where(~F.col("__passed").cast("boolean"))
    assert {tuple(r._failed_rules) for r in bad.collect()} == {("positive", "a"), ("positive",)}
    with pytest.raises(ValueError):
        G.write_quality(df.withColumn("__passed", F.lit(1)), {"a": F.col("v") == "a"}, path)


def test_rebalanced_write_counts_nothing(spark):
    path = scratch() + "/r"
    tables.write_rebalanced(spark.range(2500).repartition(7), path, max_rows=1000)
    per_file = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in per_file) == 2500 and max(r["count"] for r in per_file) <= 1000


@pytest.mark.parametrize("hot", [0, 2, 10**6])
def test_satellite_of_entities_worked_on_by_spans(spark, monkeypatch, hot):
    monkeypatch.setattr(H, "HOT", hot, raising=False)
    r = random.Random(8)
    rows = [(r.choice([None, 1, 1, 1, 2, 3]), T0 + dt.timedelta(hours=r.randint(0, 300)), r.choice([None, "x", "y"]), n) for n in range(200)]
    df = spark.createDataFrame(rows, "part int, ts timestamp_ntz, hot string, n int")
    every = H.versions(df, ["part"], ["hot"], "ts", ["n"])
    want, one = [], {}
    for k, ts, v, _ in rows:
        one[k, ts] = v
    for key in {k for k, _ in one}:
        line = sorted(((ts, v) for (k, ts), v in one.items() if k == key), key=lambda x: x[0])
        kept = [x for i, x in enumerate(line) if i == 0 or line[i - 1][1] != x[1]]
        want += [(key, v, ts, kept[i + 1][0] if i + 1 < len(kept) else None) for i, (ts, v) in enumerate(kept)]
    path = scratch() + "/sat"
    H.load_satellite(path, every.where(F.col("valid_from") >= T0 + dt.timedelta(hours=150)))
    H.load_satellite(path, every)
    assert H.load_satellite(path, every) == 0
    got = H.read_satellite(spark, path)
    assert got.columns == [*every.columns, "valid_to"]
    assert sorted((tuple(x) for x in got.select("part", "hot", "valid_from", "valid_to").collect()), key=str) == sorted(want, key=str)
    keys = {x.entity_key for x in got.collect()}
    assert keys == {x.entity_key for x in every.collect()} and all(len(k) == 64 for k in keys)


def test_satellite_load_shuffles_rows_once(spark, monkeypatch):
    plans, measured = {}, H.measured

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
        return measured(df, name)

    monkeypatch.setattr(H, "measured", seen)
    df = spark.createDataFrame([(k % 5, T0 + dt.timedelta(hours=k), "xy"[k % 2], k) for k in range(40)], "k int, ts timestamp_ntz, v string, n int")
    path = scratch() + "/sat"
    every = measured(H.versions(df, ["k"], ["v"], "ts", ["n"]), "versions")
    H.load_satellite(path, every.where("k < 3"))
    H.load_satellite(path, every)
    deals = [line for line in plans["satellite"].splitlines() if "Exchange hashpartitioning(" in line]
    assert len(deals) <= 6 and not any("valid_from" in line for line in deals), deals

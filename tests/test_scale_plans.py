"""Plan checks for the scale claims: hot keys are reduced before the shuffle,
joins spread hot keys, filters reach the scan, no Python on native paths."""

from pyspark.sql import functions as F

from lakeforge.operators import silver as S
from lakeforge.operators.gold import exact_units_sum
from lakeforge.plans.publish import with_day_partitions, write_day_partitioned

from .helpers import plan_text, scratch


def _hot(spark, n=30_000):
    # one key carries a third of all rows
    return spark.range(n).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000).alias("user_id"),
        (F.lit(1_700_000_000) + F.col("id")).cast("timestamp").cast("timestamp_ntz").alias("ts"),
    )


def test_dedupe_reduces_hot_key_before_shuffle(spark):
    df = S.dedupe_latest(_hot(spark), ["user_id"], ["ts", "event_id"])
    text = plan_text(df)
    partial = text.index("WindowGroupLimit [user_id")
    assert "Partial" in text and "Final" in text
    # the partial limit sits below (after, in the text) the exchange
    assert text.index("Exchange hashpartitioning(user_id") < text.rindex("WindowGroupLimit") and partial >= 0
    got = {r.user_id: r.event_id for r in df.collect()}
    assert got[0] == 29_997 and len(got) == 1000


def test_flag_join_key_is_near_unique(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = S.flag_active(_hot(spark), ["user_id"], ["ts", "event_id"])
        text = plan_text(df)
        assert "SortMergeJoin [coalesce(user_id" in text and "coalesce(ts" in text and "coalesce(event_id" in text
        assert df.where("Row_IsActive").count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cross_reference_hot_group_partial_min(spark):
    df = S.cross_reference(_hot(spark), ["user_id"], "event_id")
    text = plan_text(df)
    # the group table is small and its size known: broadcast, no row of the table is shuffled
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text
    assert df.where("user_id = 0").select("master_key").distinct().first()[0] == 0


def test_no_job_runs_while_joins_are_declared(spark):
    from lakeforge import registry as R

    sc = spark.sparkContext
    for name in ("star_join", "sales_mart", "cross_mart", "match_merge", "active_flag"):
        R.QUERIES[name](spark, "/root/testdata/sf0.001")  # schemas are read once
        for path in ("lineitem", "orders", "customer", "nation", "supplier", "events"):
            assert spark.read.parquet(f"/root/testdata/sf0.001/{path}.parquet").columns
        sc.setJobGroup(f"declare {name}", name)
        df = R.QUERIES[name](spark, "/root/testdata/sf0.001")
        ran = sc.statusTracker().getJobIdsForGroup(f"declare {name}")
        stages = [sc.statusTracker().getStageInfo(s) for j in ran for s in sc.statusTracker().getJobInfo(j).stageIds]
        # reading a file's schema is a job of one task; nothing else may run
        assert all(s.numTasks == 1 for s in stages) and len(ran) <= len(df.inputFiles()) + 1, name
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_encrypt_columns_starts_no_job(spark):
    from lakeforge.functions.cipher import RC2Params, encrypt_columns

    df = _hot(spark).repartition(7)
    spark.sparkContext.setJobGroup("declare encrypt", "")
    encrypt_columns(df.withColumn("s", F.col("user_id").cast("string")), ["s"], RC2Params(b"some-key"))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("declare encrypt")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_match_merge_is_one_aggregation(spark):
    hot = _hot(spark)
    df = S.match_merge(hot.select("user_id", "event_id"), hot.select("user_id", "ts"), ["user_id"])
    text = plan_text(df)
    assert "Join" not in text and "partial_min" in text and df.count() == 1000


def test_dedupe_exact_moves_digests(spark):
    """The texts themselves aren't shuffled while the repeated digests are few."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = plan_text(S.dedupe_exact(docs, ["text"], "doc_id"))
    assert text.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in text


def test_exact_units_sum_hot_group(spark):
    big = 10 ** 12  # amounts far above 2^24 units
    df = spark.range(30_000).select((F.col("id") % 2).alias("k"), (F.lit(big) + F.col("id")).alias("u"))
    got = {r.k: r.s for r in df.groupBy("k").agg(exact_units_sum(F.col("u"), 4).alias("s")).collect()}
    import decimal
    want0 = sum(big + i for i in range(0, 30_000, 2))
    assert got[0] == decimal.Decimal(want0) / 10_000
    neg = spark.createDataFrame([(-5,), (3,), (-(2 ** 40),)], "u long").agg(exact_units_sum(F.col("u"), 2)).first()[0]
    assert neg == decimal.Decimal(-5 + 3 - 2 ** 40) / 100


def test_day_write_rebalances(spark):
    df = with_day_partitions(_hot(spark), "ts")
    path = scratch() + "/days"
    write_day_partitioned(df, path, rows_per_file=5_000)
    back = spark.read.parquet(path)
    assert back.count() == 30_000 and dict(back.dtypes)["P_Day"] == "string"
    assert "RebalancePartitions" in df.hint("rebalance", "P_Year")._jdf.queryExecution().analyzed().toString()


def test_day_write_without_shuffle_for_clustered_input(spark):
    df = with_day_partitions(_hot(spark), "ts")
    path = scratch() + "/days_sorted"
    write_day_partitioned(df, path, rebalance=False)
    assert spark.read.parquet(path).count() == 30_000


def test_bucketed_tables_join_without_shuffle(spark):
    from lakeforge.sources import tables as T

    T.create_database(spark, "bucket_db", scratch() + "/bucket_db")
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    T.save_table(li, "bucket_db.li", replace=True, bucket_by=(8, ["l_orderkey"]))
    T.save_table(orders, "bucket_db.orders", replace=True, bucket_by=(8, ["o_orderkey"]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = spark.table("bucket_db.li"), spark.table("bucket_db.orders")
        j = a.join(b, a.l_orderkey == b.o_orderkey)
        text = plan_text(j)
        assert "SortMergeJoin" in text and "Exchange" not in text
        assert j.count() == li.join(orders, li.l_orderkey == orders.o_orderkey).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_aqe_splits_the_hot_group_in_cross_reference(spark):
    """The join back of ``cross_reference`` is left to AQE; with a group holding a
    third of the rows, the executed plan marks the sort-merge join as skewed
    (its hot partition is split over several tasks) and the result stays exact."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = _hot(spark, 60_000).select("event_id", "user_id")
        out = S.cross_reference(df, ["user_id"], "event_id")
        rows = out.collect()
        final = out._jdf.queryExecution().executedPlan().toString()
        assert "isSkew=true" in final or "skew=true" in final
        assert len(rows) == 60_000
        assert {r.master_key for r in rows if r.user_id == 0} == {0}
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_aqe_splits_a_hot_order_in_the_star_join(spark):
    """A fact key holding a third of the rows: the fact-to-dimension sort-merge
    join of ``star_join`` (dimension too big to broadcast) gets its hot partition
    split by AQE."""
    from lakeforge.operators.gold import Dimension, star_join

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        fact = spark.range(60_000).select(F.col("id").alias("line"),
                                          F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).alias("orderkey"))
        orders = spark.range(5000).select(F.col("id").alias("o_orderkey"), (F.col("id") * 10).alias("o_total"))
        out = star_join(fact, [Dimension(orders, [("orderkey", "o_orderkey")])])
        assert len(out.collect()) == 60_000  # executes this plan (count() would plan a new one)
        final = out._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in final
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_flag_join_is_balanced_under_a_hot_key(spark):
    """``flag_active`` joins on keys plus order columns: even with one user holding
    a third of the rows, AQE finds no skewed partition to split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = S.flag_active(_hot(spark, 60_000), ["user_id"], ["ts", "event_id"])
        rows = out.collect()
        final = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in final and "skew=true" not in final
        assert sum(r.Row_IsActive for r in rows) == 1000 and len(rows) == 60_000
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_day_is_written_by_several_tasks(spark):
    """A day holding most of the rows: the rebalanced write splits that day's rows
    over several tasks (several files) instead of one task holding the day."""
    import os

    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        df = with_day_partitions(_hot(spark, 60_000), "ts")
        top = df.groupBy("P_Year", "P_Month", "P_Day").count().orderBy(F.desc("count")).first()
        path = scratch() + "/hot_day"
        write_day_partitioned(df, path)
        day_dir = f"{path}/P_Year={top.P_Year}/P_Month={top.P_Month}/P_Day={top.P_Day}"
        files = [f for f in os.listdir(day_dir) if f.endswith(".parquet")]
        assert top["count"] > 20_000 and len(files) > 1
        assert spark.read.parquet(path).count() == 60_000
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)

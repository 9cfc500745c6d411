"""Registered queries of stored masters, histories, changes between snapshots, transitive matches and observed writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import register, table
from .session import measured, work_path


@register("master_upsert", """
SELECT c_custkey AS party, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, last_order, last_date, last_price
FROM customer FULL JOIN (
  SELECT o_custkey, max(o_orderkey) AS last_order, max(o_orderdate) AS last_date, max(o_totalprice) AS last_price
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1 GROUP BY o_custkey) ON c_custkey = o_custkey
UNION ALL
SELECT -1 - s_suppkey, s_name, s_nationkey, s_acctbal, NULL, NULL, NULL FROM supplier
""")
def master_upsert(spark, sf_dir):
    """A stored party master: customers, then two loads of their latest orders, then suppliers as new parties."""
    from .operators.master import StoredMaster

    master = StoredMaster(spark, work_path(spark, "master"), ["party"], buckets=16)
    master.upsert(table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("party"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal")))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("party"), F.col("o_orderkey").alias("last_order"), F.col("o_orderdate").alias("last_date"), F.col("o_totalprice").alias("last_price"))
    for part in ("last_date < '1998-01-01'", "last_date >= '1998-01-01'"):
        master.upsert(orders.where(part), latest=["last_date", "last_order"])
    master.upsert(table(spark, sf_dir, "supplier").select(
        (-1 - F.col("s_suppkey")).alias("party"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal")))
    return master.read()


@register("snapshot_changes", """
WITH later AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
                      o_orderdate, o_orderpriority FROM orders WHERE o_orderdate >= '1996-01-01')
SELECT 'insert' AS op, * FROM later WHERE o_orderdate >= '2001-01-01'
UNION ALL SELECT 'update', * FROM later WHERE o_orderdate < '2001-01-01' AND o_orderstatus = 'P'
UNION ALL SELECT 'delete', o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderdate < '1996-01-01'
""")
def snapshot_changes(spark, sf_dir):
    """L3: inserts, updates and deletes between two archived days of a table that is delivered whole."""
    from .operators import bronze, history

    orders, path = table(spark, sf_dir, "orders"), work_path(spark, "snapshots")
    first = orders.where("o_orderdate < '2001-01-01'")
    price = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    second = orders.where("o_orderdate >= '1996-01-01'").withColumn("o_totalprice", price)
    for run, (day, rows) in enumerate((("2024-02-01", first), ("2024-02-02", second))):
        bronze.archive(bronze.with_load_metadata(rows, f"run-{run}", f"{day} 00:00:00", source_file=False), path)
    days = [bronze.replay(spark, path, days=[day]).select(*orders.columns) for day in ("2024-02-01", "2024-02-02")]
    return history.snapshot_changes(*days, ["o_orderkey"])


@register("satellite_history", """
WITH one AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS n FROM events WHERE ts IS NOT NULL),
marked AS (SELECT user_id, event_type, ts, lag(event_type) OVER w AS before, row_number() OVER w AS k FROM one WHERE n = 1 WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS valid_to
FROM marked WHERE k = 1 OR before IS DISTINCT FROM event_type
""")
def satellite_history(spark, sf_dir):
    """A satellite of users loaded twice with overlap, the later half first, then reloaded; its effective intervals."""
    from .operators import history

    path = work_path(spark, "satellite")
    every = measured(history.versions(table(spark, sf_dir, "events"), ["user_id"], ["event_type"], "ts", ["event_id"]), "versions")
    history.load_satellite(path, every.where("valid_from >= '2024-01-15'"))
    history.load_satellite(path, every)
    if history.load_satellite(path, every):
        raise AssertionError("a reload added rows")
    return history.read_satellite(spark, path).select("user_id", "event_type", "valid_from", "valid_to")


@register("link_first_seen", """
SELECT sha256(concat(strlen(CAST(user_id AS VARCHAR)), ':', user_id, ';', strlen(event_type), ':', event_type)) AS link_key, user_id, event_type, min(ts) AS first_seen
FROM events GROUP BY ALL
""")
def link_first_seen(spark, sf_dir):
    """The link of users and event types with the time it was first seen."""
    from .operators import history

    return history.hub(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "link")


@register("xref_transitive", """
WITH RECURSIVE g AS (
  SELECT o_orderkey AS k, concat('a', o_custkey, strftime(o_orderdate, '%Y-%m')) AS g FROM orders
  UNION ALL SELECT o_orderkey, concat('b', o_orderdate, o_orderstatus, o_orderpriority) FROM orders),
e AS (SELECT DISTINCT x.k AS u, y.k AS v FROM g x JOIN g y USING (g) WHERE x.k <> y.k),
reach(k, m) AS (
  SELECT o_orderkey, o_orderkey FROM orders
  UNION SELECT e.v, m FROM reach JOIN e ON e.u = reach.k WHERE m < e.v)
SELECT k AS o_orderkey, min(m) AS master_key FROM reach GROUP BY k
""")
def xref_transitive(spark, sf_dir):
    """Orders that two match rules connect, directly or through others, with the least order of each component."""
    from .operators import matching

    orders = table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return matching.cross_reference_all(orders, [["o_custkey", "month"], ["o_orderdate", "o_orderstatus", "o_orderpriority"]], "o_orderkey")


@register("list_every_file", """
SELECT 'data' AS kind, count(DISTINCT CAST(ts AS DATE)) AS folders, true AS has_bytes FROM events
UNION ALL SELECT 'marker', 1, false
""")
def list_every_file(spark, sf_dir):
    """Events written by day; the listing holds the data files, and the hidden and empty marker beside them."""
    from .sources.files import list_files

    path = work_path(spark, "listed")
    table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).hint("rebalance", "day").write.partitionBy("day").parquet(path)
    listed = list_files(spark, path).withColumn("name", F.regexp_extract("path", "[^/]*$", 0)).where("name NOT LIKE '%.crc'")
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    kind = F.when(F.col("name").startswith("_"), "marker").otherwise("data")
    return listed.groupBy(kind.alias("kind")).agg(F.count_distinct(folder).alias("folders"), F.min(F.col("length") > 0).alias("has_bytes"))


@register("write_rebalanced", "SELECT count(*) AS row_count, true AS all_within FROM lineitem")
def write_rebalanced(spark, sf_dir):
    """Line items written in one pass, at most 5,000 rows to a file; the files as read back."""
    from .sources.files import read_with_source
    from .sources.tables import write_rebalanced as write

    path = work_path(spark, "rebalanced")
    write(table(spark, sf_dir, "lineitem"), path, max_rows=5000)
    per_file = read_with_source(spark, path).groupBy("_source_path").agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(F.sum("n").alias("row_count"), (F.max("n") <= 5000).alias("all_within"))


def _observed_sql() -> str:
    from .registry import _QUALITY_RULES_SQL as rules

    everything = " AND ".join(f"coalesce({r}, false)" for r in rules.values())
    parts = ["SELECT 'rows' AS metric, count(*) AS observed, count(*) AS stored FROM events",
             f"SELECT 'passed', count(*), count(*) FROM events WHERE {everything}"]
    parts += [f"SELECT 'failed.{n}', count(*), count(*) FROM events WHERE NOT coalesce({r}, false)" for n, r in rules.items()]
    return "\nUNION ALL\n".join(parts)


@register("quality_observed", _observed_sql())
def quality_observed(spark, sf_dir):
    """Passed and quarantined rows from one scan; the counts its job observed beside those of the files."""
    from .operators.gold import write_quality
    from .registry import _quality_rules

    path, rules = work_path(spark, "quality"), _quality_rules()
    observed = write_quality(table(spark, sf_dir, "events"), rules, path)
    stored = spark.read.parquet(path).withColumn("__passed", F.col("__passed").cast("boolean"))
    counts = stored.agg(F.count(F.lit(1)).alias("rows"), F.count_if("__passed").alias("passed"),
                        *[F.count_if(F.array_contains("_failed_rules", n)).alias(f"failed.{n}") for n in rules])
    names = list(observed)
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(observed[n]).cast("long").alias("observed"), F.col(f"`{n}`").alias("stored")) for n in names])).alias("m"))
    return long.select("m.*")


@register("mart_by_day", """
SELECT event_type, count(event_id) AS events, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS units, min(ts) AS first_ts, max(ts) AS last_ts,
       count(DISTINCT user_id) AS users
FROM events GROUP BY event_type
""")
def mart_by_day(spark, sf_dir):
    """A mart kept by day. Its first load lacks late events of two days and has a day too many; these three are refreshed."""
    import datetime as dt

    from .operators.day_mart import DayMart

    events = table(spark, sf_dir, "events")
    late = (F.col("ts") >= "2024-01-10") & (F.col("ts") < "2024-01-12") & (F.col("event_type") == "purchase")
    extra = events.where("ts < '2024-01-02'").withColumn("ts", F.col("ts") - F.expr("INTERVAL 10 DAYS"))
    days = [dt.date(2024, 1, 10), dt.date(2024, 1, 11), *(dt.date(2023, 12, d) for d in (22, 23))]
    mart = DayMart(spark, work_path(spark, "mart"), "ts", ["event_type"], {
        "events": ("count", "event_id"), "units": ("sum", F.floor("value")), "first_ts": ("min", "ts"), "last_ts": ("max", "ts"), "users": ("distinct", "user_id")})
    mart.refresh(events.where(~late).unionByName(extra))
    mart.refresh(events, days)
    return mart.read()


@register("external_refresh", """
SELECT event_id, event_type, strftime(ts, '%Y') AS P_Year, strftime(ts, '%m') AS P_Month, strftime(ts, '%d') AS P_Day
FROM events WHERE strftime(ts, '%Y-%m-%d') <> '2024-01-03'
""")
def external_refresh(spark, sf_dir):
    """An external table over the first days; later days' folders come, one goes, and only these are added and dropped."""
    import uuid

    from .plans import publish
    from .session import hadoop_fs
    from .sources.tables import create_database

    path, db = work_path(spark, "external"), f"refresh_{uuid.uuid4().hex[:12]}"
    events = publish.with_day_partitions(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), "ts").drop("ts")
    publish.write_day_partitioned(events.where("P_Day <= '20'"), path)
    create_database(spark, db, f"{path}.db")
    publish.create_external_table(spark, f"{db}.events", path, ["event_id bigint", "event_type string"])
    publish.write_day_partitioned(events.where("P_Day > '20'"), path)
    fs, gone = hadoop_fs(spark, f"{path}/P_Year=2024/P_Month=01/P_Day=03")
    fs.delete(gone, True)
    publish.refresh_changed_partitions(spark, f"{db}.events")
    return spark.table(f"{db}.events")

"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame
computed over the whole driver tables, with an equivalent DuckDB SQL oracle.

Column names are aliased identically on both sides.  Money is summed exactly
(decimal, or split 64-bit integer sums of cents) and cast to double only at the
end, so the two engines agree bit for bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import query as Q
from .session import configure

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE_SQL[name] = oracle.strip()
        return run

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --------------------------------------------------------------------------- sample job shape

@register("filter_distinct_sort", """
SELECT * FROM orders
WHERE o_orderstatus != 'F' AND o_orderdate > '1997-01-01'
GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
ORDER BY o_totalprice DESC
""")
def filter_distinct_sort(spark, sf_dir):
    """Not-equal and date filters, group by all columns, order desc."""
    orders = table(spark, sf_dir, "orders")
    return Q.filter_distinct_sort(
        Q.select_all(orders),
        [Q.not_equal("o_orderstatus", "F"), Q.greater_than("o_orderdate", "1997-01-01")],
        ["o_totalprice"],
    )


@register("top_k", """
SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20
""")
def top_k(spark, sf_dir):
    """A5: the top 20 orders by total price (key as tiebreak); a top-k report."""
    orders = table(spark, sf_dir, "orders")
    return Q.top_k(orders, 20, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()])


@register("not_in_filter", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity
FROM lineitem WHERE l_returnflag NOT IN ('R', 'A')
""")
def not_in_filter(spark, sf_dir):
    """P5: NOT IN list filter, pushed into the parquet scan."""
    li = table(spark, sf_dir, "lineitem")
    return li.where(Q.not_in("l_returnflag", ["R", "A"])).select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")


@register("drop_columns", """
SELECT c_custkey, c_name, c_nationkey FROM customer
""")
def drop_columns(spark, sf_dir):
    """Drop excluded columns by name (the empty name is ignored)."""
    return Q.drop_columns(table(spark, sf_dir, "customer"), ["", "c_acctbal", "c_mktsegment"])


# --------------------------------------------------------------------------- paths and clock

_PATH_SQL = """concat('/mnt/', CASE WHEN event_type = 'error' THEN 'quarantine9/' ELSE 'landing/' END,
               strftime(ts, '%Y/%m/%d'), '/P_', lpad(CAST(user_id AS VARCHAR), 5, '0'), '_',
               event_type, '_', CAST(event_id AS VARCHAR), '.csv')"""


def _event_paths(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    root = F.when(F.col("event_type") == "error", "quarantine9/").otherwise("landing/")
    path = F.concat(F.lit("/mnt/"), root, F.date_format("ts", "yyyy/MM/dd"), F.lit("/P_"),
                    F.lpad(F.col("user_id").cast("string"), 5, "0"), F.lit("_"), F.col("event_type"),
                    F.lit("_"), F.col("event_id").cast("string"), F.lit(".csv"))
    return ev.select("event_id", path.alias("path"))


@register("path_parts", f"""
SELECT event_id, path,
       regexp_replace(path, '.*[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}/', '', 'g') AS file_name,
       substr(regexp_replace(path, 'P_[0-9]{{5}}|[^0-9]', '', 'g'), 1, 8) AS file_date,
       substr(substr(regexp_replace(path, 'P_[0-9]{{5}}|[^0-9]', '', 'g'), 1, 8), 1, 4) AS file_year,
       substr(substr(regexp_replace(path, 'P_[0-9]{{5}}|[^0-9]', '', 'g'), 1, 8), 5, 2) AS file_month,
       substr(substr(regexp_replace(path, 'P_[0-9]{{5}}|[^0-9]', '', 'g'), 1, 8), 7) AS file_day
FROM (SELECT event_id, {_PATH_SQL} AS path FROM events)
""")
def path_parts(spark, sf_dir):
    """File name, date text and its parts from landed paths (native regex)."""
    from .functions.paths import with_path_parts

    return with_path_parts(_event_paths(spark, sf_dir), "path")


@register("write_sizing", """
SELECT 'orders' AS table_name, count(*) AS row_count, CAST(1 + count(*) // 1000 AS BIGINT) AS partitions FROM orders
UNION ALL
SELECT 'events' AS table_name, count(*) AS row_count, CAST(1 + count(*) // 1000 AS BIGINT) AS partitions FROM events
""")
def write_sizing(spark, sf_dir):
    """Output partitions = 1 + floor(count / rows_per_partition), here 1,000 rows."""
    from .sources.tables import partition_count_frame

    return Q.stack([partition_count_frame(table(spark, sf_dir, t), t, 1000) for t in ("orders", "events")])


@register("day_parts", """
SELECT event_id, strftime(ts, '%Y') AS p_year, strftime(ts, '%m') AS p_month, strftime(ts, '%d') AS p_day FROM events
""")
def day_parts(spark, sf_dir):
    """zero-padded year, month and day text of a timestamp."""
    from .functions.clock import date_parts

    parts = date_parts("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", parts["year"].alias("p_year"), parts["month"].alias("p_month"), parts["day"].alias("p_day"))


@register("string_clean", """
SELECT doc_id,
       trim(replace(replace(replace(text, chr(10), ''), '''', ''), '`', '''')) AS text_clean,
       upper(source) AS source_upper, lower(lang) AS lang_lower, n_chars
FROM documents
""")
def string_clean(spark, sf_dir):
    """Newline removal, quote cleanup, trim, case (whole texts)."""
    from .functions import text as T

    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.trim(T.strip_quotes(T.remove_newlines("text"))).alias("text_clean"),
        T.upper("source").alias("source_upper"),
        T.lower("lang").alias("lang_lower"),
        "n_chars",
    )


# --------------------------------------------------------------------------- silver

_LATEST_SQL = "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


@register("dedupe_latest", f"SELECT * FROM events {_LATEST_SQL}")
def dedupe_latest(spark, sf_dir):
    """Latest event per user (partial group limit before the shuffle)."""
    from .operators.silver import dedupe_latest as latest

    return latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])


@register("dedupe_exact", """
SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1
""")
def dedupe_exact(spark, sf_dir):
    """Exact-duplicate documents removed, the smallest doc_id kept (whole texts compared)."""
    from .operators.silver import dedupe_exact as exact

    return exact(table(spark, sf_dir, "documents"), ["text"], "doc_id")


@register("active_flag", """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS Row_IsActive FROM events
""")
def active_flag(spark, sf_dir):
    """Every event with Row_IsActive = latest row of its user."""
    from .operators.silver import flag_active

    return flag_active(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])


@register("active_view", f"SELECT *, true AS Row_IsActive FROM events {_LATEST_SQL}")
def active_view(spark, sf_dir):
    """The active-rows view (Row_IsActive = true) over flagged events."""
    from .operators.silver import active_rows, flag_active

    return active_rows(flag_active(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]))


@register("xref", """
SELECT c_custkey, c_mktsegment, c_nationkey,
       min(c_custkey) OVER (PARTITION BY c_mktsegment, c_nationkey) AS master_key
FROM customer
""")
def xref(spark, sf_dir):
    """Customer key -> master key (smallest key of the same segment and nation)."""
    from .operators.silver import cross_reference

    return cross_reference(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], "c_custkey")


@register("match_merge", """
SELECT coalesce(c.c_nationkey, s.s_nationkey) AS nationkey,
       coalesce(c.c_custkey, s.s_suppkey) AS number,
       coalesce(c.c_name, s.s_name) AS name,
       coalesce(c.c_acctbal, s.s_acctbal) AS acctbal,
       c.c_mktsegment AS segment,
       CASE WHEN c.c_custkey IS NOT NULL AND s.s_suppkey IS NOT NULL THEN 'both'
            WHEN c.c_custkey IS NOT NULL THEN 'left' ELSE 'right' END AS _matched
FROM customer c FULL OUTER JOIN supplier s
  ON c.c_nationkey = s.s_nationkey AND c.c_custkey = s.s_suppkey
""")
def match_merge(spark, sf_dir):
    """Customers and suppliers merged into one party master by nation and number."""
    from .operators.silver import match_merge as merge

    cust = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nationkey"), F.col("c_custkey").alias("number"),
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    supp = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("nationkey"), F.col("s_suppkey").alias("number"),
        F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return merge(cust, supp, ["nationkey", "number"], prefer="left")


@register("normalise", """
SELECT DISTINCT sha256(concat(strlen(CAST(l_partkey AS VARCHAR)), ':', l_partkey, ';', strlen(CAST(l_suppkey AS VARCHAR)), ':', l_suppkey)) AS link_key,
       l_partkey, l_suppkey
FROM lineitem
""")
def normalise(spark, sf_dir):
    """Part-supplier link entity with a hashed link key (distinct, map-side partial)."""
    from .operators.silver import normalise as norm

    return norm(table(spark, sf_dir, "lineitem"), {"link": (["l_partkey", "l_suppkey"], [])})["link"]


@register("schema_on_read", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
""")
def schema_on_read(spark, sf_dir):
    """Typed column read from semi-structured text (variant path + type)."""
    from .plans.catalog import schema_on_read as sor

    return sor(table(spark, sf_dir, "events"), "props", [("k", "int")], keep=["event_id"])


# --------------------------------------------------------------------------- gold

_SALES_SQL = """
SELECT n_name,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS revenue,
       count(*) AS line_count
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name
"""


def _orders_enriched(spark, sf_dir):
    """Orders with their customer and nation (dimensions attached to the smaller fact first)."""
    from .operators.gold import Dimension, star_join as sj

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return sj(orders, [Dimension(customer, [("o_custkey", "c_custkey")]),
                       Dimension(nation, [("c_nationkey", "n_nationkey")])])


@register("star_join", """
SELECT l_orderkey, l_linenumber, o_orderdate, c_name, n_name, l_extendedprice
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
""")
def star_join(spark, sf_dir):
    """Lineitem denormalised with order, customer and nation.

    Dimensions are attached to orders first (a quarter of lineitem's rows), then
    one shuffle join of lineitem on the order key."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    enriched = _orders_enriched(spark, sf_dir)
    return li.join(enriched, li["l_orderkey"] == enriched["o_orderkey"]).select(
        "l_orderkey", "l_linenumber", "o_orderdate", "c_name", "n_name", "l_extendedprice")


def _sales_by_nation(spark, sf_dir):
    """Revenue per nation, aggregated as early as possible:
    lineitem -> per order -> per customer -> per nation.  Each step shrinks the
    rows before the next join, and each join reuses the partitioning of the
    aggregate before it."""
    from .operators.gold import cents, exact_units_sum, mart

    li = table(spark, sf_dir, "lineitem")
    # revenue of a line in 1/10000 units: cents x (100 - discount in cents)
    line_units = cents("l_extendedprice") * (F.lit(100) - cents("l_discount"))
    per_order = mart(li, ["l_orderkey"], {
        "rev": exact_units_sum(line_units, 4),
        "lines": F.count(F.lit(1)),
    })
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    per_cust = mart(per_order.join(orders, per_order["l_orderkey"] == orders["o_orderkey"]), ["o_custkey"],
                    {"rev": F.sum("rev"), "lines": F.sum("lines")})
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (per_cust.join(customer, per_cust["o_custkey"] == customer["c_custkey"])
              .join(nation, F.col("c_nationkey") == F.col("n_nationkey")))
    return mart(joined, ["n_name"], {"revenue": F.sum("rev").cast("double"),
                                     "line_count": F.sum("lines").cast("bigint")})


@register("sales_mart", _SALES_SQL)
def sales_mart(spark, sf_dir):
    """Revenue and line count per nation (exact decimal sums)."""
    return _sales_by_nation(spark, sf_dir)


@register("cross_mart", f"""
WITH s AS ({_SALES_SQL}),
p AS (SELECT n_name, count(*) AS supplier_count,
             CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS supplier_acctbal
      FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)
SELECT coalesce(s.n_name, p.n_name) AS n_name, revenue, line_count, supplier_count, supplier_acctbal
FROM s FULL OUTER JOIN p ON s.n_name = p.n_name
""")
def cross_mart(spark, sf_dir):
    """Sales mart joined with the supplier mart on the conformed nation name."""
    from .operators.gold import cross_mart as cm, mart, money

    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supp = mart(supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]), ["n_name"], {
        "supplier_count": F.count(F.lit(1)),
        "supplier_acctbal": F.sum(money("s_acctbal")).cast("double"),
    })
    return cm([_sales_by_nation(spark, sf_dir), supp], ["n_name"])


_QUALITY_RULES_SQL = {
    "value_at_least_5": "value >= 5",
    "not_error": "event_type <> 'error'",
    "props_is_object": "props LIKE '{%}'",
    "before_jan_30": "ts < TIMESTAMP '2024-01-30 00:00:00'",
}


def _quality_rules():
    return {
        "value_at_least_5": F.col("value") >= 5,
        "not_error": F.col("event_type") != "error",
        "props_is_object": F.col("props").like("{%}"),
        "before_jan_30": F.col("ts") < F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"),
    }


@register("quality_report", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS rule, count(*) FILTER (WHERE NOT coalesce({r}, false)) AS failed_rows, "
    f"count(*) AS total_rows FROM events" for n, r in _QUALITY_RULES_SQL.items()))
def quality_report(spark, sf_dir):
    """Failing-row count per data-quality rule (one global aggregate)."""
    from .operators.gold import quality_report as qr

    return qr(table(spark, sf_dir, "events"), _quality_rules())


@register("quality_rejected", "SELECT *, array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN NOT coalesce({r}, false) THEN '{n}' END" for n, r in _QUALITY_RULES_SQL.items())
    + "], lambda x: x IS NOT NULL), ',') AS failed_rules FROM events WHERE NOT (" + " AND ".join(
    f"coalesce({r}, false)" for r in _QUALITY_RULES_SQL.values()) + ")")
def quality_rejected(spark, sf_dir):
    """Quarantined rows with the names of the rules they failed (comma-joined)."""
    from .operators.gold import apply_quality

    rejected = apply_quality(table(spark, sf_dir, "events"), _quality_rules())[1]
    return rejected.withColumn("failed_rules", F.array_join("_failed_rules", ",")).drop("_failed_rules")


# --------------------------------------------------------------------------- cipher

def _cipher_params():
    """Key and IV for the registered cipher queries: hex in LAKEFORGE_RC2_KEY /
    LAKEFORGE_RC2_IV when set, else a demonstration key (never use it for data)."""
    import os

    from .functions.cipher import RC2Params

    if os.environ.get("LAKEFORGE_RC2_KEY"):
        return RC2Params.from_env("LAKEFORGE_RC2_KEY", "LAKEFORGE_RC2_IV" if os.environ.get("LAKEFORGE_RC2_IV") else None)
    return RC2Params(key=b"demo-key", iv=b"12345678")


@register("encrypt_length", """
SELECT c_custkey, CAST(4 * ceil(8 * ceil(strlen(c_name) / 8) / 3) AS INTEGER) AS cipher_len FROM customer
""")
def encrypt_length(spark, sf_dir):
    """base64 ciphertext length = 4*ceil(8*ceil(bytes/8)/3) (zero padding)."""
    from .functions.cipher import encrypt_column

    cust = table(spark, sf_dir, "customer")
    return cust.select("c_custkey", F.length(encrypt_column("c_name", _cipher_params())).alias("cipher_len"))


@register("encrypt_roundtrip", "SELECT c_custkey, c_name FROM customer")
def encrypt_roundtrip(spark, sf_dir):
    """Names encrypted to base64 and decrypted back equal the originals."""
    from .functions.cipher import decrypt_columns, encrypt_columns

    p = _cipher_params()
    enc = encrypt_columns(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_name"], p,
                          partitions=spark.sparkContext.defaultParallelism)
    return decrypt_columns(enc, ["c_name"], p)


@register("encrypt_joinable", """
SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n_distinct FROM customer GROUP BY c_nationkey
""")
def encrypt_joinable(spark, sf_dir):
    """Equal plaintexts give equal ciphertexts, so distinct counts survive encryption."""
    from .functions.cipher import encrypt_column

    cust = table(spark, sf_dir, "customer").select("c_nationkey", encrypt_column("c_mktsegment", _cipher_params()).alias("seg"))
    return cust.groupBy("c_nationkey").agg(F.countDistinct("seg").alias("n_distinct"))


@register("encrypt_documents", "SELECT doc_id, text FROM documents")
def encrypt_documents(spark, sf_dir):
    """C1-C5 on whole long texts: encrypt, decrypt, compare with the source."""
    from .functions.cipher import decrypt_columns, encrypt_columns

    p = _cipher_params()
    enc = encrypt_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], p,
                          partitions=spark.sparkContext.defaultParallelism)
    return decrypt_columns(enc, ["text"], p)


# --------------------------------------------------------------------------- publish (S9, S11-S18, M*)

APP = "sales_app"
LOAD_DAY = "2024-01-03"


def _app_frames(spark, sf_dir):
    """The tables of the application, made from ``events``:

    * ``events``: events + Row_IsActive (latest per user) + P_Year/P_Month/P_Day
    * ``metrics``: event_id and a *string* column named ``value``, day-partitioned
    * ``raw``: event_id and a JSON text column, day-partitioned
    * ``single``: one column, no day
    """
    from .operators.silver import flag_active
    from .plans.publish import with_day_partitions

    ev = table(spark, sf_dir, "events")
    return {
        "events": lambda: with_day_partitions(flag_active(ev, ["user_id"], ["ts", "event_id"]), "ts"),
        "metrics": lambda: with_day_partitions(ev.select("event_id", "ts", F.format_number("value", 2).alias("value")), "ts").drop("ts"),
        "raw": lambda: with_day_partitions(ev.select("event_id", "ts", F.col("props").alias("payload")), "ts").drop("ts"),
        "single": lambda: ev.select("event_id"),
    }


def _build_app(spark, sf_dir, tables=("events", "metrics", "single")):
    """An application database of its own, with only the tables that are asked for.

    Names and folders are new with every call, so what an earlier call returned
    stays as it is.  Returns (database, folder of the application's files).
    """
    import uuid
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    from .plans.publish import create_external_table, write_day_partitioned
    from .session import work_path
    from .sources.tables import create_database

    root = f"{work_path(spark, 'apps')}/{APP}"
    db = f"{APP}_{uuid.uuid4().hex[:12]}"
    create_database(spark, db, f"{root}.db")
    frames = _app_frames(spark, sf_dir)

    def build(t):
        if t == "single":
            frames[t]().write.parquet(f"{root}/{t}")
        else:
            write_day_partitioned(frames[t](), f"{root}/{t}")
        create_external_table(spark, f"{db}.{t}", f"{root}/{t}", None, **({"partition_cols": ()} if t == "single" else {}))

    with ThreadPoolExecutor(max_workers=len(tables)) as pool:  # independent jobs run side by side
        list(pool.map(inheritable_thread_target(spark)(build), tables))
    return db, root


def _publish(spark, sf_dir, mode, tables, loads=1, **how):
    """(warehouse database, report) of publishing an application of ``tables``."""
    import datetime as dt
    import uuid

    from .plans.publish import publish
    from .session import work_path

    app_db, _ = _build_app(spark, sf_dir, tables)
    warehouse = f"warehouse_{uuid.uuid4().hex[:12]}"
    report = None
    for _ in range(loads):
        report = publish(spark, app_db, warehouse, mode=mode, app=APP, day=dt.date.fromisoformat(LOAD_DAY),
                         target_location=work_path(spark, "warehouse.db"), **how)
    return warehouse, report


def _published(spark, sf_dir, mode, t, loads=1, **how):
    """The name of a published table."""
    from .plans.publish import published_table_name

    return published_table_name(_publish(spark, sf_dir, mode, (t,), loads, **how)[0], APP, t)


_FLAGGED_EVENTS_SQL = """
SELECT e.*, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS Row_IsActive,
       strftime(ts, '%Y') AS P_Year, strftime(ts, '%m') AS P_Month, strftime(ts, '%d') AS P_Day
FROM events e"""


@register("day_load", f"SELECT * FROM ({_FLAGGED_EVENTS_SQL}) WHERE P_Year || P_Month || P_Day = '20240103'")
def day_load(spark, sf_dir):
    """Internal publish loads one day (2024-01-03) into a new table."""
    return spark.table(_published(spark, sf_dir, "internal", "events"))


@register("day_load_twice", f"SELECT * FROM ({_FLAGGED_EVENTS_SQL}) WHERE P_Year || P_Month || P_Day = '20240103'")
def day_load_twice(spark, sf_dir):
    """Loading the same day twice leaves one copy (the partition is overwritten)."""
    return spark.table(_published(spark, sf_dir, "internal", "events", loads=2))


@register("day_load_metrics", """
SELECT event_id, format('{:,.2f}', value) AS raw_value,
       strftime(ts, '%Y') AS P_Year, strftime(ts, '%m') AS P_Month, strftime(ts, '%d') AS P_Day
FROM events WHERE strftime(ts, '%Y%m%d') = '20240103'
""")
def day_load_metrics(spark, sf_dir):
    """The string column ``value`` is published as ``raw_value``."""
    return spark.table(_published(spark, sf_dir, "internal", "metrics"))


@register("day_reload_empty", """
SELECT event_id, format('{:,.2f}', value) AS raw_value,
       strftime(ts, '%Y') AS P_Year, strftime(ts, '%m') AS P_Month, strftime(ts, '%d') AS P_Day
FROM events WHERE strftime(ts, '%Y%m%d') IN ('20240104', '20240106')
""")
def day_reload_empty(spark, sf_dir):
    """Days 3 to 6 are loaded; day 3, then days 5 and 6, are loaded again from a source
    that has lost days 3 and 5, and are empty."""
    import datetime as dt

    from .plans.publish import load_day

    name = _published(spark, sf_dir, "internal", "metrics")
    source = _app_frames(spark, sf_dir)["metrics"]()
    days = [dt.date(2024, 1, d) for d in (3, 4, 5, 6)]
    load_day(spark, source, name, days)
    left = source.where(~F.col("P_Day").isin("03", "05"))
    load_day(spark, left, name, days[0])
    load_day(spark, left, name, days[2:])
    return spark.table(name)


@register("publish_undated", "SELECT event_id FROM events")
def publish_undated(spark, sf_dir):
    """A table without day columns is published whole, and again, once."""
    return spark.table(_published(spark, sf_dir, "internal", "single", loads=2))


@register("external_table", _FLAGGED_EVENTS_SQL)
def external_table(spark, sf_dir):
    """External publish over the application files, partitions repaired."""
    return spark.table(_published(spark, sf_dir, "external", "events"))


@register("external_metrics", """
SELECT event_id, format('{:,.2f}', value) AS raw_value,
       strftime(ts, '%Y') AS P_Year, strftime(ts, '%m') AS P_Month, strftime(ts, '%d') AS P_Day
FROM events
""")
def external_metrics(spark, sf_dir):
    """An external table without a flag publishes ``value`` as ``raw_value`` too."""
    return spark.table(_published(spark, sf_dir, "external", "metrics"))


@register("publish_on_read", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       strftime(ts, '%Y') AS P_Year, strftime(ts, '%m') AS P_Month, strftime(ts, '%d') AS P_Day
FROM events
""")
def publish_on_read(spark, sf_dir):
    """An external table of JSON text published with typed columns read out of it."""
    return spark.table(_published(spark, sf_dir, "external", "raw", on_read={"raw": ("payload", [("k", "int")])}))


@register("published_view", f"SELECT * FROM ({_FLAGGED_EVENTS_SQL}) WHERE Row_IsActive")
def published_view(spark, sf_dir):
    """The published active-rows view over the external table."""
    from .plans.publish import VIEW_SUFFIX

    return spark.table(_published(spark, sf_dir, "external", "events") + VIEW_SUFFIX)


@register("remove_published", """
SELECT count(*) AS published_rows, count(*) FILTER (WHERE strftime(ts, '%Y%m%d') = '20240103') AS loaded_rows,
       0 AS tables_left, 0 AS files_left, true AS source_kept FROM events
""")
def remove_published(spark, sf_dir):
    """An external publish is removed and its source files stay; an internal one is removed with its data."""
    from .plans.publish import published_table_name, remove_objects
    from .session import hadoop_fs
    from .sources.tables import table_location

    outside, _ = _publish(spark, sf_dir, "external", ("events",))
    inside, _ = _publish(spark, sf_dir, "internal", ("events",))
    names = [published_table_name(db, APP, "events") for db in (outside, inside)]
    rows = [spark.table(n).count() for n in names]
    places = [table_location(spark, n) for n in names]
    remove_objects(spark, names[0])
    remove_objects(spark, names[1], delete_data=True)
    left = sum(t.name.startswith(APP) for db in (outside, inside) for t in spark.catalog.listTables(db))
    fs, path = hadoop_fs(spark, places[1])
    kept = spark.read.parquet(places[0])
    return kept.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(rows[0]).cast("long").alias("published_rows"), F.lit(rows[1]).cast("long").alias("loaded_rows"), F.lit(left).alias("tables_left"),
        F.lit(int(fs.exists(path))).alias("files_left"), (F.col("n") == rows[0]).alias("source_kept"))


_DDL_TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@register("column_ddl", f"""
SELECT upper('warehouse.shared.sales_app_' || table_name) AS table_name,
       '(' || string_agg(CASE WHEN column_name = 'value' AND data_type = 'VARCHAR' THEN 'raw_value' ELSE column_name END || ' ' ||
         CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
                        WHEN 'TIMESTAMP_NS' THEN 'timestamp_ntz' ELSE lower(data_type) END, ', ' ORDER BY column_index) || ')' AS column_ddl_text,
       CAST(count(*) AS INTEGER) AS n_columns, '/internal/sales_app/' || table_name || '/' AS rel_path
FROM duckdb_columns()
WHERE table_name IN ({", ".join(f"'{t}'" for t in _DDL_TABLES)}) AND column_name <> 'n_chars'
GROUP BY table_name
""")
def column_ddl(spark, sf_dir):
    """Catalog walk over an application with the given tables' schemas -> column
    clauses in order per table, published name, relative path; one column and the day columns
    excluded by name.  The tables are declared, no data moves."""
    import uuid

    from .plans.catalog import DAY_PARTITION_COLUMNS, column_metadata, exclude_columns, gather_columns, published_name, relative_path
    from .plans.publish import create_external_table
    from .session import hadoop_fs, work_path
    from .sources.tables import create_database, quote_ident

    root = f"{work_path(spark, 'apps')}/{APP}"
    db = f"{APP}_{uuid.uuid4().hex[:12]}"
    create_database(spark, db, f"{root}.db")
    for t in _DDL_TABLES:
        fs, path = hadoop_fs(spark, f"{root}/{t}")
        fs.mkdirs(path)
        columns = [f"{quote_ident(f.name)} {f.dataType.simpleString()}" for f in table(spark, sf_dir, t).schema.fields]
        create_external_table(spark, f"{db}.{t}", f"{root}/{t}", columns)
    meta = exclude_columns(column_metadata(spark, db), ["", "n_chars", *DAY_PARTITION_COLUMNS])
    return gather_columns(meta).select(published_name("warehouse", "shared", APP).alias("table_name"), "column_ddl_text",
                                       "n_columns", relative_path(F.col("location"), APP).alias("rel_path"))


@register("list_files", """
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS row_count, true AS all_listed FROM events GROUP BY 1
""")
def list_files(spark, sf_dir):
    """The listing of the day-partitioned application files, joined to the rows read from
    each: rows per listed day, and whether every file that has rows is listed with its size."""
    from .sources.files import list_files as lf, read_with_source

    _, root = _build_app(spark, sf_dir, ("metrics",))
    rows = read_with_source(spark, f"{root}/metrics").groupBy("_source_path").agg(F.count(F.lit(1)).alias("n"))
    # one spelling of a local path's scheme on both sides
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    files = lf(spark, f"{root}/metrics").select(plain("path").alias("path"), "length")
    both = rows.select(plain("_source_path").alias("path"), "n").join(files, "path", "left")
    day = F.concat_ws("-", *[F.regexp_extract("path", f"{c}=([0-9]+)", 1) for c in ("P_Year", "P_Month", "P_Day")])
    return both.groupBy(day.alias("day")).agg(F.sum("n").alias("row_count"), F.min(F.coalesce(F.col("length") > 0, F.lit(False))).alias("all_listed"))


@register("write_sized_files", """
SELECT 1 + count(*) // 1000 AS files, count(*) AS row_count, true AS all_within FROM events
""")
def write_sized_files(spark, sf_dir):
    """Events written 1,000 rows to a file; the files as read back."""
    from .session import work_path
    from .sources.files import read_with_source
    from .sources.tables import write_sized

    path = work_path(spark, "sized")
    write_sized(table(spark, sf_dir, "events"), path, rows_per_file=1000)
    per_file = read_with_source(spark, path).groupBy("_source_path").agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("row_count"), (F.max("n") <= 1000).alias("all_within"))


@register("table_lifecycle", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, false AS dropped_left, true AS second_write_refused FROM customer
""")
def table_lifecycle(spark, sf_dir):
    """A database is selected; a table is written, written again (refused), re-created
    with other rows, scanned; another table is dropped."""
    import uuid

    from pyspark.errors import AnalysisException

    from .session import work_path
    from .sources.tables import create_database, drop_table, read_table, save_table, use_database

    db = f"lifecycle_{uuid.uuid4().hex[:12]}"
    create_database(spark, db, work_path(spark, f"{db}.db"))
    customer = table(spark, sf_dir, "customer")
    before = spark.catalog.currentDatabase()
    use_database(spark, db)
    try:
        save_table(customer.where("c_nationkey < 10"), "party")
        save_table(customer.select("c_custkey"), "gone")
        refused = False
        try:
            save_table(customer, "party")
        except AnalysisException:
            refused = True
        save_table(customer, "party", replace=True)
        drop_table(spark, "gone")
        left = spark.catalog.tableExists(f"{db}.gone")
        return read_table(spark, f"{db}.party").withColumn("dropped_left", F.lit(left)).withColumn("second_write_refused", F.lit(refused))
    finally:
        use_database(spark, before)


# --------------------------------------------------------------------------- bronze

RUN_TS = "2024-02-01 00:00:00"


def _landed(spark, sf_dir, run_id="run-0001", run_ts=RUN_TS, path=None):
    from .operators.bronze import archive, with_load_metadata
    from .session import work_path

    path = path or work_path(spark, "bronze/events")
    archive(with_load_metadata(table(spark, sf_dir, "events"), run_id, run_ts), path)
    return path


@register("land_with_metadata", """
SELECT *, TIMESTAMP '2024-02-01 00:00:00' AS _load_ts, 'run-0001' AS _run_id,
       'events.parquet' AS _source_file, '2024-02-01' AS _load_day FROM events
""")
def land_with_metadata(spark, sf_dir):
    """L1, L2, L4: events landed as-is with load time, run id, source file, load day."""
    return spark.read.parquet(_landed(spark, sf_dir))


@register("load_audit", """
SELECT 'run-0001' AS _run_id, 'events.parquet' AS _source_file, '2024-02-01' AS _load_day,
       strftime(ts, '%Y-%m-%d') AS event_day, count(*) AS row_count, TIMESTAMP '2024-02-01 00:00:00' AS loaded_at,
       min(ts) AS min_event_ts, max(ts) AS max_event_ts
FROM events GROUP BY strftime(ts, '%Y-%m-%d')
""")
def load_audit(spark, sf_dir):
    """Rows, load time and event-time range per run, source file and event day."""
    from .operators.bronze import load_audit as audit

    landed = spark.read.parquet(_landed(spark, sf_dir))
    return audit(landed, "ts", by=[F.date_format("ts", "yyyy-MM-dd").alias("event_day")])


@register("replay", "SELECT *, 'run-0002' AS _run_id FROM events")
def replay(spark, sf_dir):
    """Two runs archived by load day; replay the second day only (partition-pruned)."""
    from .operators.bronze import replay as rp

    path = _landed(spark, sf_dir, "run-0001", "2024-02-01 00:00:00")
    _landed(spark, sf_dir, "run-0002", "2024-02-02 06:00:00", path=path)
    got = rp(spark, path, days=["2024-02-02"])
    return got.drop("_load_ts", "_source_file", "_load_day")


@register("land_incremental", "SELECT *, 'stream-0001' AS _run_id FROM events")
def land_incremental(spark, sf_dir):
    """L3: files landed by a stream with availableNow; the second run finds nothing new."""
    from .session import work_path
    from .streaming.ingest import land_incremental as li

    base = work_path(spark, "stream")
    ev = table(spark, sf_dir, "events")
    ev.write.mode("overwrite").parquet(f"{base}/landing")
    for run in ("stream-0001", "stream-0002"):
        li(spark, f"{base}/landing", ev.schema, f"{base}/bronze", f"{base}/_checkpoint", run)
    return spark.read.parquet(f"{base}/bronze").drop("_load_ts", "_source_file", "_load_day")


# --------------------------------------------------------------------------- more pairs

@register("sample_show", """
SELECT * FROM (SELECT DISTINCT * FROM orders WHERE o_orderstatus != 'F' AND o_orderdate > '1997-01-01')
ORDER BY o_totalprice DESC, o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority LIMIT 20
""")
def sample_show(spark, sf_dir):
    """The 20 rows ``show()`` prints for the sample-job query (a top-k report)."""
    from .sources.tables import preview

    return preview(filter_distinct_sort(spark, sf_dir), 20)


@register("conform", """
SELECT c_custkey, trim(regexp_replace(c_name, '\\s+', ' ', 'g')) AS name, c_nationkey AS nationkey,
       CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DOUBLE) AS acctbal,
       array_to_string(list_transform(string_split(lower(c_mktsegment), ' '),
                                      lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS segment
FROM customer
""")
def conform(spark, sf_dir):
    """Renames, whitespace cleanup, title case, typed amounts, in one projection."""
    from .operators.silver import ConformRules, conform as cf

    rules = ConformRules(renames={"c_name": "name", "c_nationkey": "nationkey", "c_acctbal": "acctbal",
                                  "c_mktsegment": "segment"},
                         trim=["name"], title=["segment"], casts={"acctbal": "decimal(12,2)"})
    out = cf(table(spark, sf_dir, "customer"), rules)
    return out.withColumn("acctbal", F.col("acctbal").cast("double"))  # reported as double


@register("encrypt_options", "SELECT c_custkey, c_name, CAST(8 * (strlen(c_name) // 8 + 1) AS INTEGER) AS cipher_bytes FROM customer")
def encrypt_options(spark, sf_dir):
    """ECB mode with PKCS5 padding; 8*(floor(n/8)+1) cipher bytes, and back."""
    from .functions.cipher import RC2Params, decrypt_column, encrypt_udf

    p = _cipher_params()
    ecb = RC2Params(p.key, None, "ECB", "pkcs5")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name").repartition(spark.sparkContext.defaultParallelism)
    enc = cust.select("c_custkey", F.base64(encrypt_udf(ecb)("c_name")).alias("cipher"))
    return enc.select("c_custkey", decrypt_column("cipher", ecb, as_text=True).alias("c_name"),
                      F.length(F.unbase64("cipher")).alias("cipher_bytes"))


@register("base64_text", """
SELECT doc_id, base64(encode(text)) AS text_b64, octet_length(encode(text)) AS n_bytes FROM documents
""")
def base64_text(spark, sf_dir):
    """Whole texts as UTF-8 bytes and one-line base64 (no line breaks)."""
    from .functions import text as T

    docs = table(spark, sf_dir, "documents")
    raw = T.to_utf8("text")
    return docs.select("doc_id", T.b64encode(raw).alias("text_b64"), F.octet_length(raw).alias("n_bytes"))


@register("publish_report", """
WITH n AS (SELECT count(*) AS total, count(*) FILTER (WHERE strftime(ts, '%Y%m%d') = '20240103') AS loaded FROM events),
a AS (SELECT count(*) AS active FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
      WHERE strftime(ts, '%Y%m%d') = '20240103')
SELECT * FROM (
  SELECT 'events' AS "table", 'create_internal_table' AS step, 'sales_app_events' AS object, loaded AS row_count FROM n
  UNION ALL SELECT 'events', 'load_day', 'sales_app_events@2024-01-03', loaded FROM n
  UNION ALL SELECT 'events', 'create_view', 'sales_app_events_v', active FROM a
  UNION ALL SELECT 'metrics', 'create_internal_table', 'sales_app_metrics', loaded FROM n
  UNION ALL SELECT 'metrics', 'load_day', 'sales_app_metrics@2024-01-03', loaded FROM n
  UNION ALL SELECT 'single', 'create_internal_table', 'sales_app_single', total FROM n
  UNION ALL SELECT 'single', 'load_whole', 'sales_app_single', total FROM n)
""")
def publish_report(spark, sf_dir):
    """The steps of an internal publish of each application table, with the rows that the
    step's object holds afterwards (views only where an active flag exists, day loads only for
    day-partitioned tables)."""
    warehouse, report = _publish(spark, sf_dir, "internal", ("events", "metrics", "single"))
    names = {r.object.split("@")[0] for r in report.select("object").collect()}  # catalog-sized
    counts = Q.stack([spark.table(n).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("name"), "row_count") for n in sorted(names)])
    return report.join(counts, F.substring_index("object", "@", 1) == F.col("name")).select(
        "table", "step", F.replace("object", F.lit(f"{warehouse}."), F.lit("")).alias("object"), "row_count")


@register("quality_passed", "SELECT * FROM events WHERE " + " AND ".join(
    f"coalesce({r}, false)" for r in _QUALITY_RULES_SQL.values()))
def quality_passed(spark, sf_dir):
    """The rows that meet every rule (a plain conjunction, pushed to the scan)."""
    from .operators.gold import apply_quality

    return apply_quality(table(spark, sf_dir, "events"), _quality_rules())[0]


# --------------------------------------------------------------------------- ties, repeats and the run clock

@register("archive_two_runs", """
SELECT event_id, 'run-a' AS _run_id, 1 AS copies FROM events UNION ALL
SELECT event_id, 'run-b' AS _run_id, 1 AS copies FROM events
""")
def archive_two_runs(spark, sf_dir):
    """L4: two runs on one day, one of them retried; each row of each run is archived once."""
    path = _landed(spark, sf_dir, "run-a")
    _landed(spark, sf_dir, "run-b", path=path)
    _landed(spark, sf_dir, "run-a", path=path)
    return spark.read.parquet(path).groupBy("event_id", "_run_id").agg(F.count(F.lit(1)).cast("int").alias("copies"))


@register("active_flag_ties", "SELECT user_id, 2 * count(*) AS n_rows, 1 AS n_active FROM events GROUP BY user_id")
def active_flag_ties(spark, sf_dir):
    """A load that is doubled still has one active row per user."""
    from .operators.silver import flag_active

    ev = table(spark, sf_dir, "events")
    flagged = flag_active(Q.stack([ev, ev]), ["user_id"], ["ts"])
    return flagged.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("Row_IsActive").cast("int").alias("n_active"))


@register("match_merge_duplicates", ORACLE_SQL["match_merge"])
def match_merge_duplicates(spark, sf_dir):
    """Sources that repeat their keys still give one master row per key."""
    from .operators.silver import match_merge as merge

    cust = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nationkey"), F.col("c_custkey").alias("number"),
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    supp = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("nationkey"), F.col("s_suppkey").alias("number"),
        F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    worse = cust.withColumn("name", F.concat("name", F.lit("~")))
    return merge(Q.stack([cust, worse, cust]), Q.stack([supp, supp]), ["nationkey", "number"], prefer="left")


@register("first_order", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def first_order(spark, sf_dir):
    """The first row of an ordered table."""
    return Q.first_row(table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), F.col("o_orderkey")))


@register("status_names", """
SELECT o_orderkey, name FROM orders JOIN (VALUES ('F', 'finished'), ('O', 'open'), ('P', 'in process')) AS n(status, name) ON o_orderstatus = status
""")
def status_names(spark, sf_dir):
    """Rows with an explicit schema, joined to orders as a lookup."""
    from .sources.tables import from_rows

    names = from_rows(spark, [("F", "finished"), ("O", "open"), ("P", "in process")], "status string, name string")
    orders = table(spark, sf_dir, "orders")
    return orders.join(names, orders["o_orderstatus"] == names["status"]).select("o_orderkey", "name")


@register("run_clock", """
SELECT event_id, CAST(ts AS DATE) - 1 AS day_before, CAST(ts AS DATE) + 2 AS two_days_after,
       CAST(second(ts) AS INTEGER) AS second, CAST(minute(ts) AS INTEGER) AS minute, CAST(hour(ts) AS INTEGER) AS hour, CAST(day(ts) AS INTEGER) AS day,
       CAST(month(ts) AS VARCHAR) AS month, CAST(year(ts) AS INTEGER) AS year
FROM events
""")
def run_clock(spark, sf_dir):
    """processing date and run-clock parts, each event's time as the run's."""
    from .functions.clock import clock_parts, processing_date

    ev = table(spark, sf_dir, "events")
    parts = clock_parts(F.col("ts"))
    return ev.select("event_id", processing_date(-1, F.col("ts").cast("date")).alias("day_before"),
                     processing_date(2, F.col("ts").cast("date")).alias("two_days_after"), *[c.alias(n) for n, c in parts.items()])


from . import layer_queries  # noqa: E402, F401  (registers its queries)

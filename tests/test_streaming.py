from lakeforge.streaming.ingest import land_incremental

from .conftest import SF_SMALL
from .helpers import scratch


def test_incremental_landing_twice_then_new_file(spark):
    base = scratch()
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ev.write.mode("overwrite").parquet(f"{base}/landing")
    for run in ("s1", "s2"):
        land_incremental(spark, f"{base}/landing", ev.schema, f"{base}/bronze", f"{base}/ckpt", run)
    out = spark.read.parquet(f"{base}/bronze")
    assert out.count() == ev.count()
    assert {r._run_id for r in out.select("_run_id").distinct().collect()} == {"s1"}
    ev.limit(10).write.mode("append").parquet(f"{base}/landing")  # a new file arrives
    land_incremental(spark, f"{base}/landing", ev.schema, f"{base}/bronze", f"{base}/ckpt", "s3")
    out = spark.read.parquet(f"{base}/bronze")
    assert out.count() == ev.count() + 10
    assert out.where("_run_id = 's3'").count() == 10
    assert out.where("_source_file NOT LIKE '%.parquet'").count() == 0

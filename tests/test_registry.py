"""Every registered query against its DuckDB oracle on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from lakeforge import registry
from tools.check_oracle import TABLES, rows_of

from .conftest import SF_SMALL

QUERIES = registry.QUERIES
ORACLES = registry.ORACLE_SQL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    assert df.count() >= 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(res.columns)
    assert rows_of(df.columns, srows, 9) == rows_of(res.columns, res.fetchall(), 9)


def test_publish_queries_survive_a_new_session_on_the_same_shared_folder():
    """The catalog lives per session, the shared folder does not: a second
    process must publish again without tripping over the first one's files."""
    import os
    import subprocess
    import sys

    from .helpers import scratch

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shared = scratch() + "/shared"
    script = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "spark = (SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        ".config('spark.checkpoint.dir', %r).getOrCreate())\n"
        "import __spark_entry__ as E\n"
        "print(E.queries()['day_load'](spark, %r).count())\n" % (root, shared, SF_SMALL)
    )
    counts = []
    for _ in range(2):
        out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=600)
        assert out.returncode == 0, out.stderr[-2000:]
        counts.append(int(out.stdout.strip().splitlines()[-1]))
    assert counts[0] == counts[1] > 0

import tempfile


def scratch(prefix="lakeforge-test-"):
    """A fresh scratch folder per call (never reused, never cleared)."""
    return tempfile.mkdtemp(prefix=prefix)


def plan_text(df):
    """Executed plan text with scan metadata (pushed filters, schema) not truncated."""
    spark = df.sparkSession
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)

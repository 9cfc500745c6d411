import datetime as dt

from pyspark.sql import functions as F

from lakeforge.functions import clock, text
from lakeforge.functions.paths import with_path_parts

from .helpers import plan_text

# (path, file_name, file_date, year, month, day)
PATHS = [
    ("dbfs:/mnt/z/app/2021/04/03/P_12345_file.csv", "P_12345_file.csv", "20210403", "2021", "04", "03"),
    ("/a/2020/01/02/b/2021/04/03/f_20210403.csv", "f_20210403.csv", "20200102", "2020", "01", "02"),
    ("/abc123/2021/04/03/f.csv", "f.csv", "12320210", "1232", "02", "10"),
    ("/nodate/f.csv", "/nodate/f.csv", "", "", "", ""),
    ("/P_99999/2021/04/03/q.csv", "q.csv", "20210403", "2021", "04", "03"),
    (None, None, None, None, None, None),
]


def test_path_parts(spark):
    df = spark.createDataFrame([(p[0],) for p in PATHS], "path string")
    got = [tuple(r) for r in with_path_parts(df, "path").collect()]
    assert got == [tuple(p) for p in PATHS]


def test_path_parts_are_native(spark):
    df = with_path_parts(spark.createDataFrame([(p[0],) for p in PATHS], "path string"), "path")
    text_ = plan_text(df)
    assert "PythonUDF" not in text_ and "BatchEvalPython" not in text_ and "ArrowEvalPython" not in text_


def test_file_name_idempotent(spark):
    from lakeforge.functions.paths import file_name

    df = spark.createDataFrame([(p[0],) for p in PATHS], "path string")
    once = df.select(file_name("path").alias("p"))
    twice = once.select(file_name("p").alias("p"))
    assert once.collect() == twice.collect()


def test_clock_functions(spark):
    row = spark.range(1).select(
        clock.processing_date(-1, dt.date(2024, 1, 1)).alias("yesterday"),
        clock.processing_date(1, "2024-02-28").alias("tomorrow"),
        *[v.alias(k) for k, v in clock.date_parts(F.lit(dt.date(2024, 3, 5))).items()],
        *[v.alias("c_" + k) for k, v in clock.clock_parts(F.lit(dt.datetime(2024, 3, 5, 7, 8, 9))).items()],
    ).first()
    assert row.yesterday == dt.date(2023, 12, 31) and row.tomorrow == dt.date(2024, 2, 29)
    assert (row.year, row.month, row.day) == ("2024", "03", "05")
    assert (row.c_second, row.c_minute, row.c_hour, row.c_day, row.c_month, row.c_year) == (9, 8, 7, 5, "3", 2024)
    assert clock.day_parts_python(dt.date(2024, 3, 5)) == ("2024", "03", "05")


def test_text_helpers(spark):
    df = spark.createDataFrame([("it's `quoted`\nline  two ", "hello wORLD")], "a string, b string")
    r = df.select(text.strip_quotes("a").alias("q"), text.remove_newlines("a").alias("n"),
                  text.title("b").alias("t"), text.upper("b").alias("u"),
                  text.lower("b").alias("l"), text.to_utf8("b").alias("rt"),
                  text.b64decode(text.b64encode(text.to_utf8("b"))).alias("b64")).first()
    assert r.q == "its 'quoted'\nline  two "
    assert r.n == "it's `quoted`line  two "
    assert (r.t, r.u, r.l, bytes(r.rt)) == ("Hello World", "HELLO WORLD", "hello world", b"hello wORLD")
    assert bytes(r.b64) == b"hello wORLD"


def test_file_name_matches_python_regex_on_odd_paths(spark):
    import re

    odd = ["a/2021/01/01/x\nb/2022/02/02/y", "no/date\n/2020/10/10/z", "2021/01/01/", "x/2021/01/01/2022/02/02/f",
           "/2021/1/01/f", "\n\n/1999/12/31/end", "12345/2021/04/03/P_00001_n.csv"]
    df = spark.createDataFrame([(p,) for p in odd], "path string")
    from lakeforge.functions.paths import file_date, file_name

    got = [tuple(r) for r in df.select(file_name("path"), file_date("path")).collect()]
    want = [(re.sub(r".*[0-9]{4}/[0-9]{2}/[0-9]{2}/", "", p), re.sub(r"P_[0-9]{5}|[^0-9]", "", p)[:8]) for p in odd]
    assert got == want

import os

import pytest

from lakeforge.sources import files as FS
from lakeforge.sources import tables as T

from .helpers import plan_text, scratch


@pytest.fixture(scope="module")
def tree():
    root = scratch()
    for rel, content in [("x.csv", "1"), ("a/y.csv", "2"), ("a/b/z.csv", "3"), ("a/b/_delta_log/0.json", "{}"),
                         (".hid", "h"), ("a/empty", "")]:
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as f:
            f.write(content)
    return root


def _names(df, root):
    return sorted(r.path.split(root, 1)[1].lstrip("/") for r in df.collect())


ALL = [".hid", "a/b/_delta_log/0.json", "a/b/z.csv", "a/empty", "a/y.csv", "x.csv"]


@pytest.mark.parametrize("batch", [2, 3, 50_000])
def test_list_files_is_complete(spark, tree, monkeypatch, batch):
    monkeypatch.setattr(FS, "BATCH", batch)
    df = FS.list_files(spark, tree)
    assert df.columns == ["path", "length", "modificationTime"]
    assert _names(df, tree) == ALL
    assert {r.path.rsplit("/", 1)[1]: r.length for r in df.collect()}["empty"] == 0


def test_partition_count(spark):
    df = spark.range(2500)
    assert T.partition_count(df, 1000) == 3
    assert T.partition_count(spark.range(1000), 1000) == 2  # exact multiple: one extra
    assert T.partition_count(spark.range(0), 1000) == 1
    row = T.partition_count_frame(df, "r", 1000).first()
    assert (row.table_name, row.row_count, row.partitions) == ("r", 2500, 3)


def test_write_sized(spark):
    path = scratch() + "/sized"
    T.write_sized(spark.range(2500).repartition(1), path, rows_per_file=1000)
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert len(files) == 3 and spark.read.parquet(path).count() == 2500
    T.write_sized(spark.range(2500, numPartitions=60), path, rows_per_file=1000)  # many small tasks don't leave many files
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 3 and spark.read.parquet(path).distinct().count() == 2500


def test_drop_table_and_data(spark):
    root = scratch()
    T.create_database(spark, "cleanup_db", root + "/cleanup_db")
    spark.range(5).write.parquet(root + "/ext")
    spark.sql(f"CREATE TABLE cleanup_db.ext USING parquet LOCATION '{root}/ext'")
    assert T.table_location(spark, "cleanup_db.ext").endswith("/ext")
    spark.sql("DROP TABLE cleanup_db.ext")
    assert os.path.exists(root + "/ext")  # dropping an external table keeps its files
    spark.sql(f"CREATE TABLE cleanup_db.ext USING parquet LOCATION '{root}/ext'")
    loc = T.drop_table_and_data(spark, "cleanup_db.ext")
    assert loc and not spark.catalog.tableExists("cleanup_db.ext") and not os.path.exists(root + "/ext")
    assert T.drop_table_and_data(spark, "cleanup_db.ext") is None


def test_read_with_source(spark):
    path = scratch() + "/src"
    spark.range(3).write.parquet(path)
    rows = FS.read_with_source(spark, path).collect()
    assert all(r._source_path.endswith(".parquet") for r in rows)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    """Without spark.checkpoint.dir only a local session makes a folder of its own."""
    from lakeforge import session

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, key, default=None):
            return default

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_root(Session())


def test_ship_package(spark):
    from lakeforge.session import ship_package

    path = ship_package(spark)
    assert path.endswith("lakeforge.zip")
    import zipfile
    local = path.replace("file:", "")
    names = zipfile.ZipFile(local).namelist()
    assert "lakeforge/functions/cipher.py" in names and "lakeforge/__init__.py" in names

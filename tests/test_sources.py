import pytest
from pyspark.sql import functions as F

from tablewright import append_batch, jdbc_options, read_batches, read_table, remove_unpublished, write_table
from tablewright.session import new_path, shared_dir
from tablewright.sources import batches

from .fixtures import edge, rows


def test_write_and_read(spark, tmp_path):
    path = str(tmp_path / "t")
    df = edge(spark).where("k IS NOT NULL")
    write_table(df, path)
    write_table(df, path)
    assert rows(read_table(spark, "parquet", path)) == rows(df.union(df))
    write_table(df, path, "parquet", "overwrite")
    assert read_table(spark, "parquet", path).count() == df.count()
    write_table(df.select("k", "n"), str(tmp_path / "c"), "csv", header=True)
    back = read_table(spark, "csv", str(tmp_path / "c"), "k string, n bigint", header=True)
    assert rows(back) == rows(df.select("k", "n"))


def test_jdbc_options():
    url = "jdbc:postgresql://h/db"
    got = jdbc_options(url, query="SELECT 1", user="u")
    assert got == {"url": url, "fetchsize": "10000", "user": "u", "query": "SELECT 1"}
    parts = {"column": "id", "lower": 0, "upper": 1000, "n": 16}
    got = jdbc_options(url, query="SELECT * FROM t", partition=parts)
    assert got["dbtable"] == "(SELECT * FROM t) part_source" and got["numPartitions"] == "16" and "query" not in got
    assert jdbc_options(url, table="s.t")["dbtable"] == "s.t"
    with pytest.raises(ValueError):
        jdbc_options(url)
    with pytest.raises(ValueError):
        jdbc_options(url, query="SELECT 1", table="t")


def test_intermediate_tables_use_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_dir(spark) == named.rstrip("/")
    assert new_path(spark, "x").startswith(shared_dir(spark) + "/tablewright-x-")


def test_batches_are_added_once(spark, tmp_path):
    path, df = str(tmp_path / "t"), edge(spark)
    with pytest.raises(ValueError):
        read_batches(spark, path)
    assert read_batches(spark, path, schema=df.schema).count() == 0
    names = ["day 1/2", "", "%", "é"]
    assert all(append_batch(df.where("n = 2"), path, name) for name in names)
    assert not any(append_batch(df, path, name) for name in names)
    assert rows(read_batches(spark, path)) == rows(df.where("n = 2").union(df.where("n = 2")).union(df.where("n = 2")).union(df.where("n = 2")))
    assert append_batch(df.where("false"), path, "nothing")
    assert read_batches(spark, path).count() == 8


def test_broken_batches_are_not_seen(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(0, 1000, 1, 4)
    broken = df.select(F.when(F.col("id") < 990, F.col("id")).otherwise(F.raise_error(F.lit("broken off")).cast("bigint")).alias("id"))
    with pytest.raises(Exception, match="broken off"):
        append_batch(broken, path, "a")
    assert append_batch(df, path, "a") and read_batches(spark, path).count() == 1000
    assert len(list((tmp_path / "t" / batches.STAGED).iterdir())) == 2
    assert remove_unpublished(spark, path) == 0
    assert remove_unpublished(spark, path, 0) == 1
    assert read_batches(spark, path).count() == 1000


def test_second_writer_adds_nothing(spark, tmp_path, monkeypatch):
    """Both find the batch absent; the one that comes second to the manifest gives way."""
    path, df = str(tmp_path / "t"), spark.range(10)
    assert append_batch(df, path, "a")
    monkeypatch.setattr(batches, "is_published", lambda *_: False)
    assert not append_batch(df, path, "a")
    assert read_batches(spark, path).count() == 10
    assert remove_unpublished(spark, path, 0) == 0


def test_formats(spark, tmp_path):
    df = spark.range(5)
    assert append_batch(df, str(tmp_path), "a", "json", compression="gzip")
    assert rows(read_batches(spark, str(tmp_path), "json", df.schema)) == rows(df)

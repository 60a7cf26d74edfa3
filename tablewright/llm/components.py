"""Connected components of a table of links, by alternating large and small stars.

Each round rewires every link to the smallest neighbour of its end points; the number of
links never grows, and the rounds are logarithmic in the length of the longest chain.  A
round's links are written to the shared folder, which cuts the lineage.  A node with very
many neighbours costs a partial minimum per task and a join that adaptive execution splits;
its neighbours are never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import delete_path, materialize, new_path


def _large_star(links: DataFrame) -> DataFrame:
    """Of each node, its larger neighbours point to its smallest neighbour or itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Of each node, its smaller neighbours and itself point to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a")
    return near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def _clean(links: DataFrame) -> DataFrame:
    return links.where("a <> b").distinct()


def _print(links: DataFrame):
    """Number of the links and a digest of their set: one row."""
    return links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()


def component_roots(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that is linked to another; root is the smallest node of
    its component.  Node ids are bigints; links have any direction, repeats and loops."""
    spark = links.sparkSession
    now = materialize(_clean(links.select(F.col(a).alias("a"), F.col(b).alias("b"))), "links")
    seen = _print(now)
    while seen[0]:
        path = new_path(spark, "links")
        _clean(_small_star(_clean(_large_star(now)))).write.parquet(path)
        after, before = spark.read.schema(now.schema).parquet(path), now
        got = _print(after)
        now = after
        for old in before.inputFiles()[:1]:  # a round's links are read by the next round only
            delete_path(spark, old.rsplit("/", 1)[0])
        if got == seen:
            break
        seen = got
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))

"""The digest index over several batches, and odd rows."""

from pyspark.sql import functions as F

from tablewright.llm.exact_dedup import DigestIndex, drop_copies, find_copies
from tablewright.session import new_path


def index(spark):
    return DigestIndex(spark, new_path(spark, "index"), buckets=4)


def test_batches_share_the_index(spark):
    idx = index(spark)
    first = spark.createDataFrame([(1, "a"), (5, "a"), (2, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(9, "a"), (7, "c"), (8, "c"), (3, "b")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in find_copies(first, idx).collect()}
    assert got == {1: (5, 2, False), 5: (5, 2, True), 2: (2, 1, True)}
    want = {9: (5, 1, False), 7: (8, 2, False), 8: (8, 2, True), 3: (2, 1, False)}
    for _ in range(2):  # the second time as after a failure
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in find_copies(second, idx).collect()} == want
        assert idx.read().count() == 3
    again = DigestIndex(spark, idx.path, buckets=4)  # as another session opens it
    assert again.read().count() == 3
    plan = second.select(F.unhex(F.sha2("text", 256)).alias("digest")).join(idx.read().hint("merge"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Bucketed: true" in text


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "x", 1), (None, "x", 1), (4, "y", 1), (4, "y", 1), (4, "z", 2), (None, "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    got = sorted(((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in find_copies(docs, index(spark)).collect()), key=str)
    assert got == sorted(
        [("1", 2, 2, False), ("2", 2, 2, True), ("None", None, 2, True), ("None", None, 2, True), ("4", 4, 3, True),
         ("4", 4, 3, True), ("4", 4, 1, True), ("None", 4, 3, False)], key=str)
    kept = drop_copies(docs, index(spark))
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(
        f"Row(doc_id={i}, text={t!r}, digest={d})" for i, t, d in [(2, "", 1), (None, "x", 1), (4, "y", 1), (4, "z", 2)]
    )
    assert find_copies(docs.where("false"), index(spark)).count() == 0

"""Intervals and as-of decisions on small tables."""

import datetime as dt

from tablewright.llm import url_filter as u


def at(day, second=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, seconds=second)


ENTRIES = [
    ("bad", "x.org", "add", at(10)), ("bad", "x.org", "add", at(12)), ("bad", "x.org", "remove", at(20)),
    ("bad", "x.org", "remove", at(21)), ("bad", "x.org", "add", at(100)), ("bad", "y.x.org/a/b", "remove", at(1)),
    ("bad", "y.x.org/a/b", "add", at(5)), ("ok", "y.x.org/a/b", "add", at(15)), ("bad", "z.org", "add", at(3)),
    ("bad", "z.org", "remove", at(3)), (None, "x.org", "add", at(1)), ("bad", None, "add", at(1)),
    ("bad", "q.org", "add", None), ("bad", "x.org", None, at(50)),
]


def entries(spark):
    return spark.createDataFrame(ENTRIES, "list_name string, pattern string, action string, at timestamp")


def test_intervals(spark):
    got = {tuple(r) for r in u.list_intervals(entries(spark)).collect()}
    assert got == {
        ("bad", "x.org", at(10), at(20)), ("bad", "x.org", at(100), None), ("bad", "y.x.org/a/b", at(5), None),
        ("ok", "y.x.org/a/b", at(15), None), ("bad", "z.org", at(3), None),
    }


def test_decisions(spark):
    rows = [
        (1, "http://x.org/", at(9, 86399)), (2, "HTTP://User:pw@WWW.X.org.:8080/p?q", at(10)), (3, "http://x.org", at(20)),
        (4, "http://notx.org/", at(15)), (5, "http://y.x.org/a/b/c#f", at(11)), (6, "http://y.x.org/a/b?c", at(16)),
        (7, "http://y.x.org/a/bc", at(30)), (8, None, at(15)), (9, "x.org/a", at(15)), (10, "http://x.org/", None),
        (None, "http://z.org//", at(400)), (11, "http://x.org/" + "a/" * 5000, at(500)), (11, "http://x.org/" + "a/" * 5000, at(500)),
        (12, "", at(1)),
    ]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp").selectExpr("*", "'n' as pattern")
    got = {r.page_id: r for r in u.judge_captures(captures, entries(spark), ("ok",)).collect()}
    assert len(got) == 13
    assert {i for i, r in got.items() if r.blocked} == {2, 5, None, 11}
    assert (got[5].pattern, got[5].n_lists) == ("y.x.org/a/b", 1)
    assert (got[6].list_name, got[6].n_lists, got[6].blocked) == ("ok", 2, False)
    assert (got[2].host, got[2].pattern, got[8].host, got[9].host) == ("www.x.org", "x.org", "", "")
    none = u.judge_captures(captures, entries(spark).where("false"))
    assert none.count() == 13 and none.where("blocked").count() == 0
    assert u.judge_captures(captures.where("false"), entries(spark)).count() == 0


def test_old_entries_cost_what_the_captures_span(spark):
    """An entry dated centuries back meets the same captures as one dated on the first of them."""
    captures = spark.createDataFrame([(i, "http://x.org/", at(100 + i)) for i in range(3)], "page_id long, url string, fetched_at timestamp")
    for since in (dt.datetime(1, 1, 2), at(100)):
        old = spark.createDataFrame([("bad", "x.org", "add", since), ("bad", "x.org", "remove", at(102))], "list_name string, pattern string, action string, at timestamp")
        judged = u.judge_captures(captures, old)
        assert {r.page_id for r in judged.where("blocked").collect()} == {0, 1}

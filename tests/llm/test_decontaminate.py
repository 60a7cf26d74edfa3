"""Winnowing against brute force over all windows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tablewright.llm import decontaminate as d

from ..compare import difference, duck

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        out.append((str(doc_id), len(w), len(hit), len(found), ",".join(sorted(found))))
    return sorted(out)


def found(spark, docs, items, **options):
    left = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, item string, at int")
    right = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, digest string")
    rows = d.contamination(left, right, **options).collect()
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, ",".join(r["items"])) for r in rows)


def corpus(rng):
    """Texts of few different words, so that windows repeat, with planted parts of items."""
    some = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(some, k=rng.choice([1, 2, 3, 5, 6, 7, 9, 10, 11, 12, 40])))) for i in range(10, 40)]
    items += [(10, "Änd  W3-w4, w5"), (None, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w0"), (99, None), (98, " .,;"), (11, items[3][1])]
    docs = []
    for i in range(60):
        w = rng.choices([*some, "Other", "new"], k=rng.choice([0, 1, 3, 9, 10, 30, 200]))
        for _ in range(rng.randint(0, 3)):
            part = words(rng.choice(items)[1])
            cut = rng.randint(0, len(part))
            at = rng.randint(0, len(w))
            w[at:at] = part[cut:] if rng.random() < 0.3 else part
        docs.append((i, rng.choice([" ", ", ", "\n- "]).join(w)))
    return [*docs, (None, None), (None, "w1"), (3, "äND w3 W4 w5"), (3, docs[5][1]), (3, docs[5][1]), (7, "")], items


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    docs, items = corpus(random.Random(seed))
    want = plain(docs, items)
    assert any(r[3] > 1 for r in want) and any(r[1] and not r[2] for r in want)
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, broadcast_rows=0) == want


def test_long_items_only(spark):
    """Ten-word windows alone, in texts and items of many pieces; one passage in a third of all rows."""
    rng = random.Random(9)
    some = [f"w{i}" for i in range(5000)]
    passage = rng.choices(some, k=14)
    items = [(i, " ".join(rng.choices(some, k=30) + passage * (i % 3 == 0))) for i in range(12)]
    items.append((50, " ".join(rng.choices(some, k=4000))))
    docs = []
    for i in range(90):
        w = rng.choices(some, k=rng.choice([20, 1023, 1024, 1030, 2048, 5000]))
        part = words(rng.choice(items)[1])
        cut = rng.randrange(len(part))
        at = rng.choice([0, 5, 1010, 1015, 1019, 1024, len(w)])
        w[at:at] = part[cut : cut + rng.choice([9, 10, 11, 25])] if i % 3 else passage
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, docs[0][1]) for i in range(60)]
    want = plain(docs, items)
    assert {9, 10, 14} & {r[2] for r in want} and any(not r[2] for r in want)
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, broadcast_rows=0) == want


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b")]) == []
    assert found(spark, [(1, "a b")], []) == [("1", 2, 0, 0, "")]
    assert found(spark, [(1, "a b")], [(1, None), (2, "...")]) == [("1", 2, 0, 0, "")]


def test_no_python_and_no_shuffle_of_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    plan = d.contamination(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    texts = docs.select(F.lit("x").alias("digest"), d._words(F.col("text")).alias("words"))
    prints = spark.range(10).select(F.col("id").alias("fingerprint"))
    assert "Exchange hashpartitioning" not in d._candidates(texts, prints, [10], 100)._jdf.queryExecution().toString()


def test_query(spark):
    rows = d.op11_decontaminate(spark, FOLDER)
    assert difference(rows, duck(FOLDER), d.OP11_SQL) is None
    assert rows.where("contaminated").count() > 0

"""Removed words against a plain version."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tablewright.llm import anchors, exchange


def plain(rows, window=13):
    """{row number: removed flags} over (id, text) rows."""
    import re

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    order = [float("inf") if i is None else i for i, _ in rows]
    least = {}
    for i, w in zip(order, words):
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            least[key] = min(i, least.get(key, i))
    out = []
    for i, w in zip(order, words):
        flags = [False] * len(w)
        for s in range(len(w) - window + 1):
            if least[tuple(w[s : s + window])] < i:
                flags[s : s + window] = [True] * window
        out.append((w, flags))
    return out


def expected(rows, window=13):
    out = []
    for (i, _), (w, flags) in zip(rows, plain(rows, window)):
        kept = " ".join(x for x, gone in zip(w, flags) if not gone)
        out.append((i, len(w), sum(flags), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as cell", "'x' as id")
    outputs = ("n_words", "n_removed", "kept_sha256")
    return sorted((tuple(r) for r in anchors.remove_repeats(df, outputs=outputs, **options).collect()), key=str)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, folder, monkeypatch):
    monkeypatch.setattr(exchange, "CELL_BYTES", 100_000)  # several cells and buckets on small tables
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 400_000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in anchors.op2_anchors(spark, folder).collect()), key=str)
    assert got == expected(rows) and sum(r[2] for r in got) > 0


def test_made_rows(spark, monkeypatch):
    monkeypatch.setattr(exchange, "CELL_BYTES", 3000)
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 9000)
    rng, vocabulary = random.Random(1), ["a", "b", "cc", "é", "word", "x\x1cy"]
    shared = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (12, 13, 14, 20, 60)]
    rows = []
    for i in range(150):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(str(rng.random()) for _ in range(rng.randint(0, 9))) for _ in range(5)]
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(parts)))
    rows += [(None, rows[3][1]), (None, rows[3][1]), (7, rows[9][1]), (7, rows[9][1]), (200, None), (201, ""), (202, " \n ")]
    rows += [(203, "w " * 50), (204, "w " * 30), (205, " ".join(shared[4].split()[:13]))]
    assert run(spark, rows) == expected(rows)
    assert run(spark, rows, window=5) == expected(rows, 5)


def test_spans_and_text(spark):
    shared = " ".join(f"s{i}" for i in range(15))
    rows = [(1, f"a {shared} b"), (2, f"c d {shared}\n{shared} e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in anchors.remove_repeats(df).collect()}
    assert [tuple(s) for s in got[2].spans] == [(2, 32)] and got[2].kept_text == "c d e"
    assert got[1].spans == [] and got[1].kept_text == rows[0][1]
    assert anchors.remove_repeats(df.where("false")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab \n\té", max_size=30), max_size=5))
def test_word_hashes(texts):
    raw = [t.encode() for t in texts]
    hashes, counts = anchors.word_hashes(raw)
    words = [w for t in raw for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in raw]
    seen = {}
    for w, h in zip(words, hashes.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_words_and_groups(monkeypatch):
    monkeypatch.setattr(anchors, "GROUP", 50)
    raw = [b"x" * 400 + b" y " + b"ab " * 100, b"", b"y " + b"x" * 400]
    hashes, counts = anchors.word_hashes(raw)
    assert counts.tolist() == [102, 0, 2]
    assert hashes[0] == hashes[103] and hashes[1] == hashes[102] and len(np.unique(hashes)) == 3

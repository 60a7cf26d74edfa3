"""The pipeline: stages against plain versions of their decisions, and rows made to be odd."""

from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as p
from tablewright.llm import bpe, quality
from tests.llm.test_near_copies import plain_kept

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for i, (name, stage) in enumerate(p.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        out.append(docs)
        docs = spark.read.parquet(path)
    return [*out, docs]


def test_columns(steps):
    for df in steps[:-1]:
        assert df.columns == steps[0].columns


def test_stages(spark, steps):
    rows = [df.collect() for df in steps]
    _, scorer = quality.fit_quality_model(steps[0])
    good = [r for r in rows[0] if scorer.probability(r.text) >= quality.THRESHOLD]
    assert Counter(good) == Counter(rows[1])

    largest = {}
    for r in rows[1]:
        largest[r.text] = max(r.doc_id, largest.get(r.text, r.doc_id))
    assert Counter(rows[2]) == Counter(r for r in rows[1] if largest[r.text] == r.doc_id)

    kept_ids = set(plain_kept([(r.doc_id, r.text) for r in rows[2]]))
    assert Counter(rows[3]) == Counter(r for r in rows[2] if r.doc_id in kept_ids)
    assert len(rows[3]) <= len(rows[2]) < len(rows[1]) < len(rows[0])

    times = Counter(r.doc_id for r in rows[4])
    kept = {r.doc_id: r for r in rows[3]}
    assert all(kept[r.doc_id] == r for r in rows[4]) and max(times.values()) <= 3
    words = {i: len(r.text.split()) for i, r in kept.items()}
    sources = sorted({r.source for r in rows[3]})
    have = {s: sum(words[i] for i, r in kept.items() if r.source == s) for s in sources}
    limit, total = {s: 3 * have[s] for s in sources}, sum(have.values())
    target, open_ = {}, list(sources)
    while True:  # shares by weight again whenever a limit binds
        weight = {s: sources.index(s) % 3 + 1 for s in open_}
        level = (total - sum(target.values())) / sum(weight.values())
        over = [s for s in open_ if level * weight[s] > limit[s]]
        if not over:
            target.update({s: level * weight[s] for s in open_})
            break
        target.update({s: limit[s] for s in over})
        open_ = [s for s in open_ if s not in over]
    for s in sources:
        got = sum(words[i] * n for i, n in times.items() if kept[i].source == s)
        assert abs(got - target[s]) <= max(words[i] for i, r in kept.items() if r.source == s)

    library = Tokenizer.from_file(bpe.default_tokenizer())
    want = Counter((r.doc_id, tuple(library.encode(r.text, add_special_tokens=False).ids)) for r in rows[4])
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows[5]) == want


def test_odd_rows(spark):
    long = "the quick brown fox jumps over the lazy dog by the river bank. " * 3000
    rows = [(1, None, "s", None), (2, "", None, 1), (2, "", None, 1), (None, "one fine day we went to town.", "s", 2),
            (None, "a very different text that is about ships.", "t", 2), (3, long, "s", 3), (4, long, "s", 3), (3, long, "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    for name, stage in p.STAGES:
        out = stage(spark, docs, FOLDER)
        assert stage(spark, docs.where("false"), FOLDER).count() == 0
        if name != "encode":
            assert out.columns == docs.columns
            out.collect()
    # Of six different documents none is near another; the two of id 4 and 3 are one, as are null and empty.
    near = p.near_dedup(spark, docs, FOLDER).collect()
    assert sorted(str(r.doc_id) for r in near) == ["1", "3", "None", "None"]
    kept = p.exact_dedup(spark, docs, FOLDER).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["2", "4", "None", "None"]


def test_run_is_registered(spark):
    import __spark_entry__ as contract

    assert contract.queries()["pipeline"](spark, FOLDER).count() > 0

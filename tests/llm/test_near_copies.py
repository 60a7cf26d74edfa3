"""Near copies against brute-force Jaccard of five-word shingles."""

import random

import numpy as np
import pytest

from tablewright.llm import near_copies, simhash

VOCABULARY = [f"w{i}" for i in range(3000)]


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Smallest id of each component, by comparing all pairs."""
    sets, parent = [(i, plain_shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted({find(i) for i in parent})


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
    return words


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect())


def test_near_copies_go(spark):
    rng, texts = random.Random(3), []
    for _ in range(60):  # originals of many lengths, copies on both sides of the bound, chains of copies
        words = rng.choices(VOCABULARY, k=rng.choice([6, 12, 30, 60, 200, 900]))
        texts.append(words)
        for _ in range(rng.randint(0, 4)):
            words = edited(rng, words, rng.randint(1, 1 + len(words) // 45))
            texts.append(words)
    rng.shuffle(texts)
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)] + [(1000, ""), (1001, None), (1002, "A b"), (1003, "a B ")]
    want = plain_kept(rows)
    assert 60 < len(want) < len(rows) - 40
    assert kept(spark, rows) == want


def test_large_group(spark):
    """Copies of one text that are partly too far from each other: larger buckets than FEW."""
    rng = random.Random(4)
    words = rng.choices(VOCABULARY, k=120)
    rows = [(i, " ".join(edited(rng, words, rng.randint(0, 9)))) for i in range(400)]
    want = plain_kept(rows)
    assert 10 < len(want) < 380
    assert kept(spark, rows) == want


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_supplied_documents(spark, scale):
    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")
    want = plain_kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == want


def test_parities_bound_the_difference():
    rng = random.Random(6)
    words = rng.choices(VOCABULARY, k=400)
    for edits in (0, 1, 5, 40, 400):
        other = edited(rng, words, edits)
        a, b = (" ".join(w) for w in (words, other))
        bits = near_copies.sketch(a)[2] ^ near_copies.sketch(b)[2]
        differ = len(plain_shingles(a) ^ plain_shingles(b))
        assert int(np.bitwise_count(bits.view(np.uint64)).sum()) <= differ


def test_rows_with_null_and_repeated_ids(spark):
    """No document is lost for its id."""
    texts = ["one text about ships and the sea at night", "another one on trees in the park by day", "a third that tells of bread and wine"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (1, "four words of it"), (1, "and five words of that"), (2, "six"), (2, "six"), (2, "SIX ")]
    docs = spark.createDataFrame([(*r, "d", True) for r in rows], "doc_id long, text string, digest string, id_absent boolean")
    got = simhash.drop_near_copies(docs).select("doc_id", "text").collect()
    assert len(got) == 6
    assert {(r.doc_id, (r.text or "").strip().lower()) for r in got} == {(i, t.strip().lower()) for i, t in rows}
    assert sorted(map(str, got)) == sorted(map(str, simhash.drop_near_copies(docs).select("doc_id", "text").collect()))
    assert simhash.drop_near_copies(docs.where("false")).count() == 0


def test_pages_of_one_template(spark):
    """Common words on every page: no pair is near, few are compared; near copies among them are found."""
    rng = random.Random(8)
    common = rng.choices(VOCABULARY, k=90)
    pages = [common + rng.choices(VOCABULARY, k=30) for _ in range(300)]
    pages += [edited(rng, pages[i], 1) for i in range(40)]
    rows = [(i, " ".join(words)) for i, words in enumerate(pages)]
    want = plain_kept(rows)
    assert len(want) < 300 + 5
    assert kept(spark, rows) == want


def test_long_texts(spark):
    rng = random.Random(10)
    words = rng.choices(VOCABULARY, k=400_000)
    rows = [(1, " ".join(words)), (2, " ".join(edited(rng, words, 3000))), (3, " ".join(edited(rng, words, 60_000))), (4, "x" * 3_000_000)]
    assert kept(spark, rows) == [1, 3, 4]


def test_shingles_against_words():
    rng = random.Random(11)
    for k in (0, 1, 3, 4, 5, 6, 50):
        words = rng.choices(["a", "B", "c", "\x1c", "é"], k=k)
        assert len(near_copies.shingle_hashes(" \n".join(words))) == len(plain_shingles_ascii(" ".join(words)))
    long = " ".join(rng.choices(VOCABULARY, k=300_000))  # more than one piece
    assert len(near_copies.shingle_hashes(long)) == len(plain_shingles(long))


def plain_shingles_ascii(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_rare_shingles_are_shared(spark):
    """Sets at similarity 0.8 or more share one of the shingles chosen of either."""
    rng = random.Random(12)
    base = rng.choices(VOCABULARY, k=200)
    texts = [" ".join(edited(rng, base, rng.randint(0, 6))) for _ in range(60)]
    sets = [near_copies.shingle_hashes(t) for t in texts]
    table = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in enumerate(sets)], "node long, hashes array<long>")
    rare = {r.node: set(r.tokens) for r in near_copies.rare_shingles(table).collect()}
    near = [(i, j) for i in range(60) for j in range(i) if near_copies.alike(sets[i], sets[j])]
    assert 0 < len(near) < 60 * 59 // 2
    assert all(rare[i] & rare[j] for i, j in near)
    assert all(len(rare[i]) <= len(s) / 5 + 1 for i, s in enumerate(sets))

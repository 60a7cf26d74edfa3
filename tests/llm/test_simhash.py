"""Fingerprints and components against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tablewright.llm import simhash
from tablewright.llm.components import component_roots

FOLDER = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints):
    """{id: smallest reachable id} by comparing all fingerprints."""
    parent = {i: i for i, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, f) in enumerate(prints):
        for j, g in prints[:n]:
            if bin(f ^ g).count("1") <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in prints}


@pytest.mark.parametrize("text", ["", " \n", "a", "A b", "a b c", "Éa É é x\x1cy z", "a b c " * 2000, " x y"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, plain_fingerprint(r.text or "")) for r in docs]
    want = plain_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6_simhash(spark, FOLDER).collect()}
    assert got == {i: (f"{f:016x}", want[i]) for i, f in prints}
    assert len(set(want.values())) < len(want)


def test_components_of_random_fingerprints(spark):
    rng, values = random.Random(5), []
    for _ in range(60):  # families at distances 0 to 4 of each other, in chains
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            values.append(f)
            for _ in range(rng.randint(0, 4)):
                f ^= 1 << rng.randrange(64)
    values += [0, (1 << 64) - 1, 1 << 63, 7, 0b111111]
    prints = list(enumerate(values, 100))
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in prints]
    table = spark.createDataFrame(rows, "doc_id long, fingerprint long")
    got = {r.doc_id: r.component_id for r in simhash.near_components(table).collect()}
    assert got == plain_components(prints)


def test_roots_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(500, i) for i in range(501, 700)]
    links = spark.createDataFrame(chain + hub + [(3, 3), (1, 0)], "a long, b long")
    got = {r.node: r.root for r in component_roots(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 500 for i in range(501, 700)}}
    assert component_roots(links.where("a = 3 AND b = 3")).count() == 0


def test_edge_rows(spark):
    rows = [(5, None, "p"), (2, " ", "q"), (None, "one two three four", "r"), (9, "One two three FOUR", "s"),
            (9, "one two three four", "s"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = simhash.near_components(simhash.fingerprints(docs)).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == [
        ("2", 2), ("5", 2), ("9", 9), ("9", 9), ("None", 2), ("None", 9),
    ]
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 9]
    assert simhash.near_components(simhash.fingerprints(docs.where("false"))).count() == 0
    assert kept.where(F.col("doc_id").isNull()).count() == 0

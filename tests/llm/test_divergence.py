"""Packed term counts against counters; the audit against exact integers and DuckDB."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tablewright.llm import divergence as d, packed_terms as p

from ..compare import difference, duck

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def counted(texts, groups):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    out, with_it = Counter(), Counter()
    for lengths, letters, of, n, docs in p.group_counts(np.frombuffer(b"".join(raw), np.uint8), offsets, np.array(groups)):
        ends = np.cumsum(lengths)
        assert ends[-1] == len(letters)
        for i in range(len(of)):
            key = int(of[i]), letters[ends[i] - lengths[i] : ends[i]].tobytes().decode()
            out[key] += int(n[i])
            with_it[key] += int(docs[i])
    return out, with_it


def plain_counted(texts, groups):
    out, with_it = Counter(), Counter()
    for text, group in zip(texts, groups):
        found = Counter(terms(text))
        for term, n in found.items():
            out[group, term] += n
            with_it[group, term] += 1
    return out, with_it


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abZé _", max_size=30) | st.just("a" * 40 + " b" * 9), max_size=8), st.data())
def test_counts(texts, data):
    groups = sorted(data.draw(st.lists(st.integers(0, 2), min_size=len(texts), max_size=len(texts))))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(p, "PIECE", data.draw(st.sampled_from([1, 7, 64, 1 << 20])))
        patch.setattr(p, "FLUSH", data.draw(st.sampled_from([1, 1 << 20])))
        assert counted(texts, groups) == plain_counted(texts, groups)


def test_every_length_and_long_texts():
    rng = random.Random(1)
    some = ["x" * n + chr(97 + n % 26) for n in range(40)] + ["é" * n for n in range(1, 30)] + ["ab" * 50_000]
    texts = [" ".join(rng.choices(some[:-1], k=rng.choice([0, 3, 2000]))) for _ in range(40)]
    texts += ["1".join(rng.choices(some, k=300)), "ab" * 3_000_000, " ".join(rng.choices(some[:60], k=900_000))]
    groups = sorted(rng.randrange(5) for _ in texts)
    assert counted(texts, groups) == plain_counted(texts, groups)


def test_radix_order():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 1 << 64, 5000, np.uint64) % np.uint64(m) for m in (5, 1 << 40)]
    assert p.radix_order(words).tolist() == np.lexsort((words[1], words[0])).tolist()


def plain_audit(rows):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", terms(text)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 10]
        share = {}
        for s in [*sources, None]:
            n = {t: sum(counts[lang, x][t] for x in sources) if s is None else counts[lang, s][t] for t in kept}
            share[s] = {t: 1 + 10**9 * (c + 2) // (sum(n.values()) + 2 * len(kept)) for t, c in n.items()}
        f = lambda t, a, b: (share[a][t] - share[b][t]) ** 2 // (share[a][t] + share[b][t])
        for s in sources:
            pairs = [(-sum(f(t, s, o) for t in kept), o) for o in sources if o != s]
            found = [(-f(t, s, None), t) for t in kept if counts[lang, s][t] and share[s][t] > share[None][t]]
            for part, cells in (("pair", sorted(pairs)), ("term", sorted(found, key=lambda x: (x[0], x[1].encode()))[:10])):
                out += [(lang, s, part, item, -value, i) for i, (value, item) in enumerate(cells, 1)]
    return sorted(out)


def audit(spark, rows):
    rows = [(i, *r, 1, "x") for i, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, term string")
    got = d.source_divergence(docs).select("lang", "source", "part", "item", "value", "rank").collect()
    return sorted(tuple(r) for r in got)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    some = [f"{'w' * (i % 25)}{chr(97 + i % 26)}{chr(98 + i // 26)}" for i in range(120)]
    out = []
    for _ in range(250):
        lang = rng.choice(["en", "en", "de"])
        mine = some[:: 1 if lang == "en" else 3]
        out.append((" ".join(rng.choices(mine, weights=range(len(mine), 0, -1), k=rng.choice([1, 20, 60]))), lang, f"s{rng.randrange(5)}"))
    out += [(None, "en", "s0"), ("", None, None), ("a b", None, "x"), ("...", "fr", "only"), (" a", "en", "empty? no"), (None, "en", "none")]
    return out + [out[0]] * 80


def test_audit(spark, rows):
    assert audit(spark, rows) == plain_audit(rows)


def test_many_blocks_and_tiles(spark, rows, monkeypatch):
    for name, size in (("BLOCK_ROWS", 40), ("CELLS", 16)):
        monkeypatch.setattr(d, name, size)
    assert audit(spark, rows) == plain_audit(rows)


def test_tiles():
    rng = np.random.default_rng(3)
    shares = rng.integers(1, 10**9, (50, 9))
    whole = d.pair_sums(shares, 0, 9)
    assert np.concatenate([d.pair_sums(shares, i, min(9, i + 4)) for i in (0, 4, 8)]).tolist() == whole.tolist()
    assert whole[2, 5] == sum((int(a) - int(b)) ** 2 // (int(a) + int(b)) for a, b in shares[:, [2, 5]])


def test_empty(spark):
    assert audit(spark, []) == []
    assert audit(spark, [("a", "en", "x")] * 9) == []
    assert audit(spark, [("a", "en", "x"), ("b", "en", "y")]) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query(spark, scale):
    folder = f"/root/testdata/{scale}"
    assert difference(d.op12_divergence(spark, folder), duck(folder), d.OP12_SQL) is None

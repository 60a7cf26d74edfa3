"""Boundary sets against sorted lists; cuts against regular expressions; exact round trips."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tablewright.llm import boundaries as b, fill_middle as f

from ..compare import difference, duck

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.001"


def plain(doc_id, text):
    text, units = text or "", UNIT.findall(text or "")
    x = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, q = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, p), (p, q), (q, n)))
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def made(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, form int")
    return f.restore(f.fill_in_middle(docs, **options)).collect()


@pytest.mark.parametrize(
    ("kind", "positions"),
    [
        (b.ArrayContainer, np.arange(5, 65536, 100)),
        (b.BitmapContainer, np.flatnonzero(np.random.default_rng(1).random(65536) < 0.5)),
        (b.RunContainer, np.r_[3:9000, 9005:40000, 65535]),
    ],
)
def test_containers(kind, positions):
    assert isinstance(b.container(positions), kind)
    for built in (kind(positions), b.ArrayContainer(positions), b.BitmapContainer(positions), b.RunContainer(positions)):
        assert [built.select(k) for k in range(0, len(positions), 7)] == positions[::7].tolist()


def test_set_of_many_containers():
    rng = np.random.default_rng(2)
    parts = [(k, np.flatnonzero(rng.random(65536) < share)) for k, share in ((0, 0.01), (1, 0.4), (2, 0), (5, 0.999))]
    want = np.concatenate([k * 65536 + low for k, low in parts])
    built = b.BoundarySet(parts)
    assert {type(c) for c in built.containers} == {b.ArrayContainer, b.BitmapContainer, b.RunContainer}
    assert len(built) == len(want)
    assert [built.select(k) for k in range(0, len(want), 101)] == want[::101].tolist()
    for k in (-1, len(want)):
        with pytest.raises(IndexError):
            built.select(k)


@settings(max_examples=300, deadline=None)
@given(st.text("ab \n\x0b\x1c\u0085é ", max_size=40))
def test_units(text):
    raw = text.encode()
    for unit, want in (("word", UNIT.findall(text)), ("char", list(text))):
        ends = f.unit_ends(raw, unit)
        stops = [0, *(ends.select(k) + 1 for k in range(len(ends)))]
        assert [raw[i:j].decode() for i, j in zip(stops, stops[1:])] == want


@pytest.mark.parametrize("shift", range(-3, 4))
def test_units_at_container_edges(shift):
    for text in ("x" * (65536 + shift) + " yé  z ", "x" * (65535 + shift) + "é\n", " " * (131072 + shift) + "a", "é" * (32768 + shift)):
        raw, want = text.encode(), UNIT.findall(text)
        ends = f.unit_ends(raw)
        assert [ends.select(k) + 1 for k in range(len(ends))] == np.cumsum([len(u.encode()) for u in want]).tolist()
        assert len(f.unit_ends(raw, "char")) == len(text)


@settings(max_examples=300, deadline=None)
@given(st.text("<PSM>ab ", max_size=30), st.integers(0, 99))
def test_outputs_restore(text, doc_id):
    if any(m in text for m in f.MARKS):
        return
    n, prefix, middle, suffix = (x if isinstance(x, int) else x.decode() for x in f.split_middle(text.encode(), doc_id))
    assert prefix + middle + suffix == text
    assert f.restored_text(f"<P>{prefix}<S>{suffix}<M>{middle}", "psm") == text
    assert f.restored_text(f"<S>{suffix}<P>{prefix}<M>{middle}", "spm") == text


def test_rows(spark):
    texts = [None, "", " ", "one", "one two", "a <P> b", "a <S b", "<M>", "é ü ß  \n", "x y " * 300_000, "y" * 200_000]
    rows = [(i, t, "n", 1) for i in (None, *range(40)) for t in texts[:9]] + [(i, t, None, None) for i in range(6) for t in texts]
    got = made(spark, rows)
    assert len(got) == len(rows)
    want = sorted((str(i), *map(str, plain(i, t))) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), *map(str, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output))) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert sorted(r.restored for r in got) == sorted(t or "" for _, t, *_ in rows)


def test_options(spark):
    rows = [(i, "é b c", None, None) for i in range(60)]
    assert {r.form for r in made(spark, rows, rate=0)} == {"plain"}
    assert {r.form for r in made(spark, rows, rate=100, spm_rate=0)} == {"psm"}
    by_char = made(spark, rows, rate=100, unit="char")
    assert {r.n for r in by_char} == {5}
    assert {r.prefix_chars for r in by_char} == set(range(6))
    assert {r.restored for r in by_char} == {"é b c"}
    assert made(spark, []) == []


def test_query(spark):
    assert difference(f.op13_fill_middle(spark, FOLDER), duck(FOLDER), f.OP13_SQL) is None

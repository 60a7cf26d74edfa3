"""The encoder against the tokenizers library, on texts made to be hard and on the documents."""

import hashlib
import itertools
import json

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm import bpe

FOLDER = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(bpe.default_tokenizer())
OWN = bpe.PrefixEncoder(open(bpe.default_tokenizer(), encoding="utf-8").read())
HARD = [
    "", " ", "  \n\n  x", "a\tb  c d　e", "I'll they've 'S don't", "<|endoftext|>a<|endoftext|><|endoftext|>",
    "<|endoftext| >", "x" * 5000, "ab" * 3000, "\x00\x1c\x1f\x85​", "漢字かな交じり文 𝔘𝔫𝔦 👩‍👩‍👧‍👦 ½²³ ١٢٣", "\n" * 300, "!!" * 400 + "%%%",
    "é́ß Straße ÀÈ", "0123456789" * 50, "᠎﻿  ",
]


def same(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    own = OWN.encode(text)
    assert own.tolist() == ids
    assert OWN.decode(own) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200) | st.text("ab <|endoftx>'re\né", max_size=200))
def test_any_text(text):
    same(text)


def test_pairs_are_decided_without_merging_texts(monkeypatch):
    """Texts that were not met before cost no merging from scratch."""
    encoder = bpe.PrefixEncoder(open(bpe.default_tokenizer(), encoding="utf-8").read())
    monkeypatch.setattr(encoder, "_merged", None)
    for text in [*HARD, "unheardofword étrangement Übergröße xqzzyk aaaaaaaa -=-=-="]:
        assert encoder.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=255), max_size=60))
def test_latin_pieces(text):
    assert OWN._latin_pieces(text) == OWN._pieces(text)


@pytest.mark.parametrize("merges", [
    [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc"), ("abc", "a")],  # one token of two merges
    [("ab", "c"), ("a", "b"), ("c", "a"), ("a", "a"), ("aa", "b")],  # a token made before its half
    [("a", "a"), ("aa", "aa"), ("aa", "a"), ("b", "a")],  # in order
])
def test_any_order_of_merges(merges):
    spec = json.loads(open(bpe.default_tokenizer(), encoding="utf-8").read())
    tokens = dict.fromkeys([*bpe.byte_symbols(), *("".join(m) for m in merges)])
    spec["added_tokens"], spec["model"]["merges"] = [], [list(m) for m in merges]
    spec["model"]["vocab"] = {t: i for i, t in enumerate(tokens)}
    library, own = Tokenizer.from_str(json.dumps(spec)), bpe.PrefixEncoder(json.dumps(spec))
    for length in range(1, 8):
        for text in map("".join, itertools.product("abc", repeat=length)):
            assert own.encode(text).tolist() == library.encode(text).ids, text


def test_broken_bytes_decode_as_in_the_library():
    for ids in ([188], [222, 240], [447, 64], [50256, 188, 50256]):
        assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_query_on_all_documents(spark):
    want = {}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    for row in docs:
        ids = LIBRARY.encode(row.text or "", add_special_tokens=False).ids
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, dtype="<u4").tobytes()
        want[row.doc_id] = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op5_bpe(spark, FOLDER).collect()}
    assert got == want


def test_nulls_repeats_and_other_columns(spark):
    rows = [(1, None, "x"), (None, "a b", "y"), (1, "", None), (1, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_texts(docs, bpe.default_tokenizer(), ("n_tokens", "ids", "decoded"))
    out = sorted(map(tuple, got.collect()), key=str)
    assert out == sorted([(1, 0, [], ""), (None, 2, [64, 275], "a b"), (1, 0, [], ""), (1, 0, [], "")], key=str)
    back = bpe.decode_ids(got.drop("decoded"), bpe.default_tokenizer()).where(F.col("doc_id").isNull())
    assert back.first().decoded == "a b"
    assert bpe.encode_texts(docs.where("false"), bpe.default_tokenizer()).count() == 0
    with pytest.raises(ValueError):
        bpe.encode_texts(docs, bpe.default_tokenizer(), ("words",))

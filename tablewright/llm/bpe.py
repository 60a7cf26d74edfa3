"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that can end its encoding: a
vocabulary entry that is a suffix of the prefix and compatible with the last token of the
prefix before it, or the last byte if no longer one is.  Two tokens are compatible if merging
the text of both from scratch gives back these two, which is decided by taking back the merges
next to their border, last one first, and looking for a merge across it.  The suffix matches come from an automaton over the vocabulary, so a piece
costs time in proportion to its length, however long it is; following the stored last
tokens back from the end gives the ids.

The vocabulary file is that of the tokenizers library (byte-level pre-tokenizer, BPE
model).  It is read on the driver and sent to the tasks once (1.5 MB for 50,000 entries);
each Python worker builds the automaton once and keeps the ids of recent short pieces in
two generations of bounded dictionaries.

Defined results: a null text is the empty text, with no tokens.  Added tokens of the file
are found in texts before anything else, as the library does.  Decoding bytes that are not
UTF-8 puts U+FFFD for each invalid part.  Repeated rows are encoded each; a null id stays
null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..missing import quoted
from .common import corpus_table, free_name

# Fixed value: the pattern of the byte-level pre-tokenizer.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CACHED_LENGTH = 40
CACHED_PIECES = 60_000
CACHED_PAIRS = 300_000
TOKENS = 1 << 32  # more than a vocabulary has
ROWS = 256  # documents whose ids are held at once


def byte_symbols() -> str:
    """The character that stands for each byte: itself if it is visible Latin-1, else one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return "".join(chr(b if b in visible else next(hidden)) for b in range(256))


def latin_pieces() -> str:
    """:data:`PIECES` for texts of characters below U+0100, in the faster patterns of the standard library."""
    latin = "".join(map(chr, range(256)))
    blank, letter, digit = (re.escape("".join(regex.findall(rf"\p{{{c}}}", latin))) for c in ("White_Space", "L", "N"))
    return (
        rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{digit}]+| ?[^{blank}{letter}{digit}]+|[{blank}]+(?![^{blank}])|[{blank}]+"
    )


class PrefixEncoder:
    """Encoder and decoder of one vocabulary file (its JSON text)."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model, kind = spec["model"], (spec["pre_tokenizer"] or {}).get("type")
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges"))
        if model["type"] != "BPE" or kind != "ByteLevel" or spec["normalizer"] or not plain:
            raise ValueError("only plain byte-level BPE files without a normalizer are supported")
        if spec["pre_tokenizer"]["add_prefix_space"] or not spec["pre_tokenizer"]["use_regex"]:
            raise ValueError("only the pattern of the byte-level pre-tokenizer is supported")
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        from_symbol = {s: b for b, s in enumerate(byte_symbols())}
        self._bytes = {i: bytes(from_symbol[c] for c in token) for token, i in self.ids.items()}
        self._added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take blanks or word limits are not supported")
        # Longer added tokens first, so that of two at one place the longer is found.
        added = sorted(self._added, key=len, reverse=True)
        self._split_added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")").split if added else None
        self._pieces = regex.compile(PIECES).findall
        self._latin_pieces = re.compile(latin_pieces()).findall
        self._matches = ahocorasick.Automaton()
        self._number_tokens()
        for number, token in enumerate(self._tokens):
            text = self._bytes[self.ids[token]].decode("latin-1")
            if self._stands(number) and len(text) > 1:
                self._matches.add_word(text, (len(text), number))
        self._matches.make_automaton()
        self._bytes.update({i: content.encode() for content, i in self._added.items()})
        self._packed = [self.ids[token].to_bytes(4, sys.byteorder) for token in self._tokens]
        self._compatible: dict[int, bool] = {}
        self._recent = _Recent(self._encode_piece)

    def _number_tokens(self) -> None:
        """Number single bytes first, then tokens in the order of the merges that make them.

        ``_halves`` are the numbers that a token is merged of, a single byte's are its own.  They are None if a
        token has two merges or is made before its halves; then texts are merged instead of taken apart.
        """
        single = [t for t in self.ids if len(t) == 1]
        self._single = {self._bytes[self.ids[t]].decode("latin-1"): n for n, t in enumerate(single)}
        made = dict.fromkeys("".join(pair) for pair in self.ranks)
        self._tokens = single + [t for t in made if len(t) > 1 and t in self.ids]
        numbers = {t: n for n, t in enumerate(self._tokens)}
        self._joined, self._halves = {}, [(n, n) for n in range(len(single))]
        ordered = len(made) == len(self.ranks) and len(self._tokens) == len(single) + len(made)
        for left, right in self.ranks if ordered else ():
            pair, number = (numbers.get(left), numbers.get(right)), numbers[left + right]
            ordered = ordered and None not in pair and max(pair) < number
            if not ordered:
                break
            self._joined[pair[0] * TOKENS + pair[1]] = number
            self._halves.append(pair)
        if not ordered or len(numbers) > TOKENS:
            self._halves = None
        else:
            self.ranks = {}  # no text is merged then
        self._standing = [True] * len(single)

    def _stands(self, number: int) -> bool:
        """Whether the text of a token merges to that token; asked in the order of the numbers."""
        if self._halves is None:
            return self._merged(self._tokens[number]) == [self._tokens[number]]
        if number >= len(self._standing):
            left, right = self._halves[number]
            self._standing.append(self._standing[left] and self._standing[right] and self._apart(left, right, number))
        return self._standing[number]

    def _apart(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge before that of ``limit`` joins anything across the border of two tokens.

        The merges of both are taken back, the last one first; of equal ones the right one is the last.
        """
        joined, halves = self._joined, self._halves
        while True:
            if joined.get(left * TOKENS + right, limit) < limit:
                return False
            inner, outer = halves[left][1], halves[right][0]
            if outer != right and (right >= left or inner == left):
                limit, right = right + 1, outer
            elif inner != left:
                limit, left = left, inner
            else:
                return True

    def _merged(self, text: str) -> list[str]:
        """The tokens of a short text by merging the pair of lowest rank until none is left."""
        parts, ranks = list(text), self.ranks
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda pair: ranks.get(pair, sys.maxsize))
            if best not in ranks:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _fits(self, last: int, token: int) -> bool:
        """Whether ``token`` may follow ``last``: merging the text of both gives back these two."""
        if self._halves is not None:
            known = self._apart(last, token, len(self._tokens))
        else:
            both = [self._tokens[last], self._tokens[token]]
            known = self._merged("".join(both)) == both
        if len(self._compatible) >= CACHED_PAIRS:
            self._compatible.clear()
        self._compatible[last * TOKENS + token] = known
        return known

    def _encode_piece(self, piece: str) -> bytes:
        """Ids as unsigned 32-bit integers, one after the other."""
        text = piece if piece.isascii() else piece.encode().decode("latin-1")
        # Last token of each prefix; the longest matches come first.  Where none fits it is the last byte.
        last: list[int | None] = [None] * (len(text) + 1)
        single, known = self._single, self._compatible.get
        for end, (length, token) in self._matches.iter(text):
            end += 1
            if last[end] is None:
                if length == end:
                    last[end] = token
                    continue
                before = last[end - length]
                if before is None:
                    before = single[text[end - length - 1]]
                fits = known(before * TOKENS + token)
                if self._fits(before, token) if fits is None else fits:
                    last[end] = token
        found, at = [], len(text)
        while at:
            token = last[at]
            if token is None:
                token = single[text[at - 1]]
            found.append(self._packed[token])
            at -= len(self._tokens[token])
        found.reverse()
        return b"".join(found)

    def encode(self, text: str) -> array:
        """Ids as unsigned 32-bit integers."""
        if self._split_added is None:
            return self._encode_plain(text)
        out = array("I")
        for part in self._split_added(text):
            if part in self._added:
                out.append(self._added[part])
            elif part:
                out.extend(self._encode_plain(part))
        return out

    def _encode_plain(self, text: str) -> array:
        try:
            text.encode("latin-1")
            pieces = self._latin_pieces(text)
        except UnicodeEncodeError:
            pieces = self._pieces(text)
        return array("I", b"".join(map(self._recent.__getitem__, pieces)))

    def decode(self, ids) -> str:
        return b"".join(map(self._bytes.__getitem__, ids)).decode(errors="replace")


class _Recent(dict):
    """Ids of pieces; of short ones, the most recent are kept."""

    def __init__(self, encode):
        super().__init__()
        self._encode, self._older = encode, {}

    def __missing__(self, piece):
        if len(piece) > CACHED_LENGTH:
            return self._encode(piece)
        if len(self) >= CACHED_PIECES:
            self._older = dict(self)
            self.clear()
        ids = self._older.get(piece)
        if ids is None:
            ids = self._encode(piece)
        self[piece] = ids
        return ids


_encoders: dict[str, PrefixEncoder] = {}  # of this Python worker, by the digest of the definition


def _encoder(definition: str) -> PrefixEncoder:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PrefixEncoder(definition)
    return _encoders[key]


OUTPUTS = {
    "n_tokens": (pa.int64(), T.LongType()),
    "ids": (pa.list_(pa.int64()), T.ArrayType(T.LongType())),
    "ids_sha256": (pa.string(), T.StringType()),
    "decoded": (pa.string(), T.StringType()),
    "decoded_sha256": (pa.string(), T.StringType()),
}


def encode_texts(
    docs: DataFrame,
    tokenizer_path: str,
    outputs: tuple[str, ...] = ("n_tokens", "ids"),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col`` and the chosen ``outputs`` for each document, without a shuffle.

    outputs: n_tokens; ids; decoded (the text decoded from the ids); ids_sha256 (of the ids
    as little-endian unsigned 32-bit integers) and decoded_sha256 (of the UTF-8 bytes), both
    lowercase hex.
    """
    unknown = set(outputs) - set(OUTPUTS)
    if unknown:
        raise ValueError(f"unknown outputs {sorted(unknown)}")
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())
    narrow = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition.value)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            rows = {name: [] for name in outputs}
            for text in batch.column("text"):
                ids = encoder.encode(text.as_py() or "")
                if sys.byteorder == "big":
                    ids.byteswap()
                if "n_tokens" in rows:
                    rows["n_tokens"].append(len(ids))
                if "ids" in rows:
                    rows["ids"].append(ids.tolist())
                if "ids_sha256" in rows:
                    rows["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
                if "decoded" in rows or "decoded_sha256" in rows:
                    decoded = encoder.decode(ids)
                    if "decoded" in rows:
                        rows["decoded"].append(decoded)
                    if "decoded_sha256" in rows:
                        rows["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            columns = [pa.array(rows[name], OUTPUTS[name][0]) for name in outputs]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", *outputs])

    fields = [T.StructField("id", narrow.schema["id"].dataType)]
    schema = T.StructType(fields + [T.StructField(name, OUTPUTS[name][1]) for name in outputs])
    return narrow.mapInArrow(encode, schema).withColumnRenamed("id", id_col)


def decode_ids(
    encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded"
) -> DataFrame:
    """Add the text of each array of ids; null ids give null."""
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = encoded.sparkSession.sparkContext.broadcast(file.read())

    @F.udf("string", useArrow=True)
    def decoded(ids):
        return None if ids is None else _encoder(definition.value).decode(ids)

    return encoded.withColumn(free_name(encoded.drop(out_col), out_col), decoded(quoted(ids_col)))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus_table(spark, sf_dir, "documents")
    return encode_texts(docs, default_tokenizer(), ("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {"op5_bpe": op5_bpe}
ORACLE: dict[str, str] = {}

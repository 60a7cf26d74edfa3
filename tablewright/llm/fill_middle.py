"""Fill-in-the-middle transformation with a set of unit boundaries.

A text's units are words with the blanks before them, blanks at the end being a unit of their
own, or code points (``unit="char"``).  The byte offsets at which units end form a
:class:`~.boundaries.BoundarySet`, filled from pieces of 64 KiB; two selects on it give both cut
offsets, so a text of any length is cut without a list of its units.  Cuts, form and order
follow from a digest of the seed and the document's id: reruns agree, and rows are
transformed where they are read, without a shuffle.

Prefix-suffix-middle: ``<P>prefix<S>suffix<M>middle``; suffix-prefix-middle:
``<S>suffix<P>prefix<M>middle``.  A text that holds a mark stays plain, so that the marks of an
output are those put there, and :func:`restore` gives the exact text back.

Defined results: a null text is the empty text, which stays plain with no units.  A null id is
hashed as an empty one.  Rows with equal ids are cut by the same numbers, repeated rows alike.
An empty table gives an empty result.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..missing import quoted
from .boundaries import WIDTH, BoundarySet
from .common import corpus_table

SEED = 42
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"  # fixed values
MARKS = (PREFIX, SUFFIX, MIDDLE)
ROWS = 256  # texts that are held with their outputs at once
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _word_ends(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Last bytes of the words, and of the blanks at the end, by containers."""
    for start in range(0, len(raw), WIDTH):
        blank = _BLANK[raw[start : start + WIDTH + 1]]  # one byte more than the container
        if start + WIDTH >= len(raw):
            blank = np.append(blank, not blank[-1])  # the last byte ends a unit in either case
            ends = ~blank[:-1] & blank[1:]
            ends[-1] = True
        else:
            ends = ~blank[:-1] & blank[1:]
        yield start // WIDTH, np.flatnonzero(ends)


def _char_ends(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Last bytes of the code points, by containers."""
    for start in range(0, len(raw), WIDTH):
        inner = (raw[start + 1 : start + WIDTH + 1] & 0xC0) == 0x80
        if start + WIDTH >= len(raw):
            inner = np.append(inner, False)
        yield start // WIDTH, np.flatnonzero(~inner)


UNITS = {"word": _word_ends, "char": _char_ends}


def unit_ends(raw: bytes, unit: str = "word") -> BoundarySet:
    """Positions of the last bytes of the units of a UTF-8 text."""
    return BoundarySet(UNITS[unit](np.frombuffer(raw, np.uint8)))


def _numbers(seed: int, doc_id) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def split_middle(raw: bytes, doc_id, seed: int = SEED, unit: str = "word") -> tuple[int, bytes, bytes, bytes]:
    """Number of units, prefix, middle and suffix of a UTF-8 text."""
    ends = unit_ends(raw, unit)
    h1, h2, _, _ = _numbers(seed, doc_id)
    cuts = (ends.select(k - 1) + 1 if k else 0 for k in sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1))))
    first, second = cuts
    return len(ends), raw[:first], raw[first:second], raw[second:]


def fill_in_middle(
    docs: DataFrame,
    rate: int = 50,
    spm_rate: int = 80,
    seed: int = SEED,
    unit: str = "word",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col, n, form, prefix_chars, middle_chars, output`` for each document.

    ``rate`` percent of the texts are cut, ``spm_rate`` percent of these with the suffix first.
    ``n`` counts units; the lengths count code points and are null for form ``plain``.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {sorted(UNITS)}")
    narrow = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))

    def transformed(doc_id, text: str) -> tuple:
        raw = text.encode()
        _, _, h3, h4 = _numbers(seed, doc_id)
        if not text or h3 % 100 >= rate or any(mark in text for mark in MARKS):
            return len(unit_ends(raw, unit)), "plain", None, None, text
        n, *parts = split_middle(raw, doc_id, seed, unit)
        prefix, middle, suffix = (part.decode() for part in parts)
        if h4 % 100 < spm_rate:
            form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        else:
            form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
        return n, form, len(prefix), len(middle), output

    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            rows = [
                transformed(doc_id.as_py(), text.as_py() or "")
                for doc_id, text in zip(batch.column("id"), batch.column("text"))
            ]
            columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(types)]
            columns[-1] = columns[-1].cast(batch.schema.field("text").type)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", *names])

    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()]
    schema = T.StructType(
        [T.StructField("id", narrow.schema["id"].dataType), *[T.StructField(*x) for x in zip(names, kinds)]]
    )
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def restored_text(output: str, form: str) -> str:
    """The text that an output was made from."""
    if form == "plain":
        return output
    order = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    first, rest = output[len(order[0]) :].split(order[1], 1)
    second, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (first, second) if form == "psm" else (second, first)
    return prefix + middle + suffix


def restore(transformed: DataFrame, out_col: str = "restored") -> DataFrame:
    """Add the exact text of each output."""

    @F.udf("string", useArrow=True)
    def text(output, form):
        return None if output is None else restored_text(output, form)

    return transformed.withColumn(out_col, text(quoted("output"), quoted("form")))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore(fill_in_middle(corpus_table(spark, sf_dir, "documents")))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), numbers AS (
  SELECT doc_id, text, units, len(units) AS n,
         ('0x' || x[1:8])::BIGINT % (len(units) + 1) AS a, ('0x' || x[9:16])::BIGINT % (len(units) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR ('0x' || x[17:24])::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || x[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT doc_id, text, n, form,
         coalesce(array_to_string(list_slice(units, 1, least(a, b)), ''), '') AS prefix,
         coalesce(array_to_string(list_slice(units, least(a, b) + 1, greatest(a, b)), ''), '') AS middle,
         coalesce(array_to_string(list_slice(units, greatest(a, b) + 1, n), ''), '') AS suffix
  FROM numbers
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

QUERIES = {"op13_fill_middle": op13_fill_middle}
ORACLE = {"op13_fill_middle": OP13_SQL}

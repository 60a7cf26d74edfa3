"""Audit of how far the sources of a language differ in their terms, in exact integers.

Tasks count the terms of their texts per (language, source) in packed buckets
(:mod:`~.packed_terms`); Spark sums the counts per (language, source, term), finds the terms that enough
documents of the language have, and compares

* each source with its language, term by term (``term``: the ten terms that stand out most);
* each source with every other source of the language over all kept terms (``pair``).

Shares are p = 1 + floor(10^9 (count + 2) / (N + 2 V)), differences f = floor((p - q)^2 / (p + q)).  A pair's
value sums f over all terms, also those that neither source has.  The kept terms of a language are
dealt to blocks of about ``BLOCK_ROWS`` rows by a hash of the term, and a block compares all its sources in
tables of at most ``CELLS`` shares.  More than ``TILE`` sources are compared in tiles, so a task holds the sums of
``TILE`` sources with all others.  Blocks yield sums, which Spark adds up.

Defined results: null text, language and source are the empty text.  Every row is a document, also with a
null or repeated id.  A source without kept terms has counts of 0.  A language without kept terms
has pairs of value 0 and no terms; one with a single source has no pairs.  An empty table gives an empty
result.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..missing import quoted
from ..session import materialize
from .common import corpus_table
from .packed_terms import group_counts

LEAST = 10  # documents of the language that a kept term is in
TOP = 10  # terms given per source
BILLION = 1_000_000_000
BLOCK_ROWS = 1 << 16
CELLS = 1 << 20
TILE = 1024


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term and documents with it."""
    names = {"lang": lang_col, "source": source_col, "text": text_col}
    narrow = docs.select(*[F.coalesce(quoted(c).cast("string"), F.lit("")).alias(n) for n, c in names.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(n).dictionary_encode() for n in ("lang", "source")]
            lang, source = (k.indices.to_numpy().astype(np.int64) for k in keys)
            group = lang * len(keys[1].dictionary) + source
            order = np.argsort(group, kind="stable")
            texts = batch.column("text").take(pa.array(order)).cast(pa.large_string())
            _, ends, data = texts.buffers()
            ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
            for lengths, letters, of, n, with_it in group_counts(raw, ends - ends[0], group[order]):
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                term = pa.LargeStringArray.from_buffers(
                    len(of), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))
                )
                columns = [k.dictionary.take(pa.array(part)) for k, part in zip(keys, np.divmod(of, len(keys[1].dictionary)))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, term.cast(batch.schema.field("text").type), pa.array(n), pa.array(with_it)],
                    names=["lang", "source", "term", "n", "docs"],
                )

    made = narrow.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str) -> Column:
    """p of a count; decimals keep it exact for any count."""
    whole = f"cast({BILLION} as decimal(10,0)) * cast({n} + 2 as decimal(20,0)) div cast({total} + 2 * v as decimal(20,0))"
    return F.expr(f"cast(1 + {whole} as bigint)")


def _difference(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def pair_sums(shares: np.ndarray, first: int, last: int) -> np.ndarray:
    """Sums over the rows (terms) of f between column ``first + i`` and every later column."""
    sums = np.zeros((last - first, shares.shape[1]), np.int64)
    for i, a in enumerate(range(first, last)):
        p, q = shares[:, a : a + 1], shares[:, a + 1 :]
        apart = p - q
        sums[i, a + 1 :] = (apart * apart // (p + q)).sum(axis=0)
    return sums


def _block_sums(block: pa.Table) -> pa.Table:
    """``lang, a, b, value`` of one tile and block: rows without term give the sources with the share of a
    term they lack, the others the shares of the terms they have."""
    head = block.filter(block["term"].is_null()).sort_by("place")
    rows = block.filter(block["term"].is_valid())
    absent = head["p"].to_numpy()
    first = TILE * block["tile"][0].as_py()
    last = min(first + TILE, len(absent))
    codes = rows["term"].combine_chunks().dictionary_encode()
    order = np.argsort(codes.indices.to_numpy(), kind="stable")
    term, place, share = (x[order] for x in (codes.indices.to_numpy(), rows["place"].to_numpy(), rows["p"].to_numpy()))
    sums = np.zeros((last - first, len(absent)), np.int64)
    step = max(1, CELLS // len(absent))
    for start in range(0, len(codes.dictionary), step):
        low, high = np.searchsorted(term, [start, start + step])
        cells = np.tile(absent, (min(step, len(codes.dictionary) - start), 1))
        cells[term[low:high] - start, place[low:high]] = share[low:high]
        sums += pair_sums(cells, first, last)
    a, b = np.nonzero(np.arange(len(absent)) > np.arange(first, last)[:, None])
    source = head["source"].combine_chunks()
    return pa.table(
        {
            "lang": block["lang"].combine_chunks().take(pa.array(np.zeros(len(a), np.int64))),
            "a": source.take(pa.array(a + first)),
            "b": source.take(pa.array(b)),
            "value": pa.array(sums[a, b]),
        }
    )


def source_divergence(
    docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """``lang, source, part, item, value, rank`` of both parts, ranked per source and part.

    Writes intermediate tables in the shared folder.
    """
    counts = materialize(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs"))
    kept = kept.where(F.col("docs") >= least).drop("docs")
    rows = materialize(counts.drop("docs").join(kept, ["lang", "term"]), "kept-terms")

    names = [F.coalesce(quoted(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col))]
    by_lang = rows.groupBy("lang").agg(
        F.sum("n").alias("lang_total"), F.countDistinct("term").alias("v"), F.count(F.lit(1)).alias("entries")
    )
    by_source = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # A row for each source of a language, numbered in the language.
    groups = docs.select(*names).distinct().join(by_lang, "lang", "left").join(by_source, ["lang", "source"], "left")
    groups = groups.fillna(0, ["lang_total", "v", "entries", "total"])
    every = Window.partitionBy("lang")
    groups = groups.withColumns(
        {"place": F.row_number().over(every.orderBy("source")) - 1, "sources": F.count(F.lit(1)).over(every)}
    )
    groups = materialize(groups, "sources")
    shares = rows.join(groups, ["lang", "source"]).withColumns({"p": _share("n", "total"), "q": _share("of_lang", "lang_total")})

    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), _difference("p", "q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    blocks = F.expr(f"greatest(1, cast(ceil(entries / {BLOCK_ROWS}) as int))")
    tiles = F.explode(F.expr(f"sequence(0, cast((sources - 1) div {TILE} as int))")).alias("tile")
    heads = groups.where("sources > 1").withColumn("p", F.when(F.col("v") > 0, _share("0", "total")).otherwise(0))
    heads = heads.select("lang", "source", "place", "sources", "p", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    heads = heads.select("lang", "source", "place", "p", F.lit(None).cast("string").alias("term"), "block", tiles)
    entries = shares.where("sources > 1").select(
        "lang", "source", "place", "p", "term", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"), tiles
    )
    sums = heads.unionByName(entries).groupBy("lang", "block", "tile").applyInArrow(
        _block_sums, "lang string, a string, b string, value long"
    )
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")])
    pairs = sums.select("lang", F.explode(both).alias("of"), "value").select("lang", "of.*", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    columns = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", "value", "rank"]
    return pairs.select(*columns("pair")).unionByName(terms.select(*columns("term")))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(corpus_table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), words AS (
  SELECT r, lang, source, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS of_lang FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}
), groups AS (
  SELECT DISTINCT lang, source FROM d
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words GROUP BY lang, source, term
), every AS (
  SELECT groups.lang, groups.source, kept.term, coalesce(n, 0)::HUGEINT AS n, of_lang::HUGEINT AS of_lang
  FROM groups JOIN kept ON groups.lang = kept.lang
  LEFT JOIN counts ON counts.lang = groups.lang AND counts.source = groups.source AND counts.term = kept.term
), shares AS (
  SELECT lang, source, term, n,
         1 + {BILLION}::HUGEINT * (n + 2) // (sum(n) OVER g + 2 * count(*) OVER g) AS p,
         1 + {BILLION}::HUGEINT * (of_lang + 2) // (sum(of_lang) OVER g + 2 * count(*) OVER g) AS q
  FROM every WINDOW g AS (PARTITION BY lang, source)
), differences AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares AS a JOIN shares AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN differences AS x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER FROM terms
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""

QUERIES = {"op12_divergence": op12_divergence}
ORACLE = {"op12_divergence": OP12_SQL}

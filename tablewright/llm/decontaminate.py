"""Benchmark decontamination by winnowing, with DataFrame operations only.

A window is a run of ten item words, or all words of a shorter item.  The fingerprint of a window
is the smallest hash of its k-grams, six of them (k = 5 for ten words): any text that contains
the window has the same minimum at that place, so texts and windows that share a window share a
fingerprint, and a text keeps about two fingerprints in seven words.

1. Texts are cut into pieces of 1024 window starts that overlap by the rest of a window, so a
   very long text is many rows; fingerprints are computed in the row.
2. Fingerprints of the texts are joined with those of the windows (semi join: one row per fingerprint
   and piece, however many items have it).  Up to ``broadcast_rows`` window fingerprints are
   broadcast, and neither texts nor fingerprints are shuffled; beyond that the fingerprints are
   shuffled, and pieces with hits are read again.
3. Hits are extended: each window start of a piece with that fingerprint gives its words, which
   are joined with the words of the windows.  No hash decides a result.

Hits are kept per distinct text, so copies are one group, and each step before a shuffle is combined
first.  Windows that occur in the same items form a class, and the items of a text follow from its
classes, once per distinct set of classes.

Defined results: null and empty texts have no words and are never contaminated.  Items without words
match nothing.  A null item id counts as an item named by the empty text; rows with the same
item id are one item.  Null and repeated document ids and repeated rows give a row each.  An empty
table on either side gives no hits.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..missing import quoted
from ..session import materialize
from .common import corpus_table
from .exact_dedup import text_digest

LENGTH = 10  # words of a window
GRAMS = 6  # k-grams of a window
STEP = 1024  # window starts of a piece
# What stands between words, after and before A-Z are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column, lower: bool = True) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    if not lower:
        return F.array_remove(F.split(text, NOT_WORD_RAW), "")
    folded = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(folded, NOT_WORD), "")


def _pieces(texts: DataFrame, *keep: str) -> DataFrame:
    """Rows ``keep, at, w``: the words from ``at`` on that the window starts of a piece need.
    A column ``marks`` of ``texts`` is reduced to the marks of the piece; others go."""
    part = lambda at: F.struct(
        at.alias("at"),
        F.slice("words", at + 1, STEP + LENGTH - 1).alias("w"),
        *([F.filter("marks", lambda m: m["at"] == at).alias("marks")] if "marks" in texts.columns else []),
    )
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(STEP))
    found = texts.where(F.size("words") > 0).select(*keep, F.explode(F.transform(starts, part)).alias("piece"))
    return found.select(*keep, "piece.*")


def _shape(length: int) -> tuple[int, int]:
    """Words of a gram and grams of a window of ``length`` words."""
    grams = min(GRAMS, length)
    return length - grams + 1, grams


def _grams(length: int) -> Column:
    """Hashes of all grams of a piece, from the hashes ``h`` of its words."""
    k, _ = _shape(length)
    if k == 1:
        return F.transform("h", lambda x: F.xxhash64(F.lit(length), x))
    hashed = lambda i: F.xxhash64(F.lit(length), *[F.get("h", i + j) for j in range(k)])
    made = F.transform(F.sequence(F.lit(0), F.size("h") - k), hashed)
    return F.when(F.size("h") >= k, made).otherwise(F.array().cast("array<bigint>"))


def _least(length: int) -> Column:
    """Fingerprints of the windows of a piece, by window start, from its gram hashes."""
    _, grams = _shape(length)
    name = f"g{length}"
    if grams == 1:
        return F.slice(name, 1, STEP)
    least = lambda i: F.least(*[F.get(name, i + j) for j in range(grams)])
    starts = F.sequence(F.lit(0), F.least(F.lit(STEP), F.size(name) - grams + 1) - 1)
    return F.when(F.size(name) >= grams, F.transform(starts, least)).otherwise(F.array().cast("array<bigint>"))


def _fingerprinted(pieces: DataFrame, lengths: list[int]) -> DataFrame:
    """Add ``f<length>``, the fingerprints by window start, for each length."""
    hashed = pieces.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    grams = hashed.withColumns({f"g{n}": _grams(n) for n in lengths})
    return grams.withColumns({f"f{n}": _least(n) for n in lengths}).drop("h", *[f"g{n}" for n in lengths])


def _window(start: Column, length: int) -> Column:
    return F.array_join(F.slice("w", start + 1, length), " ")


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows ``item, length, fingerprint, window``, each once: the windows of the items."""
    words = items.select(F.coalesce(quoted(id_col).cast("string"), F.lit("")).alias("item"), _words(quoted(text_col)).alias("words"))
    words = words.withColumn("length", F.least(F.size("words"), F.lit(LENGTH)))
    lengths = sorted(r["length"] for r in words.where("length > 0").select("length").distinct().collect())  # ten at most
    pieces = _fingerprinted(_pieces(words, "item", "length"), lengths)
    out = None
    for n in lengths:
        cells = F.transform(f"f{n}", lambda v, i: F.struct(v.alias("fingerprint"), _window(i, n).alias("window")))
        rows = pieces.where(F.col("length") == n).select("item", "length", F.explode(cells).alias("cell")).select("item", "length", "cell.*")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return items.sparkSession.createDataFrame([], "item string, length int, fingerprint long, window string")
    return out.distinct()


def _candidates(texts: DataFrame, prints: DataFrame, lengths: list[int], broadcast_rows: int) -> DataFrame:
    """Pieces with a fingerprint in ``prints``: ``digest, at, w, f<length>..., length, fingerprint``."""
    each = [F.transform(F.array_distinct(f"f{n}"), lambda x: F.struct(F.lit(n).alias("length"), x.alias("fingerprint"))) for n in lengths]
    made = _fingerprinted(_pieces(texts, "digest"), lengths)
    carried = ["digest", "at", "w", *[f"f{n}" for n in lengths]]
    if prints.count() <= broadcast_rows:
        rows = made.select(*carried, F.explode(F.concat(*each)).alias("mark")).select(*carried, "mark.*")
        return rows.join(F.broadcast(prints), "fingerprint", "left_semi")
    rows = made.select("digest", "at", F.explode(F.concat(*each)).alias("mark")).select("digest", "at", "mark.*")
    found = rows.join(prints.hint("merge"), "fingerprint", "left_semi").groupBy("digest").agg(
        F.collect_set(F.struct("at", "length", "fingerprint")).alias("marks")
    )
    again = texts.join(materialize(found, "marks"), "digest")
    made = _fingerprinted(_pieces(again, "digest").where(F.size("marks") > 0), lengths)
    rows = made.select(*carried, F.explode("marks").alias("mark"))
    return rows.select(*carried, "mark.length", "mark.fingerprint")


def _extended(candidates: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows ``digest, start, stop, window`` of all window starts with the fingerprint."""
    start = lambda i: F.col("at") + i
    found = [
        F.when(
            F.col("length") == n,
            F.array_compact(
                F.transform(
                    f"f{n}",
                    lambda v, i: F.when(
                        v == F.col("fingerprint"),
                        F.struct(start(i).alias("start"), (start(i) + n).alias("stop"), _window(i, n).alias("window")),
                    ),
                )
            ),
        )
        for n in lengths
    ]
    return candidates.select("digest", F.explode(F.coalesce(*found)).alias("cell")).select("digest", "cell.*")


def _classes(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``window, items``: the class of each window, and ``items, item``: what a class stands for.

    Windows of the same items have the same number of items and the same combined hashes."""
    seen = F.concat_ws(
        ":", F.count(F.lit(1)), F.expr("bit_xor(xxhash64(item))"), F.expr("bit_xor(xxhash64(item, 1))")
    )
    classes = materialize(windows.groupBy("window").agg(seen.alias("items")), "classes")
    one = classes.groupBy("items").agg(F.min("window").alias("window"))
    return classes, materialize(windows.join(one, "window").select("items", "item"), "class-items")


def _covered(spans: str) -> Column:
    """Number of words in a sorted array of spans."""
    none = F.struct(F.lit(0).alias("stop"), F.lit(0).cast("bigint").alias("n"))
    more = lambda so_far, x: F.struct(
        F.greatest(so_far["stop"], x["stop"]).alias("stop"),
        (so_far["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(so_far["stop"], x["start"]))).alias("n"),
    )
    return F.aggregate(spans, none, more, lambda so_far: so_far["n"])


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_rows: int = 1 << 20,
) -> DataFrame:
    """One row per document: ``id_col, n_words, n_hit`` (words inside any item window),
    ``n_items, items`` (sorted ids of the items with windows in it, as strings).

    Writes intermediate tables in the shared folder.
    """
    windows = materialize(item_windows(items, item_id_col, item_text_col), "windows")
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # ten at most
    base = docs.select(
        quoted(id_col).alias(id_col),
        text_digest(quoted(text_col)).alias("digest"),
        F.size(_words(quoted(text_col), lower=False)).cast("bigint").alias("n_words"),
    )
    if not lengths:
        return base.select(
            quoted(id_col),
            "n_words",
            F.lit(0).cast("bigint").alias("n_hit"),
            F.lit(0).cast("bigint").alias("n_items"),
            F.array().cast("array<string>").alias("items"),
        )
    texts = docs.select(text_digest(quoted(text_col)).alias("digest"), _words(quoted(text_col)).alias("words"))
    prints = materialize(windows.select("fingerprint").distinct(), "fingerprints")
    classes, class_items = _classes(windows.select("window", "item"))
    met = _extended(_candidates(texts, prints, lengths, broadcast_rows), lengths).join(classes, "window")
    spans = F.array_sort(F.collect_set(F.struct("start", "stop")))
    by_text = met.groupBy("digest").agg(spans.alias("spans"), F.array_sort(F.collect_set("items")).alias("classes"))
    named = F.sha2(F.array_join("classes", ","), 256).alias("named")
    by_text = materialize(by_text.select("digest", _covered("spans").alias("n_hit"), "classes", named), "text-hits")
    sets = by_text.groupBy("named").agg(F.first("classes").alias("classes"))
    listed = sets.select("named", F.explode("classes").alias("items")).join(class_items, "items")
    listed = listed.groupBy("named").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = materialize(by_text.drop("classes").join(listed, "named").drop("named"), "hits")
    none = F.array().cast("array<string>")
    return base.join(hits, "digest", "left").select(
        quoted(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", none).alias("items"),
    )


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(corpus_table(spark, sf_dir, "documents"), corpus_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT item, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i
        FROM (SELECT item, w, least(len(w), {LENGTH}) AS size FROM b) WHERE size > 0)
), starts AS (
  SELECT r, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i
        FROM d JOIN (SELECT DISTINCT size FROM windows) AS sizes ON len(w) >= size)
), hits AS (
  SELECT r, i, starts.size, item FROM starts JOIN windows USING (win)
), covered AS (
  SELECT r, count(DISTINCT word) AS n_hit
  FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS word FROM (SELECT DISTINCT r, i, size FROM hits)) GROUP BY r
), listed AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""

QUERIES = {"op11_decontaminate": op11_decontaminate}
ORACLE = {"op11_decontaminate": OP11_SQL}

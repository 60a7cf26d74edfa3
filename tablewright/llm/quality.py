"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every text.  The votes of the
whole corpus are counted per vote pattern (3 to the power of the number of labellers at
most, 2187 rows), and expectation-maximisation over these counts estimates the accuracy of
each labeller in each class and the share of good texts.  Posteriors of a bounded sample,
``train_rows`` documents in expectation, picked by a hash of id and text, train a logistic scorer
on hashed features; the scorer then judges every document.

Features are computed with numpy over the bytes of the text: hashed three-byte windows over
character classes (case, digits, blanks, each punctuation mark) and a marker for words
that repeat the word before them.  Each feature is a share of the text's windows, so a score is one
sum over the text; texts go through in pieces of a mebibyte, whatever their length, cut before
blanks and overlapping by a word.

Defined results: a null or blank text has no feature and the score of an empty text, which
is kept.  Null ids and repeated rows are scored like any other; an
empty table gives an empty result; a corpus in which no labeller votes keeps everything.
:func:`score_documents` adds its columns under names that the table does not use yet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..missing import quoted
from .common import BLANK_RUN, BLANKS, corpus_table, free_name
from .exchange import mix64

GOOD, BAD, ABSTAIN = 1, 0, -1
TRAIN_ROWS = 4000  # expected size of the training sample
THRESHOLD = 0.3  # documents with a lower probability of being good are rejected
DIMENSIONS = 1 << 14
PIECE = 1 << 20  # bytes of text that are turned into features at once
_MARKS = r"[!@#$%^&*|~<>=+_{}\[\]\\/]"


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(BAD)).when(good, F.lit(GOOD)).otherwise(F.lit(ABSTAIN)).cast("int")


LABELLERS = ("marks", "tails", "repeats", "capitals", "variety", "sentences", "lines")


def labeller_votes(texts: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text column, which holds no null, by the labellers' votes.

    The measures are named in one projection and judged in the next, so each is taken once.
    """
    t = F.col(text)
    others = [quoted(c) for c in texts.columns if c != text]

    def found(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern))

    words, lines = F.split(F.btrim(t, F.lit(BLANKS)), BLANK_RUN), F.split(t, "\n")
    measured = texts.select(
        *others,
        F.length(t).alias("chars"),
        found(_MARKS).alias("marks"),
        found("[A-Z]").alias("capitals"),
        found(r"\.").alias("stops"),
        found(r"[!#$%&*|](?:\s|$)").alias("tails"),
        found(r"(?<!\S)(\S+) \1(?!\S)").alias("repeats"),
        F.size(words).alias("n"),
        F.size(F.array_distinct(words)).alias("distinct"),
        F.size(lines).alias("n_lines"),
        F.size(F.array_distinct(lines)).alias("distinct_lines"),
    )
    n, chars, n_lines = F.col("n"), F.col("chars"), F.col("n_lines")
    marks, stops, tails = F.col("marks") / n, F.col("stops") / n, F.col("tails") / n
    capitals = F.col("capitals") / F.greatest(chars, F.lit(1))
    repeats, variety, fresh = F.col("repeats") / n, F.col("distinct") / n, F.col("distinct_lines") / n_lines
    votes = {
        "marks": _vote(marks <= 0.02, marks >= 0.2),
        "tails": _vote((n >= 5) & (tails <= 0.02), (n >= 5) & (tails >= 0.2)),
        "repeats": _vote((n >= 20) & (repeats <= 0.05), (n >= 20) & (repeats >= 0.2)),
        "capitals": _vote((n >= 5) & (capitals <= 0.08), (n >= 5) & (capitals >= 0.3)),
        "variety": _vote((n >= 20) & (variety >= 0.4), (n >= 20) & (variety <= 0.15)),
        "sentences": _vote((n >= 15) & stops.between(0.02, 0.35), (n >= 25) & (stops < 0.008)),
        "lines": _vote((n_lines >= 5) & (fresh >= 0.95), (n_lines >= 5) & (fresh <= 0.5)),
    }
    return measured.select(*others, *[votes[name].alias(name) for name in LABELLERS])


@dataclass(frozen=True)
class LabelModel:
    """``prior``: share of good texts; ``right[class, labeller]``: chance that a vote on a text
    of that class (0 bad, 1 good) is right."""

    prior: float
    right: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        good, bad = votes == GOOD, votes == BAD
        r = self.right
        log_good = np.log(self.prior) + good @ np.log(r[1]) + bad @ np.log(1 - r[1])
        log_bad = np.log(1 - self.prior) + bad @ np.log(r[0]) + good @ np.log(1 - r[0])
        return 1 / (1 + np.exp(np.clip(log_bad - log_good, -500, 500)))


def fit_label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts.

    Each labeller looks for one kind of fault, so it counts as right on nine good texts of ten
    at least, and on no more than half of the bad ones; this also fixes which class is the good
    one, and keeps several labellers of one fault from outvoting those of another.  Abstaining
    says nothing.
    """
    voted = (votes != ABSTAIN).any(axis=1)
    votes, counts = votes[voted], counts[voted].astype(float)
    k = votes.shape[1]
    model = LabelModel(0.8, np.stack([np.full(k, 0.35), np.full(k, 0.95)]))
    if not len(votes):
        return model
    good, bad, p = (votes == GOOD).astype(float), (votes == BAD).astype(float), model.posterior(votes)
    for _ in range(rounds):
        w_good, w_bad = counts * p, counts * (1 - p)
        prior = (w_good.sum() + 1) / (counts.sum() + 2)
        right_bad = (w_bad @ bad + 1) / (w_bad @ (good + bad) + 3)
        right_good = (w_good @ good + 4) / (w_good @ (good + bad) + 5)
        right = np.stack([np.clip(right_bad, 0.1, 0.5), np.clip(right_good, 0.9, 0.995)])
        model = LabelModel(float(np.clip(prior, 0.01, 0.99)), right)
        new = model.posterior(votes)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return model


def _class_table() -> np.ndarray:
    """Class of each byte: lower case and bytes beyond ASCII 1, capitals 2, digits 3, space 4, other
    blanks 5, other controls 6, each punctuation mark its own."""
    table = np.full(256, 6, np.int64)
    table[0x80:] = 1
    for chars, code in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" ", 4), (b"\t\n\r\x0b\x0c", 5)):
        table[list(chars)] = code
    marks = [b for b in range(0x21, 0x7F) if table[b] == 6]
    table[marks] = np.arange(7, 7 + len(marks))
    return table


_CLASS = _class_table()
_BLANK, _LAST_WORD = re.compile(rb"[ \t-\r]"), re.compile(rb"[^ \t-\r]+\Z")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_REPEAT = DIMENSIONS  # the marker's place, after the hashed windows


def window_features(piece: bytes, skip: int = 0) -> np.ndarray:
    """Feature numbers of a piece of text: one for each three-byte window but the first ``skip``, one for
    each word that equals the word before it."""
    raw = np.frombuffer(piece, np.uint8)
    codes = _CLASS[raw]
    if len(raw) < 3:
        return np.empty(0, np.int64)
    keys = (codes[:-2] * 64 + codes[1:-1]) * 64 + codes[2:]
    hashed = (keys.astype(np.uint64) * _ODD) >> np.uint64(64 - (DIMENSIONS.bit_length() - 1))
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    repeats = 0
    if len(starts) > 1:
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _position_keys(starts, ends, len(raw)))))
        words = sums[ends] - sums[starts]
        repeats = int(np.count_nonzero((words[1:] == words[:-1]) & (np.diff(ends - starts) == 0)))
    return np.concatenate([hashed[skip:].astype(np.int64), np.full(repeats, _REPEAT, np.int64)])


def _position_keys(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """A number for each byte that depends on its place in its word."""
    place = np.zeros(n, np.int64)
    lengths = ends - starts
    inside = np.repeat(starts, lengths)
    at = np.arange(len(inside)) + np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    place[at] = at - inside + 1
    return mix64(place.astype(np.uint64) * _ODD)


def _pieces(text: str) -> Iterator[tuple[bytes, int]]:
    """Pieces of about PIECE bytes that end before a blank, and how many of their first windows belong to
    the piece before: each begins with the last word of that piece, so no window and no repeated
    word is lost or counted twice."""
    raw, start, back = text.encode(), 0, 0
    while True:
        blank = _BLANK.search(raw, start + PIECE)
        if not blank:
            yield raw[back:], start - back
            return
        end = blank.start()
        yield raw[back:end], start - back
        last = _LAST_WORD.search(raw[back:end].rstrip())
        start, back = end - 2, min(back + last.start() if last else end, end - 2)


def text_shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sparse feature vector: places and shares of the text's windows."""
    counts, total = np.zeros(DIMENSIONS + 1), 0
    for piece, skip in _pieces(text):
        found = window_features(piece, skip)
        counts += np.bincount(found, minlength=DIMENSIONS + 1)
        total += max(0, len(piece) - 2 - skip)
    places = np.flatnonzero(counts)
    return places, counts[places] / max(1, total)


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float

    def probability(self, text: str) -> float:
        """Probability that the text is good."""
        score, total = 0.0, 0
        for piece, skip in _pieces(text):
            score += float(self.weights[window_features(piece, skip)].sum())
            total += max(0, len(piece) - 2 - skip)
        if not total:
            return 1.0
        return 1 / (1 + float(np.exp(-np.clip(score / total + self.bias, -30, 30))))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, rounds: int = 300) -> Scorer:
    """Logistic regression on soft labels, full-batch Adagrad with features scaled to unit spread."""
    if not rows:
        return Scorer(np.zeros(DIMENSIONS + 1), 10.0)
    n = len(rows)
    doc = np.repeat(np.arange(n), [len(p) for p, _ in rows])
    place, share = np.concatenate([p for p, _ in rows]), np.concatenate([s for _, s in rows])
    mean = np.bincount(place, share, DIMENSIONS + 1) / n
    spread = np.sqrt(np.maximum(np.bincount(place, share**2, DIMENSIONS + 1) / n - mean**2, 0))
    scale = np.where(spread > 0, 1 / (spread + 1e-4), 0)
    value = share * scale[place]
    offset = mean * scale
    w, bias, seen, seen_bias = np.zeros(DIMENSIONS + 1), 0.0, np.full(DIMENSIONS + 1, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(doc, value * w[place], n) - offset @ w + bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - good
        slope = (np.bincount(place, value * error[doc], DIMENSIONS + 1) - offset * error.sum()) / n + 1e-3 * w
        seen += slope**2
        seen_bias += error.mean() ** 2
        w -= 0.1 * slope / np.sqrt(seen)
        bias -= 0.1 * error.mean() / np.sqrt(seen_bias)
    return Scorer(w * scale, float(bias - offset @ w))


def fit_quality_model(
    docs: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[LabelModel, Scorer]:
    """Label model from the votes on all documents, scorer from the sample's posteriors.

    The driver receives the vote pattern counts and the sample's sparse vectors, both bounded.
    """
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    texts = docs.select(quoted(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("digest"))
    names = list(LABELLERS)
    voted = labeller_votes(texts.select("text"))
    patterns = sorted(tuple(r) for r in voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect())
    table = np.array(patterns, dtype=np.int64).reshape(-1, len(names) + 1)
    model = fit_label_model(table[:, :-1], table[:, -1])
    total = int(table[:, -1].sum())

    share = min(1.0, train_rows / max(1, total))
    # Rows of one id are drawn one by one; repeated rows, however many, are one.
    draw = F.pmod(F.xxhash64("id", "digest", F.lit(11)), F.lit(1 << 30))
    chosen = texts.where(draw < int(share * (1 << 30))).dropDuplicates(["id", "digest"])
    chosen = chosen.select("text", F.col("text").alias("whole"))
    sample = labeller_votes(chosen).withColumnRenamed("whole", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_shares(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p.astype(np.int32) for p, _ in found], pa.list_(pa.int32())),
                    pa.array([s for _, s in found], pa.list_(pa.float64())),
                    pa.array(np.stack([batch.column(k).to_numpy(False) for k in names], axis=1).tolist() if len(found) else [], pa.list_(pa.int32())),
                ],
                names=["places", "shares", "votes"],
            )

    made = sample.mapInArrow(run, "places array<int>, shares array<double>, votes array<int>").toArrow()
    rows = [
        (np.asarray(p.as_py() or [], np.int64), np.asarray(s.as_py() or [], float), v.as_py())
        for p, s, v in zip(made["places"], made["shares"], made["votes"])
    ]
    rows = [r for r in rows if any(v != ABSTAIN for v in r[2])]
    rows.sort(key=lambda r: (r[0].tobytes(), r[1].tobytes(), r[2]))  # the order of tasks must not matter
    good = model.posterior(np.array([r[2] for r in rows]).reshape(-1, len(names)))
    return model, fit_scorer([r[:2] for r in rows], good)


def score_documents(docs: DataFrame, scorer: Scorer, text_col: str = "text", out_col: str = "p_good") -> DataFrame:
    """Add ``out_col``, the probability that the document is good; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast((scorer.weights, scorer.bias))  # 131 kB

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        judge = Scorer(*sent.value)
        return pd.Series([judge.probability(t) for t in texts], dtype=float)

    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    return docs.withColumn(out_col, probability(text))


def keep_good(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    train_rows: int = TRAIN_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The documents that the classifier trained on ``docs`` does not reject."""
    _, scorer = fit_quality_model(docs, train_rows, id_col, text_col)
    mark = free_name(docs, "p_good")
    scored = score_documents(docs, scorer, text_col, mark)
    return scored.where(F.col(mark) >= threshold).select(*[quoted(c) for c in docs.columns])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus_table(spark, sf_dir, "documents").select("doc_id", "text")
    _, scorer = fit_quality_model(docs)
    scored = score_documents(docs, scorer)
    return scored.select("doc_id", F.round("p_good", 6).alias("p_good"), (F.col("p_good") >= THRESHOLD).alias("keep"))


QUERIES = {"op1_quality": op1_quality}
ORACLE: dict[str, str] = {}

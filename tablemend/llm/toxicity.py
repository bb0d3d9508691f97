"""Toxicity as ordered severity: cumulative-link regression on sparse words.

P(grade > k) = sigmoid(w . x - cut_k) for k = 0 … K - 1: one weight vector for all
thresholds, cuts kept in order by construction (the first, then positive steps).
The expected severity is the sum of these probabilities.  x holds 1 + ln(count) of
the words (letters and digits, A-Z lower-cased) that go with the grade in the
labelled sample, and of word beginnings of 4 to 6 bytes, since compounds share them; each is
known by 64 bits of its hash, so no two share a weight.

The model is fitted on at most ``max_rows`` labelled documents (twice that where ids repeat), drawn by a hash of
their id, and on the ``MAX_WORDS`` words that go best with the grade; everything else reads all documents and whole
texts.  The sample's words are counted and tested on the executors: what reaches the driver are the counts of those
words, never texts, so its size does not depend on the lengths of documents.

Nulls and edge cases: null and empty texts have no words and get the severity of the
intercept; labelled rows without a grade, or without a document, are left out; different
labels or texts of one id all count, repeated rows once; without labelled rows every severity is 0, with a single
grade it is that grade; an empty table gives no rows.  Columns besides ``doc_id`` and
``text`` may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemend.llm.common import stage
from tablemend.llm.textvec import chunks, stems

MAX_ROWS = 4_000
MAX_WORDS = 4_096
#: A word counts if so many labelled documents have it, and its share of toxic ones is so many standard errors off.
FEWEST, ERRORS = 8, 6
#: P(grade > 0) from which a document is rejected; clean documents stay far below.
THRESHOLD = 0.2
#: Bytes of the word beginnings that count besides whole words: compounds share them.
BEGINNINGS = (4, 5, 6)


#: (row, word, count) of the distinct words of each row.
Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def word_counts(texts: pa.Array):
    """(rows, row, word, count) of chunks of texts: the distinct words of each row."""
    for lo, hi, data, offs in chunks(texts):
        row, word = stems(data, offs, BEGINNINGS)
        order = np.lexsort((word, row))
        row, word = row[order], word[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
        at = np.flatnonzero(new)
        yield hi - lo, row[at], word[at], np.diff(np.append(at, len(row)))


def all_counts(texts: pa.Array) -> Counts:
    rows, kinds, counts, at = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], 0
    for size, row, word, count in word_counts(texts):
        rows.append((row + at).astype(np.int32))
        kinds.append(word)
        counts.append(count.astype(np.int32))
        at += size
    return np.concatenate(rows), np.concatenate(kinds), np.concatenate(counts)


@dataclass(frozen=True)
class Severity:
    """words: sorted hashes; cuts: ascending."""

    words: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, texts: pa.Array) -> np.ndarray:
        """P(grade > k), one row per text and one column per cut."""
        z = []
        for lo, hi, data, offs in chunks(texts):
            row, word = stems(data, offs, BEGINNINGS)
            at = np.searchsorted(self.words, word)
            known = np.zeros(len(word), bool)
            if len(self.words):
                known = self.words[np.minimum(at, len(self.words) - 1)] == word
            row, at = row[known], at[known]
            pairs, count = np.unique(row * (len(self.words) + 1) + at, return_counts=True)
            r, w = pairs // (len(self.words) + 1), pairs % (len(self.words) + 1)
            z.append(np.bincount(r, self.weights[w] * (1 + np.log(count)), minlength=hi - lo))
        score = np.concatenate(z) if z else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts[None, :], -40, 40)))


def associated_words(row: np.ndarray, word: np.ndarray, positive: np.ndarray, most: int) -> np.ndarray:
    """The words whose share of positive documents is far from the sample's."""
    if not len(word):
        return word
    kinds, where = np.unique(word, return_inverse=True)
    n = np.bincount(where)
    hit = np.bincount(where, positive[row].astype(float))
    base = positive.mean()
    z = np.abs(hit - n * base) / np.sqrt(np.maximum(1e-9, n * base * (1 - base)))
    z[(n < FEWEST) | (z < ERRORS)] = 0
    best = np.lexsort((kinds, -z))[:most]
    return np.sort(kinds[best[z[best] > 0]])


def fit(counts: Counts, grade: np.ndarray, grades: int, steps: int = 400, ridge: float = 2e-5) -> Severity:
    """``grade`` holds 0 … grades - 1.  Full-batch gradient descent with Adam's step sizes."""
    empty = np.zeros(0, np.uint64)
    share = [float(np.mean(grade > k)) if len(grade) else 0.0 for k in range(grades - 1)]
    # A grade that nobody exceeds, or everybody, still gets a finite cut.
    start = -np.log((np.clip(share, 1e-9, 1 - 1e-9)) / (1 - np.clip(share, 1e-9, 1 - 1e-9)))
    if len(np.unique(grade)) < 2:
        return Severity(empty, np.zeros(1), start)
    row, word, count = counts
    chosen = associated_words(row, word, grade > 0, MAX_WORDS)
    if not len(chosen):
        return Severity(empty, np.zeros(1), start)
    col = np.minimum(np.searchsorted(chosen, word), len(chosen) - 1)
    known = chosen[col] == word
    row, col, x = row[known], col[known], 1 + np.log(count[known])
    d, k, n = len(chosen), grades - 1, len(grade)
    over = (grade[:, None] > np.arange(k)[None, :]).astype(float)
    gap = np.log(np.expm1(np.maximum(1e-3, np.diff(start)))) if k > 1 else np.zeros(0)
    theta = np.concatenate([np.zeros(d), start[:1], gap])
    m, v = np.zeros(len(theta)), np.zeros(len(theta))
    for t in range(1, steps + 1):
        w, first, steps_up = theta[:d], theta[d], theta[d + 1:]
        cuts = first + np.concatenate([[0.0], np.cumsum(np.logaddexp(0, steps_up))])
        z = np.bincount(row, w[col] * x, minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts[None, :], -40, 40)))
        upper = np.concatenate([np.ones((n, 1)), p], axis=1)
        lower = np.concatenate([p, np.zeros((n, 1))], axis=1)
        own = np.maximum(1e-12, np.take_along_axis(upper - lower, grade[:, None], 1))
        # d log(P_g) / d z_j is +p(1-p) for the cut below the grade, -p(1-p) for the one above.
        slope = np.zeros((n, k))
        at_cut = np.arange(k)[None, :]
        slope += (at_cut == grade[:, None] - 1) * (p * (1 - p) / own)
        slope -= (at_cut == grade[:, None]) * (p * (1 - p) / own)
        dz, dcut = -slope.sum(1) / n, slope.sum(0) / n
        dgap = np.array([dcut[j + 1:].sum() / (1 + np.exp(-steps_up[j])) for j in range(k - 1)])
        g = np.concatenate([np.bincount(col, dz[row] * x, minlength=d) + ridge * w, [dcut.sum()], dgap])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    cuts = theta[d] + np.concatenate([[0.0], np.cumsum(np.logaddexp(0, theta[d + 1:]))])
    # One weight more than words: the place that unknown words point to.
    return Severity(chosen, np.append(theta[:d], 0.0), cuts)


def graded_by_amount(counts: Counts, toxic: np.ndarray) -> np.ndarray:
    """Three grades where labels have two: toxic documents are split at the median amount of toxic words."""
    grade = (toxic > 0).astype(np.int64)
    if not len(grade) or grade.min() == grade.max():
        return grade
    row, word, count = counts
    chosen = associated_words(row, word, grade > 0, MAX_WORDS)
    marked = np.isin(word, chosen)
    amount = np.bincount(row[marked], 1 + np.log(count[marked]), minlength=len(grade))
    return grade + ((grade > 0) & (amount > np.median(amount[grade > 0]))).astype(np.int64)


def labelled_sample(docs: DataFrame, labels: DataFrame, grade: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """row (from 0), y, text of labelled documents; the labels are drawn before they meet the texts, in one scan."""
    known = labels.filter(labels[grade].isNotNull() & labels["doc_id"].isNotNull())
    first = known.select(known["doc_id"].alias("__id"), known[grade].cast("int").alias("y")).orderBy(
        F.xxhash64("__id"), "__id", "y").limit(max_rows)
    key = ["__id", "y", "__text"]
    met = docs.join(F.broadcast(first), docs["doc_id"] == F.col("__id")).select(
        "__id", "y", F.xxhash64(docs["text"]).alias("__text"), docs["text"].alias("text"))
    found = stage(met.groupBy(*key).agg(F.first("text").alias("text")), "toxicity-found")
    # Keys alone are ordered and cut: one id may have any number of texts.
    cut = found.select(*key).orderBy(*key).limit(2 * max_rows)
    numbered = stage(cut.withColumn("row", F.row_number().over(Window.orderBy(*key)) - 1), "toxicity-keys")
    return found.join(F.broadcast(numbered), key).select("row", "y", "text")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns row, y, text: the distinct words of each row, with their counts."""
    for batch in batches:
        rows, grades, at = batch.column(0).to_numpy(), batch.column(1).to_numpy(), 0
        for size, row, word, count in word_counts(batch.column(2)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[at + row], pa.int32()), pa.array(grades[at + row], pa.int32()),
                 pa.array(word.view(np.int64)), pa.array(count.astype(np.int32))], ["row", "y", "word", "count"])
            at += size


def associated_counts(words: DataFrame, n_rows: int, n_positive: int) -> Counts:
    """The counts (row, y, word, count) of the words that :func:`associated_words` finds, tested where they are."""
    base = n_positive / max(1, n_rows)
    tested = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") > 0).alias("hit")).filter(F.col("n") >= FEWEST)
    error = F.sqrt(F.greatest(F.lit(1e-9), F.col("n") * base * (1 - base)))
    off = tested.withColumn("z", F.abs(F.col("hit") - F.col("n") * base) / error).filter(F.col("z") >= 0.999 * ERRORS)
    unsigned = F.col("word").bitwiseXOR(F.lit(-(1 << 63)))
    best = off.orderBy(F.desc("z"), unsigned).limit(MAX_WORDS).select("word")
    table = words.join(F.broadcast(best), "word").select("row", "word", "count").toArrow()
    row, word, count = (table[c].to_numpy() for c in ("row", "word", "count"))
    word = word.view(np.uint64)
    order = np.lexsort((word, row))
    return row[order], word[order], count[order]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Severity:
    """A model of three grades from labels ``toxic`` 0 / 1."""
    sample = labelled_sample(docs, labels, "toxic", max_rows)
    grade = np.array([y for _, y in sorted((r["row"], r["y"]) for r in sample.select("row", "y").collect())], np.int64)
    words = stage(sample.mapInArrow(_counted, "row int, y int, word long, count int"), "toxicity-words")
    counts = associated_counts(words, len(grade), int((grade > 0).sum()))
    return fit(counts, graded_by_amount(counts, grade), 3)


def severity(text: Column, model: Severity) -> Column:
    """array of P(grade > k)."""
    @F.arrow_udf("array<double>")
    def score(texts: pa.Array) -> pa.Array:
        p = model.above(texts)
        ends = np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(p.ravel(), pa.float64()))

    return score(text)


def judge(docs: DataFrame, model: Severity, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with __above, __severity (expected grade) and __toxic (P(grade > 0) of ``threshold`` or more)."""
    scored = docs.withColumn("__above", severity(docs["text"], model))
    expected = F.aggregate("__above", F.lit(0.0), lambda a, x: a + x)
    return scored.withColumn("__severity", expected).withColumn("__toxic", F.element_at("__above", 1) >= threshold)

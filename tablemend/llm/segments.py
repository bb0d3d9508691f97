"""Exact top-k search by inner product with segment statistics, coarse to fine.

For vectors q and x cut into segments of l components with means m and deviations s,
|q - x|^2 >= sum of l * ((m_q - m_x)^2 + (s_q - s_x)^2), and q . x = (|q|^2 + |x|^2 - |q - x|^2) / 2.
So each level of segments bounds the score from above; a row whose bound lies below a score that
k + 1 rows are known to reach goes, at the coarsest level that shows it.  Survivors get exact
integer scores.  The known score comes from a bounded sample of rows and rises with each
block of rows; it only speeds the search up, the result is exact whatever it is.

Null vectors and those with null or non-finite components take no part; empty vectors score 0; see
:mod:`tablemend.llm.search` for ids and lengths.  Scores have 64 bits.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.llm.search import answers, matrix, prepared, search

LEVELS = (4, 16)
SAMPLE = 2_048
_TILE, _STEP = 128, 4_096


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double; null where a component is null or not finite."""
    doubles = vector.cast("array<double>")
    plain = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(plain, F.lit(False)), F.transform(doubles, lambda x: F.floor(x * F.lit(float(scale)))))


def statistics(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments, each times the root of the segment's length."""
    cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
    size = np.diff(cuts)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / size
    square = np.add.reduceat(x * x, cuts[:-1], axis=1) / size
    return mean * np.sqrt(size), np.sqrt(np.maximum(0, square - mean * mean)) * np.sqrt(size)


def features(x: np.ndarray, parts: int) -> np.ndarray:
    return np.concatenate(statistics(x, parts), axis=1)


def upper_bounds(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bounds of the inner products from two feature matrices of one level: with equal norms on both
    sides of the identity above, they are the features' own inner products."""
    return q @ x.T


def bounded(sample: np.ndarray, k: int):
    def best(q: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if not q.shape[1] or not x.shape[1]:
            who, row = np.indices((len(q), len(x))).reshape(2, -1)
            yield who, row, np.zeros(len(who), np.int64)
            return
        exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2.0 ** 52
        qd, xd = q.astype(float), x.astype(float)
        levels = [features(xd, n) for n in LEVELS]
        for lo in range(0, len(q), _TILE):
            tile = qd[lo:lo + _TILE]
            own = [features(tile, n) for n in LEVELS]
            known = np.full(len(tile), -np.inf)
            if len(sample) > k:
                known = np.partition(tile @ sample.T, len(sample) - k - 1, axis=1)[:, len(sample) - k - 1]
            if not exact:
                known -= 1e-9 * np.abs(known)
            parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a in range(0, len(x), _STEP):
                slack = 1e-6 * (1 + np.abs(known[:, None])) if np.isfinite(known).all() else 0.0
                alive = np.ones((len(tile), min(_STEP, len(x) - a)), bool)
                for mine, theirs in zip(own, levels, strict=True):
                    cols = np.flatnonzero(alive.any(axis=0))
                    bound = upper_bounds(mine, theirs[a + cols])
                    alive[:, cols] &= bound + slack + 1e-9 * np.abs(bound) >= known[:, None]
                cols = np.flatnonzero(alive.any(axis=0))
                if not len(cols):
                    continue
                if exact:  # whole numbers below 2^53 in doubles
                    score = (tile @ xd[a + cols].T).astype(np.int64)
                else:
                    score = q[lo:lo + _TILE] @ x[a + cols].T
                who, at = np.nonzero(alive[:, cols] & (score >= known[:, None]))
                parts.append((who, a + cols[at], score[who, at]))
                if sum(len(p[0]) for p in parts) > 64 * len(tile) * (k + 1) or a + _STEP >= len(x):
                    who, row, score = (np.concatenate(z) for z in zip(*parts, strict=True))
                    order = np.lexsort((-score, who))
                    who, row, score = who[order], row[order], score[order]
                    place = np.arange(len(who)) - np.searchsorted(who, who)
                    reach = place == k
                    known[who[reach]] = np.maximum(known[who[reach]], score[reach])
                    keep = score >= known[who]
                    parts = [(who[keep], row[keep], score[keep])]
            for who, row, score in parts:
                keep = score >= known[who]
                yield lo + who[keep], row[keep], score[keep]

    return best


def top_k(table: DataFrame, vector: str = "embedding", scale: int = 64, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``."""
    plain = table.select("vec_id", whole_numbers(table[vector], scale).alias("vec")).filter(F.col("vec").isNotNull())
    rows, asked, queries = prepared(plain, every, k)
    sample = rows.select("vec", F.xxhash64("gid").alias("h")).orderBy("h").limit(SAMPLE).toArrow()
    known = matrix(sample["vec"], np.float64)
    return answers(search(rows, asked, k, bounded(known, k), "long"), queries, k)

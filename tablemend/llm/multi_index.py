"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors get one more component, which makes the largest inner product the smallest
angle whatever the lengths; a rotation learned on a bounded sample (iterative
quantization) turns them into 64 bits.  A code falls into ``PARTS`` substrings, and each block
sorts its rows by each of them, with the place where every value begins.  Of two codes within
Hamming distance r = a * PARTS + b, one of the first b + 1 substrings differs in a bits at most or one of
the others in a - 1 (else they differed in more than r bits), so looking up the values that lie
so near to the query's retrieves every code within r, and rows of other values are never touched.
Where r is so wide that there are more values to look up than codes in a block, the block's codes are
read through instead, which finds the same ones.
What is found is ranked by inner products of the original vectors.

r is measured on the sample: the distance within which ``COVER`` of the true neighbours lie.
The sample's neighbours are farther than the whole table's, so the share found is larger
there.  A query with fewer than k + 1 rows within r in a block takes the block's nearest codes.

Null and zero vectors and those with null or non-finite components take no part; see :mod:`tablemend.llm.search`
for ids, ties, repeated rows and vectors of another length.
An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.llm.search import answers, matrix, prepared, search

BITS, PARTS = 64, 4
WIDTH = BITS // PARTS
SAMPLE, ASKED = 8_192, 256
COVER = 0.97


def usable(vector: Column) -> Column:
    """No nulls, only finite components, not zero."""
    plain = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & plain & F.exists(vector, lambda x: x != 0), F.lit(False))


def lengthened(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, longest ** 2 - (x ** 2).sum(axis=1)))
    return np.concatenate([x, rest[:, None]], axis=1)


@dataclass(frozen=True)
class Codes:
    """``rotation`` maps centred, lengthened vectors to BITS real numbers, whose signs are the code."""

    longest: float
    center: np.ndarray
    rotation: np.ndarray
    radius: int = 0

    def encode(self, x: np.ndarray, query: bool) -> np.ndarray:
        signs = (lengthened(x, self.longest, query) - self.center) @ self.rotation > 0
        return np.packbits(signs, axis=1, bitorder="little").view(np.uint64).ravel()


def learn(x: np.ndarray, longest: float, rounds: int = 40) -> Codes:
    """Iterative quantization: the rotation that brings the principal components nearest to their signs."""
    y = lengthened(x, longest, False)
    center = np.append(y[:, :-1].mean(axis=0), y[:, -1].mean())
    y = y - center
    values, directions = np.linalg.eigh(y.T @ y)
    directions = directions[:, np.argsort(-values)]
    luck = np.random.Generator(np.random.PCG64(64))
    width = min(BITS, directions.shape[1])
    z = y @ directions[:, :width]
    turn = np.linalg.qr(luck.standard_normal((width, width)))[0]
    for _ in range(rounds):
        signs = np.where(z @ turn > 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(signs.T @ z)
        turn = (u @ v).T
    rotation = directions[:, :width] @ turn
    if width < BITS:  # short vectors: further bits from random directions
        more = directions[:, :width] @ np.linalg.qr(luck.standard_normal((width, width)))[0]
        extra = [more @ np.linalg.qr(luck.standard_normal((width, width)))[0] for _ in range(-(-BITS // width))]
        rotation = np.concatenate([rotation, *extra], axis=1)[:, :BITS]
    return Codes(longest, center, rotation)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :])


def fitted(sample: np.ndarray, longest: float, k: int) -> Codes:
    codes = learn(sample, longest)
    asked = sample[:: max(1, len(sample) // ASKED)]
    far = distances(codes.encode(asked, True), codes.encode(sample, False))
    score = asked @ sample.T
    score[np.arange(len(asked)), np.arange(0, len(sample), max(1, len(sample) // ASKED))[: len(asked)]] = -np.inf
    near = np.argsort(-score, axis=1)[:, :min(k, max(1, len(sample) - 1))]
    radius = int(np.quantile(np.take_along_axis(far, near, 1), COVER, method="higher"))
    return Codes(codes.longest, codes.center, codes.rotation, radius)


def part_radii(radius: int) -> list[int]:
    """How far each substring is probed; -1 where it need not be."""
    a, b = divmod(radius, PARTS)
    return [a if s <= b else a - 1 for s in range(PARTS)]


@functools.cache
def masks(width: int, radius: int) -> np.ndarray:
    """What changes up to ``radius`` of ``width`` bits, nearest first."""
    every = np.arange(1 << width, dtype=np.uint32)
    far = np.bitwise_count(every)
    near = far <= radius
    return every[near][np.argsort(far[near], kind="stable")]


class SubstringIndex:
    """The rows of a block by the values of each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.touched = codes, 0
        self.order, self.start = [], []
        for s in range(PARTS):
            value = self.part(codes, s)
            self.order.append(np.argsort(value, kind="stable"))
            self.start.append(np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << WIDTH))]))

    @staticmethod
    def part(codes: np.ndarray, s: int) -> np.ndarray:
        return ((codes >> np.uint64(s * WIDTH)) & np.uint64((1 << WIDTH) - 1)).astype(np.uint32)

    def within(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of all codes within the radius, by query and row; ``touched`` counts the rows looked at."""
        radii, found = part_radii(radius), []
        looked_up = sum(len(masks(WIDTH, min(r, WIDTH))) for r in radii if r >= 0)
        if looked_up + len(self.codes) * looked_up / (1 << WIDTH) > len(self.codes):  # reading the codes through is less work
            apart = distances(query, self.codes)
            who, row = np.nonzero(apart <= radius)
            self.touched += apart.size
            return who, row, apart[who, row]
        for s, (order, start) in enumerate(zip(self.order, self.start, strict=True)):
            if radii[s] < 0:
                continue
            near = masks(WIDTH, min(radii[s], WIDTH))
            value = self.part(query, s)[:, None] ^ near[None, :]
            low, high = start[value], start[value + 1]
            who, place = np.nonzero(high > low)
            low = low[who, place]
            n = high[who, place] - low
            row = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            who = np.repeat(who, n)
            self.touched += len(row)
            apart = query[who] ^ self.codes[row]
            far = np.bitwise_count(apart)
            keep = far <= radius
            for t in range(s):  # what an earlier substring has found is not found again
                keep &= np.bitwise_count(self.part(apart, t)) > radii[t]
            found.append((who[keep], row[keep], far[keep]))
        who, row, far = (np.concatenate(c) for c in zip(*found, strict=True))
        place = np.lexsort((row, who))
        return who[place], row[place], far[place]


def nearest(codes: Codes, k: int):
    def best(q: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        index = SubstringIndex(codes.encode(x, False))
        asked = codes.encode(q, True)
        for lo in range(0, len(q), 64):
            part = asked[lo:lo + 64]
            who, row, _ = index.within(part, codes.radius)
            few = np.flatnonzero(np.bincount(who, minlength=len(part)) < min(k + 1, len(x)))
            if len(few):
                closest = np.argsort(distances(part[few], index.codes), axis=1, kind="stable")[:, :k + 1]
                keep = ~np.isin(who, few)
                who = np.concatenate([who[keep], np.repeat(few, closest.shape[1])])
                row = np.concatenate([row[keep], closest.ravel()])
            score = np.concatenate([np.einsum("ij,ij->i", q[lo + who[a:a + 65_536]], x[row[a:a + 65_536]])
                                    for a in range(0, max(1, len(who)), 65_536)])
            # Only rows that reach the k + 1st best of the block go on.
            order = np.lexsort((-score, who))
            who, row, score = who[order], row[order], score[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            last = np.full(len(part), -np.inf)
            last[who[place == k]] = score[place == k]
            keep = score >= last[who]
            yield lo + who[keep], row[keep], score[keep]

    return best


def neighbours(table: DataFrame, vector: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``."""
    plain = table.select("vec_id", table[vector].cast("array<double>").alias("vec")).filter(usable(F.col("vec")))
    # 0.0 and -0.0 are one value.
    plain = plain.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))
    rows, asked, queries = prepared(plain, every, k)
    squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    longest = rows.agg(F.max(F.sqrt(squares))).first()[0]
    if longest is None:
        return search(rows, asked, k, lambda q, x: iter(()), "double").limit(0).select(
            F.col("gid").alias("query_id"), F.lit(0).alias("rank"), "vec_id", "score")
    sample = rows.select("vec", F.xxhash64("gid").alias("h")).orderBy("h").limit(SAMPLE).toArrow()
    codes = fitted(matrix(sample["vec"], np.float64), float(longest), k)
    return answers(search(rows, asked, k, nearest(codes, k), "double"), queries, k)

"""Connected components of a graph given by its edges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemend.llm.common import stage

CHUNK = 50_000


class Forest:
    """Union-find over any numbers; the smallest of a tree is its root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent.setdefault(x, x)
        while p != self.parent[p]:
            self.parent[p] = p = self.parent[self.parent[p]]
        self.parent[x] = p
        return p

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns a, b: the stars of a chunk of edges."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    ends = [(v, forest.find(v)) for v in list(forest.parent)]
    ends = [(v, r) for v, r in ends if v != r]
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in ends], pa.int64()), pa.array([r for _, r in ends], pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """v, root: the smallest number that each vertex of ``edges`` (a long, b long) can reach.

    Edges come in chunks of about ``CHUNK``; a task turns its chunk into stars, which leaves at most as many edges as the
    chunk has vertices.  What joins chunks is left to the rounds.  ``edges`` must be a staged table.

    The rounds alternate the large star (every larger neighbour is tied to the smallest neighbour)
    and the small star (the same for smaller ones) until only stars are left; the rounds grow
    with the logarithm of the longest path.  Each round is written, so a lost executor
    costs one round.  A vertex with very many neighbours is a grouped minimum and one side
    of a join that the engine can split.
    """
    chunks = max(1, math.ceil(edges.count() / CHUNK))
    now = stage(edges.coalesce(chunks).mapInArrow(_forests, "a long, b long"), "forests")
    while chunks > 1:  # one chunk's forest is all stars
        now = stage(_small_star(_large_star(now)).distinct(), "edges")
        if _are_stars(now):
            break
    roots = now.select("b").distinct().select(F.col("b").alias("v"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    larger = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    tied = larger.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return tied.filter(F.col("a") != F.col("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    ends = F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))
    tied = edges.join(low, "a").select(F.explode(ends).alias("e")).select("e.a", "e.b")
    return tied.filter(F.col("a") != F.col("b"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every vertex either has one edge to a smaller one, or only edges from larger ones."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("down")),
                                          F.struct(F.col("b").alias("v"), F.lit(0).alias("down")))).alias("e"))
    per_vertex = ends.groupBy("e.v").agg(F.sum("e.down").alias("down"), F.count(F.lit(1)).alias("n"))
    odd = (F.col("down") > 1) | ((F.col("down") == 1) & (F.col("n") > 1))
    return not (per_vertex.agg(F.count_if(odd).alias("odd")).first()["odd"])

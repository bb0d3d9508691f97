"""Centroid clustering in whole numbers, with centroids filtered by principal coordinates.

Vectors are turned by the principal axes of all of them.  Each keeps its whole-number components, its first
``LEAD`` turned coordinates and the norm of the rest.  For vector x and centroid c

    |x - c|^2 >= |lead(x) - lead(c)|^2 + (rest(x) - rest(c))^2,

so a centroid whose bound exceeds the exact distance to the centroid of the smallest bound cannot be the nearest;
the others are compared in whole numbers, ties to the smaller number.  The bound is loosened by
more than the error of its floating-point sums, so it decides nothing by itself.

On Spark: the turned vectors are written once; each round reads them without a shuffle, a task gives one row
of exact sums per centroid, and the driver gets as many rows as there are centroids.

Vectors take part if they have exactly ``width`` components, none null or non-finite or of 2^19 or more in
magnitude (squared distances would leave 64 bits).  Rows are told apart by nothing: repeated rows, ids and null ids each are a vector; null
ids begin as a centroid only if there are too few others.  With fewer vectors than centroids each vector is one.
An empty table gives no rows.  Other columns are ignored and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemend.llm.common import stage

WIDTH, CENTROIDS, ROUNDS = 64, 40, 5
LEAD = 16
#: Components that keep squared distances within 64 bits; share of |x|^2 + |c|^2 by which bounds are loosened.
_MOST, _SLACK = float(1 << 19), 1e-9
_ROWS = 2_048


def usable(vector: Column, width: int) -> Column:
    plain = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < _MOST))
    return F.coalesce((F.size(vector) == width) & plain, F.lit(False))


def whole_vectors(table: DataFrame, vector: str, scale: int, width: int) -> DataFrame:
    """vec_id, v: the kept vectors as whole numbers."""
    real = table.select(table["vec_id"].alias("vec_id"), table[vector].cast("array<double>").alias("x"))
    return real.filter(usable(F.col("x"), width)).select(
        "vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("int")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """The axes of all vectors, of the largest spread first, as columns."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            x = np.concatenate([_matrix(batch.column(0), width).astype(float), np.ones((batch.num_rows, 1))], axis=1)
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "m"])

    cells = vectors.select("v").mapInArrow(moments, "i int, j int, m double").groupBy("i", "j").agg(F.sum("m").alias("m")).collect()
    total = np.zeros((width + 1, width + 1))
    for c in cells:
        total[c["i"], c["j"]] = c["m"]
    n, sums = max(1.0, total[width, width]), total[width, :width]
    values, axes = np.linalg.eigh(total[:width, :width] / n - np.outer(sums, sums) / n / n)
    return axes[:, np.argsort(-values, kind="stable")]


def turned(x: np.ndarray, axes: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading coordinates, and the norms of the others."""
    y = x.astype(float) @ axes
    return y[:, :lead], np.sqrt((y[:, lead:] ** 2).sum(axis=1))


def rotated(vectors: DataFrame, axes: np.ndarray, lead: int) -> DataFrame:
    """vec_id, v, lead, rest, staged."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, rest = turned(_matrix(batch.column(1), len(axes)), axes, lead)
            offsets = pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(y.ravel())), pa.array(rest)],
                ["vec_id", "v", "lead", "rest"])

    return stage(vectors.mapInArrow(turn, f"vec_id {kind}, v array<int>, lead array<double>, rest double"), "rotated")


class Nearest:
    """The nearest of some centroids, and how many exact distances that took."""

    def __init__(self, centroids: np.ndarray, axes: np.ndarray, lead: int):
        self.centroids, self.compared = centroids, 0
        self.lead, self.rest = turned(centroids, axes, lead)
        self.norms = (centroids.astype(float) ** 2).sum(axis=1)

    def of(self, v: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row."""
        number, distance = np.zeros(len(v), np.int32), np.zeros(len(v), np.int64)
        for lo in range(0, len(v), _ROWS):
            part = slice(lo, lo + _ROWS)
            number[part], distance[part] = self._of_some(v[part].astype(np.int64), lead[part], rest[part])
        return number, distance

    def _of_some(self, v: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bound = (lead ** 2).sum(axis=1)[:, None] - 2 * (lead @ self.lead.T) + (self.lead ** 2).sum(axis=1)
        bound += (rest[:, None] - self.rest[None, :]) ** 2
        rows, guess = np.arange(len(v)), bound.argmin(axis=1)
        first = self._exact(v, self.centroids[guess])
        slack = _SLACK * ((v.astype(float) ** 2).sum(axis=1)[:, None] + self.norms)
        open_ = bound <= first[:, None] + slack
        open_[rows, guess] = False
        i, j = np.nonzero(open_)
        exact = np.full(bound.shape, np.iinfo(np.int64).max)
        exact[rows, guess] = first
        exact[i, j] = self._exact(v[i], self.centroids[j])
        number = exact.argmin(axis=1)
        return number, exact[rows, number]

    def _exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        self.compared += len(a)
        return ((a - b) ** 2).sum(axis=1)


def _columns(batch: pa.RecordBatch, width: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v, first, rest = (batch.column(batch.schema.get_field_index(c)) for c in ("v", "lead", "rest"))
    return _matrix(v, width), _matrix(first, lead), rest.to_numpy()


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The vectors of the k smallest SHA-256 sums of ``2:<vec_id>``, in ascending order."""
    key = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("v", key.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def next_centroids(rows: DataFrame, nearest: Nearest, lead: int) -> np.ndarray:
    """Each centroid moved to the floor of its vectors' mean; one without vectors stays."""
    k, width = nearest.centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            v, first, rest = _columns(batch, width, lead)
            number, _ = nearest.of(v, first, rest)
            count += np.bincount(number, minlength=k)
            np.add.at(total, number, v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k), pa.int32()), pa.array(count), pa.array(total.tolist(), pa.list_(pa.int64()))], ["number", "n", "s"])

    parts = rows.select("v", "lead", "rest").mapInArrow(sums, "number int, n long, s array<long>")
    exact = [F.sum(F.get("s", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(width)]
    moved = nearest.centroids.copy()
    for r in parts.groupBy("number").agg(F.sum("n").alias("n"), *exact).collect():
        if r["n"]:
            moved[r["number"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return moved


def cluster(table: DataFrame, vector: str = "embedding", scale: int = 256, k: int = CENTROIDS, rounds: int = ROUNDS,
            width: int = WIDTH) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of each vector, staged; the final centroids)."""
    vectors = whole_vectors(table, vector, scale, width)
    kind, lead = vectors.schema["vec_id"].dataType.simpleString(), min(LEAD, width)
    centroids = first_centroids(vectors, k)
    if not len(centroids):
        return table.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), centroids
    axes = principal_axes(vectors, width)
    rows = rotated(vectors, axes, lead)
    for _ in range(rounds):
        centroids = next_centroids(rows, Nearest(centroids, axes, lead), lead)
    nearest = Nearest(centroids, axes, lead)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = nearest.of(*_columns(batch, width, lead))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return stage(rows.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "clusters"), centroids


def report(table: DataFrame, **how) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector."""
    found, centroids = cluster(table, **how)
    exact = F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(exact).collect()}
    described = [(c, d, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    schema = T.StructType([T.StructField("c", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    # As many rows as centroids.
    clusters = F.broadcast(table.sparkSession.createDataFrame(described, schema))
    return found.join(clusters, found["cluster"] == clusters["c"]).select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(inertia.values())).cast("long").alias("inertia"), "centroid_sha256")

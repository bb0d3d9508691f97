"""Clustering against a plain version in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tablemend.llm import clustering
from tablemend.llm.queries import QUERIES


def plain(data, k=40, rounds=5, width=64, scale=256):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in data
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, v in kept:
            own[near(v)[1]].append(v)
        centroids = [[sum(c) // len(vs) for c in zip(*vs, strict=True)] if vs else c for vs, c in zip(own, centroids, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    part = {n: sum(d for _, d, m in last if m == n) for _, _, n in last}
    sha = lambda n: hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()
    return sorted(((i, n, d, part[n], sum(part.values()), sha(n)) for i, d, n in last), key=repr)


def vectors(n, seed=1, width=64):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(12)]
    out = [(k, [m + rng.gauss(0, 0.2) for m in rng.choice(middles)]) for k in range(n)]
    hot = [0.25] * width
    out += [(n + k, hot) for k in range(60)]
    return [*out, out[0], (3, out[5][1]), (None, hot), (None, [0.5] * width), (9_000, None), (9_001, [float("nan")] * width),
            (9_002, [None] * width), (9_003, [0.5] * 3), (9_004, []), (9_005, [math.inf] + [0.0] * (width - 1)), (9_006, [0.0] * width)]


def frame(spark, data):
    rows = [(i, v, "c", "d", "r") for i, v in data]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, v string, rest string")


@pytest.mark.parametrize("data", [vectors(300), vectors(25, seed=2)[:20], [(5, [1.0] * 64)], [], [(1, None)]])
def test_clusters_equal_the_plain_version(spark, data):
    found = clustering.report(frame(spark, data))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain(data)


def test_query(spark, tmp_path):
    data = vectors(150, seed=4)
    frame(spark, data).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = QUERIES["op12_rotated_filtering"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=repr) == plain(data)


def test_bounds_are_bounds_and_spare_comparisons():
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(40, 64)) * 300
    v = np.floor(middles[rng.integers(0, 40, 2_000)] + rng.normal(size=(2_000, 64)) * 60).astype(np.int32)
    centroids = np.floor(middles).astype(np.int64)
    axes = np.linalg.eigh(np.cov(v.T))[1][:, ::-1]
    lead, rest = clustering.turned(v, axes, 16)
    c_lead, c_rest = clustering.turned(centroids, axes, 16)
    bound = ((lead[:, None] - c_lead) ** 2).sum(axis=2) + (rest[:, None] - c_rest) ** 2
    exact = ((v[:, None].astype(np.int64) - centroids) ** 2).sum(axis=2)
    assert (bound <= exact * (1 + 1e-9)).all()
    nearest = clustering.Nearest(centroids, axes, 16)
    number, distance = nearest.of(v, lead, rest)
    assert (number == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert nearest.compared < 2 * len(v)


def test_largest_components_are_exact():
    big = np.array([[(1 << 27) - 1] * 64, [-(1 << 27)] * 64], np.int32)
    axes = np.eye(64)
    number, distance = clustering.Nearest(big[1:].astype(np.int64), axes, 16).of(big, *clustering.turned(big, axes, 16))
    assert distance.tolist() == [64 * ((1 << 28) - 1) ** 2, 0] and number.tolist() == [0, 0]

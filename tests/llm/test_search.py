"""Both searches against brute force."""

import math
import random

import numpy as np
import pytest

from tablemend.llm import multi_index, search, segments
from tablemend.llm.queries import QUERIES, SQL


def vectors(n, width=16, seed=1):
    rng = random.Random(seed)
    out = [(k, [rng.gauss(0, 0.3) for _ in range(width)], "v") for k in range(n)]
    hot = [0.25] * width
    out += [(n + k, hot, "v") for k in range(40)]  # one vector many times
    bad = [(20_000, None, "v"), (20_020, [float("nan")] + [0.0] * (width - 1), "v"), (20_040, [math.inf] * width, "v"),
           (20_060, [None] * width, "v"), (None, hot, "v"), (20_080, [0.1] * 3, "v")]
    return out + bad + [out[0]]  # and a repeated row


def frame(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, vec string")


def good(data, width=16):
    seen = {}
    for i, v, _ in data:
        if i is not None and v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            seen[i] = np.array(v, np.float32).astype(float)
    return seen


def top(score, ids, own, k):
    order = sorted((-s, i) for s, i in zip(score, ids, strict=True) if i != own)[:k]
    return [(i, -s) for s, i in order]


@pytest.mark.parametrize("rows_per_block", [16_384, 60])
def test_exact_search_equals_brute_force(spark, monkeypatch, rows_per_block):
    monkeypatch.setattr(search, "ROWS_PER_BLOCK", rows_per_block)
    data = vectors(300)
    found = segments.top_k(frame(spark, data), every=20, k=20).collect()
    whole = {i: np.floor(64 * v).astype(int) for i, v in good(data).items()}
    ids, m = list(whole), np.array(list(whole.values()))
    for q in (i for i in ids if i % 20 == 0):
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        want = top((m @ whole[q]).tolist(), ids, q, 20)
        assert [(v, s) for _, v, s in got] == want and [r for r, *_ in got] == list(range(1, 21))
    assert {r["query_id"] for r in found} == {i for i in ids if i % 20 == 0}


def test_bounds_are_bounds():
    rng = np.random.default_rng(2)
    q, x = rng.normal(size=(20, 24)), rng.normal(size=(50, 24))
    for parts in (1, 4, 7, 24):
        assert (segments.upper_bounds(segments.features(q, parts), segments.features(x, parts)) >= q @ x.T - 1e-9).all()


def test_few_candidates_and_empty_tables(spark):
    few = [(0, [1.0, 2.0], "v"), (1, [0.5, 0.5], "v"), (20, [-1.0, 1.0], "v")]
    for found in (segments.top_k(frame(spark, few)), multi_index.neighbours(frame(spark, few))):
        assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found.collect()) == [
            (0, 1, 1), (0, 2, 20), (20, 1, 0), (20, 2, 1)]
    for found in (segments.top_k(frame(spark, [])), multi_index.neighbours(frame(spark, []))):
        assert found.collect() == [] and found.columns == ["query_id", "rank", "vec_id", "score"]


def test_recall_of_the_multi_index(spark, monkeypatch):
    monkeypatch.setattr(search, "ROWS_PER_BLOCK", 700)
    data = vectors(2_000, width=32, seed=4)
    found = multi_index.neighbours(frame(spark, data), every=20, k=20).collect()
    whole = good(data, 32)
    ids, m, hits, asked = list(whole), np.array(list(whole.values())), 0, [i for i in whole if i % 20 == 0]
    for q in asked:
        got = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert len(got) == 20 and [-r["score"] for r in got] == sorted(-r["score"] for r in got)
        assert all(abs(r["score"] - float(whole[q] @ whole[r["vec_id"]])) < 1e-9 for r in got)
        hits += len({r["vec_id"] for r in got} & {i for i, _ in top((m @ whole[q]).tolist(), ids, q, 20)})
    assert hits >= 0.9 * 20 * len(asked)


def test_every_code_within_the_radius_is_retrieved():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    query = codes[:40] ^ (np.uint64(1) << rng.integers(0, 60, 40).astype(np.uint64))
    index = multi_index.SubstringIndex(codes)
    for radius in (0, 3, 12, 30):
        who, row, far = index.within(query, radius)
        want = np.argwhere(multi_index.distances(query, codes) <= radius)
        assert np.array_equal(np.stack([who, row], axis=1), want) and (far <= radius).all()


def test_probing_touches_few_rows():
    """Near codes are found, and far fewer rows looked at than there are (query, row) pairs."""
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    index = multi_index.SubstringIndex(codes)
    for radius, most in ((3, 0.001), (9, 0.03), (16, 0.2)):
        index.touched = 0
        flips = np.array([sum(1 << int(b) for b in rng.choice(63, radius, replace=False)) for _ in range(50)], np.uint64)
        who, row, far = index.within(codes[:50] ^ flips, radius)
        assert set(range(50)) <= set(row[who == row].tolist()) and (far <= radius).all()
        assert index.touched < most * 50 * len(codes)
        want = np.argwhere(multi_index.distances(codes[:50] ^ flips, codes) <= radius)
        assert np.array_equal(np.stack([who, row], axis=1), want)
    assert index.within(codes[:0], 9)[0].size == 0
    index.touched = 0
    index.within(codes[:2], 30)
    assert index.touched == 2 * len(codes)  # more values to look up than codes


def test_radii_of_substrings_follow_the_pigeonhole():
    for radius in range(0, 65):
        radii = multi_index.part_radii(radius)
        # Codes that each substring misses differ in one bit more than its radius, in all substrings.
        assert sum(r + 1 for r in radii) == radius + 1


def test_queries_of_operators_have_sql_where_it_can_say_them():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(SQL) <= set(QUERIES)

"""Line and near deduplication, the cuckoo filter and connected components against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablemend.llm import line_dedup, near_dup, textvec
from tablemend.llm.components import components
from tablemend.llm.cuckoo import Cuckoo
from tests.llm.conftest import prose

SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(SPACE))


def lines_expected(docs, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for i, t, _ in docs:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= min_chars:
                holders[key_of(line)].add(i)
    out = []
    for i, t, _ in docs:
        lines = (t or "").split("\n")
        lost = [k for k in lines if len(holders[key_of(k)]) >= min_docs and i != max(holders[key_of(k)])]
        kept = [k for k in lines if k not in lost]
        out.append((i, len(lines), len(lost), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def lines_found(store, df):
    done = store.apply(df).select("doc_id", "__n_lines", "__n_dropped", F.sha2("__kept", 256))
    return sorted((tuple(r) for r in done.collect()), key=repr)


def test_lines_of_odd_documents(table, odd):
    df = table(odd)
    assert lines_found(line_dedup.ingest(df), df) == lines_expected(odd)


@pytest.mark.parametrize("deliveries", [1, 3])
def test_deliveries_make_no_difference(table, odd, deliveries):
    df = table(odd)
    assert lines_found(line_dedup.ingest(df, deliveries, keys_per_shard=40), df) == lines_expected(odd)


def test_deletion_puts_the_store_back(spark, table, odd):
    first, later = [d for d in odd if d[0] is None or d[0] < 103], [d for d in odd if d[0] and d[0] >= 103]
    store = line_dedup.LineStore.empty(spark, 3).insert(table(first))
    both = store.insert(table(later))
    assert lines_found(both, table(odd)) == lines_expected(odd)
    back = both.delete(spark.createDataFrame([(d[0],) for d in later], "doc_id long"))
    assert lines_found(back, table(first)) == lines_expected(first)
    assert sorted(map(tuple, back.counts.collect()), key=repr) == sorted(map(tuple, store.counts.collect()), key=repr)
    keys = [r["key"] for r in back.counts.collect()]
    gone = {r["key"] for r in both.counts.collect()} - set(keys)
    seen = [Cuckoo.loads(r["data"]) for r in back.filters.collect()]
    h = lambda ks: np.frombuffer(b"".join(k[:8] for k in ks), np.uint64)
    assert np.any([f.contains(h(keys)) for f in seen], axis=0).all()
    assert gone and np.any([f.contains(h(sorted(gone))) for f in seen], axis=0).mean() < 0.1


def test_lines_of_an_empty_table(table):
    df = table([])
    assert lines_found(line_dedup.ingest(df), df) == []


@given(st.lists(st.integers(0, 2**63), unique=True, max_size=400), st.data())
@settings(max_examples=30, deadline=None)
def test_cuckoo_filter_has_what_it_holds(hashes, data):
    h = textvec.mix(np.array(hashes, np.uint64))
    f = Cuckoo.sized(len(h))
    assert len(f.insert(h)) == 0 and f.contains(h).all()
    n = data.draw(st.integers(0, len(h)))
    f = Cuckoo.loads(f.dumps())
    f.remove(h[:n])
    assert f.contains(h[n:]).all()
    f.remove(h[n:])
    assert not f.table.any()


def test_cuckoo_filter_is_put_back_when_full():
    f = Cuckoo(np.zeros((16, 4), np.uint16))
    h = textvec.mix(np.arange(200, dtype=np.uint64))
    assert len(f.insert(h)) == 200 and not f.table.any()


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 4000), (7, 7)]
    found = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(found) == 301 + 200 + 2
    assert all(root == (0 if v <= 300 else 1000 if v < 2000 else 4000) for v, root in found.items())


def sets_of(docs):
    out = []
    for i, t, _ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        out.append((i, {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def near_expected(docs, percent=85):
    sets, parent = sets_of(docs), list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    names = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        names[find(k)].append(i)
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [x for x in names[find(k)] if x is not None]
        name = min(ids) if s and ids else i
        out.append((i, len(s), name, i == name))
    return sorted(out, key=repr)


def near_found(df):
    return sorted((tuple(r) for r in near_dup.classes(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_near_duplicates_of_odd_documents(table, odd):
    assert near_found(table(odd)) == near_expected(odd)


def test_near_duplicates_of_edited_documents(table):
    rng, docs = random.Random(3), []
    for k in range(25):
        base = prose(rng, rng.randint(30, 150)).split()
        for c in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = "edit" + str(rng.randrange(50))
            docs.append((k * 10 + c, " ".join(words), "a"))
    assert near_found(table(docs)) == near_expected(docs)


def test_large_families_are_cut_into_blocks(table, monkeypatch):
    """A chain of near copies and a crowd around one text, with blocks and buckets of a few vertices."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "BUCKET", 12)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    docs = []
    for k in range(40):  # each differs from the crowd's middle in a few words
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(200)] = f"x{k}"
        docs.append((k, " ".join(words), "a"))
    walk = [f"c{k}" for k in range(150)]
    for k in range(30):  # each differs from the one before in one word
        walk[5 * k % 150] = f"y{k}"
        docs.append((100 + k, " ".join(walk), "a"))
    assert near_found(table(docs)) == near_expected(docs)


def test_one_document_of_each_class_stays(table, odd):
    kept = near_dup.deduplicate(table(odd))
    assert kept.columns == table(odd).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({i for i, *_, k in near_expected(odd) if k and i is not None})
    assert len([i for i in ids if i and 100 <= i < 130]) == 1


def test_near_duplicates_of_an_empty_table(table):
    assert near_found(table([])) == []


@given(st.lists(st.one_of(st.none(), st.text(" ab\n\té🙂", max_size=30)), max_size=12), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_words_and_chunks(texts, most):
    """Hashes are equal exactly where words are, in any chunking."""
    got = []
    for lo, hi, data, offs in textvec.chunks(pa.array(texts, pa.string()), most):
        row, word = textvec.words(data, offs)
        got += [[int(h) for h in word[row == k]] for k in range(hi - lo)]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    pairs = {(h, w) for g, ws in zip(got, want, strict=True) for h, w in zip(g, ws, strict=True)}
    assert len(pairs) == len({h for h, _ in pairs}) == len({w for _, w in pairs})


def test_posterior_bounds_keep_links():
    least = near_dup.fewest_agreements(0.85)
    assert list(least) == sorted(least) and least[0] < 20 * 0.85 and least[-1] < 100 * 0.85
    rng = np.random.default_rng(1)
    agreed = np.cumsum(rng.random((20_000, 5, 20)) < 0.85, axis=2)[:, :, -1].cumsum(axis=1)
    assert (agreed < least[None, :]).any(axis=1).mean() < 2e-3


def thue_morse(n):
    """A word of n letters and its complement, whose sums of powers modulo 2^64 are equal."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [512, 4_096])
def test_long_words_differ(table, n):
    x, y = thue_morse(n)
    docs = table([(1, x, "a"), (2, y, "a"), (3, f"a b c d {x} a b c d {y}", "a"), (4, "p q r s " + x, "a"), (5, "p q r s " + y, "a")])
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.classes(docs, 85).collect()}
    assert found == {1: (1, 1), 2: (1, 2), 3: (6, 3), 4: (1, 4), 5: (1, 5)}


def test_deletion_behind_false_positives_leaves_other_keys_alone(monkeypatch):
    """Filters of four marks in four buckets take most new keys for known ones."""
    places = Cuckoo._places
    monkeypatch.setattr(Cuckoo, "_places", lambda self, h: (places(self, h)[0] & 3, (places(self, h)[1] & 3) + 1))
    keys = [hashlib.md5(str(k).encode()).digest() for k in range(24)]
    frame = lambda some: pd.DataFrame({"shard": np.int32(0), "key": some, "n_docs": 1, "last_doc": 1})
    none = pd.DataFrame({"shard": [], "generation": [], "data": []})
    split = lambda out: (out[out["data"].isna()], out[out["data"].notna()])
    first, filters = split(line_dedup._insert((0,), frame(keys[:8]), none))
    assert line_dedup._ask((0,), frame(keys[8:]), filters)["seen"].any()  # false positives
    second, both = split(line_dedup._insert((0,), frame(keys[8:]), filters))
    assert (second["generation"] >= 0).all() and line_dedup._ask((0,), frame(keys), both)["seen"].all()
    after = line_dedup._take_out((0,), second, both)
    assert line_dedup._ask((0,), frame(keys[:8]), after)["seen"].all()
    left = [Cuckoo.loads(d) for d in after.sort_values("generation")["data"]]
    assert sum(int((f.table > 0).sum()) for f in left) == 8  # exactly the first keys' marks


def test_deletion_and_insertion_again(spark, table):
    rng = random.Random(9)
    first, second, third = ([(base + k, "\n".join(prose(rng, 12) + " " * 40 + str(base + k + j) for j in range(4)), "a") for k in range(10)]
                            for base in (0, 100, 200))
    start = line_dedup.LineStore.empty(spark, 1).insert(table(first))
    back = start.insert(table(second)).delete(table(second).select("doc_id"))

    def rows(counts):
        return sorted((bytes(r["key"]), r["n_docs"], r["last_doc"]) for r in counts.collect())

    assert rows(back.counts) == rows(start.counts) and len(rows(start.counts)) == 40
    counts = rows(back.insert(table([(i + 500, t, s) for i, t, s in first])).insert(table(third)).counts)
    assert len({k for k, *_ in counts}) == len(counts) == 80  # one row a key
    assert sorted(n for _, n, _ in counts) == [1] * 40 + [2] * 40

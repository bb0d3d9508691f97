"""Mixing, sharding and packing against plain Python."""

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablemend.llm import mixing, packing, sharding
from tablemend.llm.queries import END_ID, MIX, SEQUENCE, TOKENIZER
from tablemend.llm.tokens import BytePairs


def levels(sizes, weights, share, most):
    """Targets by dealing out the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mix_of_odd_documents(table, odd):
    df = table(odd)
    rows = mixing.mix_plan(df, **MIX).collect()
    assert len(rows) == len(odd)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in odd:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = sorted((size(t), sizes[s], levels(sizes, **MIX)[s]) for _, t, s in odd)
    assert np.allclose(want, sorted((r["size"], r["source_size"], r["target"]) for r in rows))
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    again = mixing.mix_plan(df.repartition(7), **MIX).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)


def test_mix_reaches_its_targets(table):
    docs = [(k, "w " * (1 + k * 37 % 400), "abc"[k % 3] if k % 7 else None) for k in range(900)]
    rows = mixing.mix_plan(table(docs), **MIX).collect()
    by_target = {}
    for r in rows:
        by_target.setdefault(r["target"], []).append(r["taken"])
    assert len(by_target) == 4
    assert all(abs(sum(t) - target) <= max(0.01 * target, 100) for target, t in by_target.items())
    mixed = mixing.mix(table(docs), **MIX)
    assert mixed.columns == table(docs).columns
    assert mixed.count() == sum(r["copies"] for r in rows)


def stated(sizes, words):
    """Inclusion probabilities min(1, level * sqrt(size)) that expect ``words`` words, by bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(100):
        level = (lo + hi) / 2
        lo, hi = (level, hi) if np.sum(np.minimum(1, level * np.sqrt(sizes)) * sizes) < words else (lo, level)
    return np.minimum(1, lo * np.sqrt(sizes))


def test_documents_come_as_often_as_stated(table):
    """Every document has the inclusion probability of its size, and over seeds it is taken that often."""
    sizes = np.array([(4, 25, 100, 900)[k % 4] if k % 40 else 2_000 for k in range(3_000)])
    df = table([(k, "w " * int(n), "a") for k, n in enumerate(sizes)]).persist()
    want = stated(sizes, 0.75 * sizes.sum())
    assert (want == 1).sum() == 75  # the very long ones are certain
    copies = np.zeros(len(sizes))
    for seed in range(4):
        rows = sorted(mixing.mix_plan(df, [1], 0.75, 2.0, seed=seed).collect())
        assert np.allclose([r["inclusion"] for r in rows], want)
        copies += [r["copies"] for r in rows]
    for n in np.unique(sizes):
        p, of = want[sizes == n][0], copies[sizes == n] / 4
        assert abs(of.mean() - p) <= 4 * np.sqrt(p * (1 - p) / (4 * len(of))) + 0.01


def test_long_documents_are_drawn_oftener(table):
    docs = [(k, "w " * (10 if k % 2 else 160), "a") for k in range(2_000)]
    rows = mixing.mix_plan(table(docs), [1], 0.5, 2.0).collect()
    share = lambda n: np.mean([r["copies"] for r in rows if r["size"] == n])
    assert share(160) > share(10) > 0.05


def test_mix_of_an_empty_table(table):
    assert mixing.mix_plan(table([]), **MIX).collect() == []


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.integers(1, 300))
@settings(max_examples=50, deadline=None)
def test_jump_hash(keys, n):
    assert sharding.jump(np.array(keys, np.uint64), n).tolist() == [plain_jump(k, n) for k in keys]


def test_one_more_shard_moves_its_share_only():
    keys = np.arange(40_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = sharding.jump(keys, 40), sharding.jump(keys, 41)
    assert (b[a != b] == 40).all() and abs((a != b).mean() - 1 / 41) < 0.005


def test_shards_of_odd_documents(table, odd):
    rows = sharding.assign(table(odd), 4).collect()
    want = sorted((i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in odd)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == want
    for s in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 4) for r in rows)
    assert sharding.assign(table([]), 4).collect() == []


def test_written_shards_hold_every_document(spark, table, odd, tmp_path):
    sharding.write(table(odd), str(tmp_path / "shards"), 4)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(odd)


ODD_TEXTS = ["", None, " ", "\n\n  x", "a  b   c ", "it's we'll 'tis", "é à\u00a0  x", "x\u3000y \n z", "a\tb\r\n c",
             "<|endoftext|> hi", "日本 語", "1 2,3.4 a1 b,c", "a\u0085 b", "🙂 x🙂y", "don't.\"x\"", "\x1c a\x1d b", "ǅ ª x", "e\u0301 x"]


def reference():
    whole = Tokenizer.from_file(TOKENIZER)
    whole.encode_special_tokens = True
    return whole


@given(st.lists(st.one_of(st.sampled_from(ODD_TEXTS), st.text(" \n\t'.,aZé\u00a0\u20031日-", max_size=25)), max_size=10))
@settings(max_examples=80, deadline=None)
def test_parts_give_the_tokenizers_ids(texts):
    whole, got = reference(), []
    for _, ids, offs in BytePairs.of(TOKENIZER).encode(pa.array(texts, pa.string()), END_ID):
        got += [ids[offs[k]:offs[k + 1]].tolist() for k in range(len(offs) - 1)]
    assert got == [whole.encode(t or "", add_special_tokens=False).ids + [END_ID] for t in texts]


def test_a_full_store_of_parts_starts_anew(monkeypatch):
    monkeypatch.setattr("tablemend.llm.tokens.KEPT", 4)
    coder = BytePairs(TOKENIZER)
    texts = [f"alpha beta{k} gamma {k}" for k in range(40)]
    whole, got = reference(), []
    for text in texts:
        for _, ids, offs in coder.encode(pa.array([text])):
            got.append(ids.tolist())
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_round_trip(table, odd):
    cut = packing.pieces(table(odd), TOKENIZER, END_ID, 64, keep_ids=True)
    rows = packing.pack(cut, 64).collect()
    whole = reference()
    by_doc = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t, _ in odd:
        if i in (7, None):
            continue  # two rows of one id
        ids = np.concatenate([np.frombuffer(r["ids"], np.uint32) for r in by_doc[i]])
        assert ids.tolist() == whole.encode(t or "", add_special_tokens=False).ids + [END_ID]
        assert all(r["length"] == 64 for r in by_doc[i][1:]) and all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in by_doc[i])
        assert [r["piece"] for r in by_doc[i]] == list(range(len(by_doc[i])))
    seq = {}
    for r in rows:
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert len(seq) <= -(-sum(r["length"] for r in rows) // 64) + 3
    assert packing.pack(packing.pieces(table([]), TOKENIZER, END_ID, SEQUENCE), SEQUENCE).collect() == []


@given(st.lists(st.integers(1, 50), max_size=300), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_plans_hold_each_length_once(lengths, times):
    histogram = np.bincount(np.array(lengths, int), minlength=51) * times
    sequences = packing.plan(histogram, 50)
    used = np.zeros(51, int)
    for parts, repeats in sequences:
        assert sum(parts) <= 50 and repeats > 0
        for n in parts:
            used[n] += repeats
    assert (used == histogram).all()


def test_patterns_need_few_sequences():
    rng = np.random.default_rng(1)
    histogram = np.bincount(np.clip(rng.lognormal(5.5, 0.8, 30_000), 1, 1024).astype(int), minlength=1025)
    n = sum(r for _, r in packing.plan(histogram, 1024))
    assert n <= 1.01 * -(-(histogram * np.arange(1025)).sum() // 1024)


def test_the_vocabulary_is_a_parameter():
    assert TOKENIZER == public_tokenizers.path("byte_bpe_50k.json")
    with pytest.raises(Exception):
        BytePairs("/nowhere.json")


def test_parts_that_share_a_hash_keep_their_own_ids(monkeypatch):
    monkeypatch.setattr("tablemend.llm.tokens.span_hash", lambda data, start, stop: np.full(len(start), 5, np.uint64))
    coder, whole = BytePairs(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    texts = ["one two three", "", "two one", "three, three. Vier!"]
    for _ in range(2):
        got = [ids[a:b].tolist() for _, ids, offs in coder.encode(pa.array(texts)) for a, b in zip(offs[:-1], offs[1:], strict=True)]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [512, 4_096])
def test_long_words_have_their_own_ids(n):
    bits = [bin(k).count("1") % 2 for k in range(n)]
    texts = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    whole = Tokenizer.from_file(TOKENIZER)
    got = [ids[a:b].tolist() for _, ids, offs in BytePairs(TOKENIZER).encode(pa.array(texts)) for a, b in zip(offs[:-1], offs[1:], strict=True)]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]

"""Repair of conversations against a plain search over all edits."""

import hashlib
import heapq
import random
import zlib

import pytest

from tablemend.llm import conversations
from tablemend.llm.queries import QUERIES

SPACES = " \t\n\x0b\x0c\r"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAMES = {"u": "user", "a": "assistant"}


def damage(turns):
    out = []
    for conv, turn, role, text in turns:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired) by uniform-cost search over whole edit sequences."""
    best, heap = None, [(0, "", 0, 0, ())]
    seen = {}
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if best and (cost, audit) > best[:2]:
            break
        if at == len(rows) and state in (0, 3):
            best = min(best or (cost, audit, out), (cost, audit, out))
            continue
        # Partial audits may be dropped only if they are equally long and greater.
        key = (at, state, len(audit))
        if key in seen and seen[key] <= (cost, audit):
            continue
        seen[key] = (cost, audit)
        for letter in "ua":
            if (state, letter) in NEXT:
                heapq.heappush(heap, (cost + 5, audit + "I", at, NEXT[state, letter], (*out, (NAMES[letter], ""))))
        if at == len(rows):
            continue
        role, text, fault = rows[at]
        heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, out))
        if fault not in ("blank", "duplicate"):
            late = 5 if fault == "truncated" else 0
            if (state, role[:1]) in NEXT:
                heapq.heappush(heap, (cost + late, audit + "K", at + 1, NEXT[state, role[:1]], (*out, (role, text))))
            for letter in "ua":
                if (state, letter) in NEXT:
                    heapq.heappush(heap, (cost + late + 1, audit + "R", at + 1, NEXT[state, letter], (*out, (NAMES[letter], text))))
    return best


def plain(turns):
    after = damage(turns)
    out = {}
    for conv in {t[0] for t in turns}:
        mine = sorted((t for t in after if t[0] == conv), key=lambda t: (t[1] is not None, t[1], t[2], hashlib.md5(t[3].encode()).digest()))
        rows, seen = [], set()
        for _, _, role, text in mine:
            solid = text.strip(SPACES)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            rows.append((role, text, fault))
        numbers = {t[1] for t in mine} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        count = lambda f: sum(r[2] == f for r in rows)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:], strict=False)]
        cost, audit, repaired = cheapest(rows)
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs),
                     cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def some(seed, n=60):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \t", "One line.\nAnd two", None, "Ünïcödé!", "x" * 3_000 + "."]
    out = []
    for conv in [*range(n), None]:
        for turn in range(rng.choice([1, 2, 5, 9])):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            out.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, rng.choice(texts)))
    out += [out[3], out[3]]
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def report(spark, turns):
    frame = spark.createDataFrame(turns, SCHEMA)
    found = conversations.report(conversations.damaged(frame), frame.select("conv_id")).collect()
    assert len(found) == len({r["conv_id"] for r in found})
    return {r["conv_id"]: tuple(r)[1:] for r in found}


@pytest.mark.parametrize(("piece", "flush"), [(1 << 9, 1 << 18), (4, 50)])
def test_report_equals_plain_search(spark, monkeypatch, piece, flush):
    monkeypatch.setattr(conversations, "PIECE", piece)
    monkeypatch.setattr(conversations, "FLUSH", flush)
    turns = some(3)
    assert report(spark, turns) == plain(turns)


def test_a_conversation_with_most_rows_lies_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE", 64)
    rng = random.Random(8)
    turns = [(7, k, "user" if k % 2 == 0 else "assistant", f"Sentence {k if rng.random() < 0.9 else 1}{rng.choice('.. ')}") for k in range(3_000)]
    turns += [(k, t, r, f"Text {k} {t}.") for k in range(20, 60) for t, r in enumerate(["user", "assistant"])]
    frame = conversations.damaged(spark.createDataFrame(turns, SCHEMA))
    monkeypatch.setattr(conversations, "FLUSH", 2_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = conversations.placed(frame)
        assert rows.filter("conv_id = 7").selectExpr("rid >> 33 AS task").distinct().count() > 1
        found = report(spark, turns)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lines = [t for t in damage(turns) if t[0] == 7]
    got = found[7]
    assert len(got[6].replace("I", "")) == len(lines) and got[5] > 0
    # The audit gives the digest back.
    state, out, letters = 0, [], iter(got[6])
    for _, _, role, text in lines:
        letter = next(letters)
        while letter == "I":
            new = {0: "u", 1: "u", 2: "a", 3: "u"}[state]
            out.append(NAMES[new] + ":")
            state, letter = NEXT[state, new], next(letters)
        if letter != "D":
            new = role[0] if letter == "K" else {0: "u", 1: "u", 2: "a", 3: "u"}[state]
            out.append((role if letter == "K" else NAMES[new]) + ":" + text)
            state = NEXT[state, new]
    out += ["assistant:"] * (got[6].endswith("I") and state == 2)
    assert hashlib.sha256("\n".join(out).encode()).hexdigest() == got[7]
    assert {k: v for k, v in found.items() if k != 7} == plain([t for t in turns if t[0] != 7])


def test_nodes_are_shared_by_endings():
    """Every distinct ending is stepped to once."""
    rng = random.Random(2)
    texts = sorted({"".join(rng.choice("AEDHI") for _ in range(rng.randint(1, 6))) for _ in range(300)})
    for signature, cost, audit in conversations.walk(iter(texts)):
        rows = [({"s": "system", "u": "user", "a": "assistant", ".": "x"}[conversations._ROLES[ord(c)]], "t",
                 ["", "blank", "duplicate", "truncated"][(ord(c) - 65) % 4]) for c in signature]
        assert (cost, audit) == cheapest(rows)[:2]


def test_repaired_turns_and_odd_tables(spark):
    frame = spark.createDataFrame(
        [(1, 0, "user", "Hello.", "p"), (1, 1, "user", "Hello.", "q"), (1, 2, "assistant", "Good day!", "r"), (2, 0, "assistant", "Alone.", "s")],
        "conv_id int, turn int, role string, text string, rid string")
    lines = sorted(conversations.repair(frame).collect(), key=lambda r: (r["conv_id"], r["place"], r["nth"]))
    assert [(r["conv_id"], r["role"], r["text"]) for r in lines] == [
        (1, "user", "Hello."), (1, "assistant", "Good day!")]
    assert report(spark, []) == {}


def test_query(spark, tmp_path):
    turns = some(5, 20)
    spark.createDataFrame(turns, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    found = QUERIES["op11_suffix_dawg_repair"](spark, str(tmp_path)).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in found} == plain(turns)

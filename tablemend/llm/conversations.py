"""Repair of conversation structure: cheapest edits by a suffix-shared automaton of role and fault signatures.

The turns of a conversation, in order, spell a signature: per turn a letter for its role's initial
(s, u, a, other) and its first fault (none, blank, duplicate, truncated).  Signatures that end
alike share nodes: a node is a distinct ending, and all distinct signatures, sorted from their
ends, are one walk over the nodes (:func:`walk`).  A node holds, for each state of the grammar
``(s?(ua)+)?``, the cheapest cost to the end and the edit that begins it.  Every edit has
another letter, so ties between audits are settled by the first letter and the rest is the child's.

Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (the only one for blank and duplicate
turns), Insert an empty user or assistant turn 5; a truncated turn that stays adds 5.

On Spark: turns get their place by one sort over ranges of (conversation, turn, role, text digest),
without their texts, so a conversation with a third of all rows lies in many tasks.  Distinct
signatures are solved once.  Edits go back to the rows in pieces of ``PIECE``; texts are shuffled once,
together with the edits of their rows.  A conversation's signature and audit lie in one cell, one
byte a turn, and solving takes about ten bytes a turn; nothing else of a conversation is gathered, and its text
passes through :func:`digests` as a stream.

Order: by turn, nulls first; rows of one turn by role and by the MD5 of their text.  Null roles and texts
are one space.  Null conversation ids are one conversation.  Rows that repeat all columns are
duplicates of each other.  Turns and ids are whole numbers.  An empty table gives no rows.  Other columns are ignored
and may have any name.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.llm.common import stage

#: Rows of a conversation whose edits travel together, as a power of two.
PIECE = 1 << 9
#: Characters of a conversation that a task gathers before it passes them on.
FLUSH = 1 << 18
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
_INITIALS = "sua"
#: The grammar: the states behind s, u and a; the states in which a conversation may end.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_FORCED = ("u", "u", "a", "u")
_ENDS = (0, 3)
_NAMES = {"u": "user", "a": "assistant"}
_BASE = 65  # letter of the symbol (role 0, no fault)
_ROLES = {_BASE + 4 * r + f: "sua."[r] for r in range(4) for f in range(4)}
_FAULTS = {_BASE + 4 * r + f: "okbdt"[1 + f] for r in range(4) for f in range(4)}


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows after the damage that their ids draw."""
    part = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", part("conv_id"), part("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    return turns.filter(kind != 0).select(
        turns["conv_id"].alias("conv_id"), turns["turn"].alias("turn"),
        F.when(kind == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def whole(turns: DataFrame) -> DataFrame:
    """The same columns of turns as they are."""
    part = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" ")).alias(c)
    return turns.select(turns["conv_id"].alias("conv_id"), turns["turn"].alias("turn"), part("role"), part("text"), F.lit(1).alias("copies"))


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text_key, fault, rid: every row with its place, staged; rid grows in the order of turns."""
    black = r"[^\x20\x09-\x0D]"
    fault = F.when(~F.col("text").rlike(black), BLANK).when(
        ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(OK)
    light = turns.select("conv_id", "turn", "role", _text_key(F.col("text")).alias("text_key"), fault.alias("fault"), "copies")
    order = ["conv_id", "turn", "role", "text_key"]
    each = light.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    ordered = each.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(ordered.drop("copy").withColumn("rid", F.monotonically_increasing_id()), "turns")


def signed(rows: DataFrame) -> DataFrame:
    """conv_id, block, start, symbols: the signature in pieces of consecutive rows, staged."""
    same = ["conv_id", "role", "text_key"]
    again = rows.filter(F.col("fault") != BLANK).groupBy(*same).agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("n"))
    again = again.filter("n > 1").select(*[F.col(c).alias(f"__{c}") for c in same], "first")
    match = [rows[c].eqNullSafe(again[f"__{c}"]) for c in same]
    known = rows.join(again, match, "left")
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("rid") > F.col("first"), DUPLICATE).otherwise(F.col("fault"))
    role = F.coalesce(F.nullif(F.instr(F.lit(_INITIALS), F.nullif(F.left("role", F.lit(1)), F.lit(""))), F.lit(0)), F.lit(4)) - 1
    symbol = F.char((_BASE + 4 * role + fault).cast("long"))
    lettered = known.select("conv_id", "rid", (F.col("rid") / PIECE).cast("long").alias("block"), symbol.alias("symbol"))
    gathered = lettered.groupBy("conv_id", "block").agg(
        F.min("rid").alias("start"), F.array_sort(F.collect_list(F.struct("rid", "symbol"))).alias("rows"))
    return stage(gathered.select("conv_id", "block", "start", F.array_join(F.col("rows.symbol"), "").alias("symbols")), "turn-pieces")


def signatures(pieces: DataFrame) -> DataFrame:
    """conv_id, signature, places: the whole signature, and where its pieces begin and how long they are."""
    listed = F.array_sort(F.collect_list(F.struct("block", "start", "symbols")))
    grouped = pieces.groupBy("conv_id").agg(listed.alias("p"))
    places = F.transform("p", lambda p: F.struct(p["block"].alias("block"), p["start"].alias("start"), F.length(p["symbols"]).alias("n")))
    return grouped.select("conv_id", F.array_join(F.col("p.symbols"), "").alias("signature"), places.alias("places"))


@lru_cache(None)
def _step(symbol: str, child: tuple[int, ...]) -> tuple[int, tuple[int, ...], str]:
    """(cost, costs above it by state, first edits by state) of a node with this letter before a child's costs."""
    role, fault = _ROLES[ord(symbol)], (ord(symbol) - _BASE) % 4
    late = 5 if fault == TRUNCATED else 0
    options: list[list[tuple[int, str]]] = []
    for state in range(4):
        here = [(2 + child[state], "D")]
        if fault in (OK, TRUNCATED):
            if role in _NEXT[state]:
                here.append((late + child[_NEXT[state][role]], "K"))
            here.append((late + 1 + child[_NEXT[state][_FORCED[state]]], "R"))
        options.append(here)
    return _closed(options)


def _closed(options: list[list[tuple[int, str]]]) -> tuple[int, tuple[int, ...], str]:
    """Adds insertions, which lead to another state of the same node."""
    costs = [min((c for c, _ in here), default=99) for here in options]
    onto = [_NEXT[s][_FORCED[s]] for s in range(4)]
    for _ in range(3):
        costs = [min(costs[s], 5 + costs[onto[s]]) for s in range(4)]
    edits = "".join(min([*options[s], (5 + costs[onto[s]], "I")])[1] for s in range(4))
    low = min(costs)
    return low, tuple(c - low for c in costs), edits


def _last() -> tuple[int, tuple[int, ...], str]:
    return _closed([[(0, "")] if s in _ENDS else [] for s in range(4)])


def walk(reversed_signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit); signatures come reversed and sorted, so that one that shares an ending keeps its nodes."""
    low, costs, edits = _last()
    nodes, cost_so_far, before = [(costs, edits)], array("q", [low]), ""
    for text in reversed_signatures:
        common = 0
        while common < min(len(before), len(text)) and before[common] == text[common]:
            common += 1
        del nodes[common + 1:], cost_so_far[common + 1:]
        for symbol in text[common:]:
            low, costs, edits = _step(symbol, nodes[-1][0])
            nodes.append((costs, edits))
            cost_so_far.append(cost_so_far[-1] + low)
        before = text
        audit, state, depth = [], 0, len(text)
        while depth or state not in _ENDS:
            edit = nodes[depth][1][state] if depth else "I"
            audit.append(edit)
            if edit == "K":
                state = _NEXT[state][_ROLES[ord(text[depth - 1])]]
            elif edit != "D":
                state = _NEXT[state][_FORCED[state]]
            depth -= edit != "I"
        yield text[::-1], cost_so_far[-1] + nodes[-1][0][0], "".join(audit)


_SOLVED = pa.schema([("signature", pa.string()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
                     ("audit", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column r, sorted: the reversed signatures."""
    rows, size = [], 0
    for signature, cost, audit in walk(text for batch in batches for text in batch.column(0).to_pylist()):
        roles, faults = signature.translate(_ROLES), signature.translate(_FAULTS)
        illegal = max(0, len(roles) - 1) - sum(roles.count(p) for p in ("su", "ua", "au"))
        rows.append((signature, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit))
        size += len(audit)
        if len(rows) >= 4_096 or size > FLUSH:
            yield _batch(rows, _SOLVED)
            rows, size = [], 0
    if rows:
        yield _batch(rows, _SOLVED)


def solve(convs: DataFrame) -> DataFrame:
    """signature, blank, duplicate, truncated, illegal, cost, audit of every distinct signature."""
    distinct = convs.select(F.reverse("signature").alias("r")).distinct()
    return distinct.repartitionByRange("r").sortWithinPartitions("r").mapInArrow(
        _solved, "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns conv_id, signature, audit, places: the edits of each piece's rows, as arrays of strings.

    A row's string is the roles of inserted turns before it (u, a), its own new role or ``k`` to keep it or ``-``
    for deleted, and the roles of inserted turns behind it (the last row only)."""
    for batch in batches:
        conv, block, start, edits = [], [], [], []
        for k in range(batch.num_rows):
            signature, audit = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
            at, row, state, rows = 0, 0, 0, []

            def inserted() -> str:
                nonlocal at, state
                out = ""
                while at < len(audit) and audit[at] == "I":
                    out += _FORCED[state]
                    state = _NEXT[state][_FORCED[state]]
                    at += 1
                return out

            for place in batch.column(3)[k].as_py():
                rows = []
                for _ in range(place["n"]):
                    new = inserted()
                    edit = audit[at]
                    at += 1
                    if edit == "D":
                        new += "-"
                    else:
                        role = _ROLES[ord(signature[row])] if edit == "K" else _FORCED[state]
                        new += "k" if edit == "K" else role.upper()
                        state = _NEXT[state][role]
                    row += 1
                    rows.append(new)
                if row == len(signature):
                    rows[-1] += inserted()
                conv.append(k)
                block.append(place["block"])
                start.append(place["start"])
                edits.append(rows)
                if len(edits) >= 64:
                    yield _pieces(batch, conv, block, start, edits)
                    conv, block, start, edits = [], [], [], []
        if edits:
            yield _pieces(batch, conv, block, start, edits)


def _pieces(batch: pa.RecordBatch, conv, block, start, edits) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(conv, pa.int32())), pa.array(block, pa.int64()), pa.array(start, pa.int64()),
         pa.array(edits, pa.list_(pa.string()))], ["conv_id", "block", "start", "edits"])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, rid, [(role, text)…]) of rows sorted so that a row's text comes before its edits."""
    text = None
    for batch in batches:
        columns = [batch.schema.get_field_index(c) for c in ("conv_id", "rid", "role", "text", "edit")]
        conv, rid, role, texts, edits = (batch.column(c) for c in columns)
        for k in range(batch.num_rows):
            edit = edits[k].as_py()
            if edit is None:
                text = texts[k].as_py()
                continue
            out = []
            for letter in edit:
                if letter in "ua":
                    out.append((_NAMES[letter], ""))
                elif letter != "-":
                    out.append((role[k].as_py() if letter == "k" else _NAMES[letter.lower()], text))
            yield conv[k].as_py(), rid[k].as_py(), out


def _met(turns: DataFrame, rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Texts and edits of the rows in the order of turns, over ranges: texts are shuffled here, once."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    pieces = convs.select("conv_id", "signature", "audit", "places").mapInArrow(
        _cut, f"conv_id {kind}, block long, start long, edits array<string>")
    pieces = pieces.select(F.col("conv_id").alias("__conv"), F.col("block").alias("__block"), "start", "edits")
    mine = rows["conv_id"].eqNullSafe(F.col("__conv")) & ((F.col("rid") / PIECE).cast("long") == F.col("__block"))
    edit = F.element_at("edits", (F.col("rid") - F.col("start") + 1).cast("int"))
    edited = rows.join(pieces, mine).select("conv_id", "turn", "role", "text_key", "rid", edit.alias("edit"), F.lit(None).cast("string").alias("text"))
    texts = turns.select("conv_id", "turn", "role", _text_key(F.col("text")).alias("text_key"), F.lit(-1).cast("long").alias("rid"),
                         F.lit(None).cast("string").alias("edit"), "text")
    order = ["conv_id", "turn", "role", "text_key"]
    both = texts.unionByName(edited).repartitionByRange(*order).sortWithinPartitions(*order, "rid")
    return both.select("conv_id", "rid", "role", "text", "edit")


def repaired_turns(turns: DataFrame, rows: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, place, nth, role, text: the repaired turns; (place, nth) is their order inside a conversation."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([("conv_id", _whole_number(kind)), ("place", pa.int64()), ("nth", pa.int32()), ("role", pa.string()), ("text", pa.string())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv, rid, lines in _lines(batches):
            out += [(conv, rid, n, role, text) for n, (role, text) in enumerate(lines)]
            size += sum(len(text) for _, text in lines)
            if len(out) >= 4_096 or size >= FLUSH:
                yield _batch(out, schema)
                out, size = [], 0
        if out:
            yield _batch(out, schema)

    return _met(turns, rows, convs).mapInArrow(emit, f"conv_id {kind}, place long, nth int, role string, text string")


def _whole_number(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64()}[kind]


def _transcribed(kind: str):
    schema = pa.schema([("conv_id", _whole_number(kind)), ("place", pa.int64()), ("piece", pa.string()), ("sha256", pa.string())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(conversation, null, null, digest) of those that lie inside the task, and pieces of the others."""
        out, size, held, held_size, place, now, started = [], 0, [], 0, 0, None, False
        passed_on = True  # the first conversation of a task may have begun before it
        for conv, rid, lines in _lines(batches):
            if started and conv != now:
                if held:
                    text = "\n".join(held)
                    out.append((now, place, text, None) if passed_on else (now, None, None, hashlib.sha256(text.encode()).hexdigest()))
                    size += held_size
                passed_on, held, held_size = False, [], 0
            now, started = conv, True
            for role, text in lines:
                if not held:
                    place = rid
                held.append(f"{role}:{text}")
                held_size += len(held[-1])
            if held_size > FLUSH:
                out.append((now, place, "\n".join(held), None))
                size, passed_on, held, held_size = size + held_size, True, [], 0
            if len(out) >= 4_096 or size > FLUSH:
                yield _batch(out, schema)
                out, size = [], 0
        if held:  # it may go on in the next task
            out.append((now, place, "\n".join(held), None))
        if out:
            yield _batch(out, schema)

    return emit


def _joined(kind: str):
    schema = pa.schema([("conv_id", _whole_number(kind)), ("sha256", pa.string())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns conv_id, piece, sorted by conversation and place."""
        now, digest, out = None, None, []
        for batch in batches:
            for k in range(batch.num_rows):
                conv, piece = batch.column(0)[k].as_py(), batch.column(1)[k].as_py().encode()
                if digest is not None and conv == now:
                    digest.update(b"\n" + piece)
                    continue
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = conv, hashlib.sha256(piece)
        if digest is not None:
            out.append((now, digest.hexdigest()))
            yield _batch(out, schema)

    return join


def digests(turns: DataFrame, rows: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, sha256 of each conversation's repaired ``role:text``, newline-joined; none for one without repaired turns.

    A task digests the conversations that lie inside its range; the first and the last, and what is longer than ``FLUSH``
    characters, are passed on in pieces, which are digested as streams."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    found = stage(_met(turns, rows, convs).mapInArrow(_transcribed(kind), f"conv_id {kind}, place long, piece string, sha256 string"),
                  "transcripts")
    pieces = found.filter(F.col("piece").isNotNull()).select("conv_id", "place", "piece")
    streamed = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "piece")
    return found.filter(F.col("piece").isNull()).select("conv_id", "sha256").unionByName(
        streamed.mapInArrow(_joined(kind), f"conv_id {kind}, sha256 string"))


def gaps(rows: DataFrame) -> DataFrame:
    """conv_id, gaps: whole numbers that lack between the smallest and the largest turn."""
    turn = F.col("turn")
    lacking = F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn)
    return rows.groupBy("conv_id").agg(F.coalesce(lacking, F.lit(0)).cast("long").alias("gaps"))


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, signature, places, and the solution of the signature, staged."""
    convs = stage(signatures(signed(rows)), "conversations")
    solved = stage(solve(convs), "automaton").withColumnRenamed("signature", "__signature")
    joined = convs.join(solved, convs["signature"] == solved["__signature"]).drop("__signature")
    return stage(joined, "audits")


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, place, nth, role, text: the repaired turns of a table (conv_id, turn, role, text)."""
    turns = whole(turns)
    rows = placed(turns)
    return repaired_turns(turns, rows, conversations(rows))


def report(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: gaps, faults, cost, audit and the digest of the repaired text.

    ``turns`` (conv_id, turn, role, text, copies) is what :func:`whole` or :func:`damaged` gives; ``ids`` are all
    conversations to report on, also those that lost all rows."""
    rows = placed(turns)
    convs = conversations(rows)
    every = (rows if ids is None else ids).select(F.col("conv_id")).distinct()
    parts = [gaps(rows), convs.drop("signature", "places"), digests(turns, rows, convs)]
    for part in parts:
        part = part.withColumnRenamed("conv_id", "__conv")
        every = every.join(part, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").drop("__conv")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

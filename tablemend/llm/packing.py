"""Packing documents into sequences by patterns and non-negative least squares.

Documents become tokens (a byte-level BPE file and an end id); those longer than a
sequence are cut into full pieces behind a shorter first one.  The histogram of
piece lengths (at most one row per length) goes to the driver.  There, patterns of one
to three lengths that fill a sequence exactly are fitted to the histogram by
non-negative least squares, repeat counts are rounded down, and what is left is packed best
fit, longest first, on counts alone.  The plan says for each length which of its
pieces go into which sequences; pieces are numbered inside their length on the
executors and look their place up.

Nulls and edge cases: a null or empty text is the end id alone; repeated rows are
packed each for itself; an empty table gives no rows.  Columns besides ``doc_id`` and
``text`` may have any name.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemend.llm.common import number_rows, stage
from tablemend.llm.tokens import BytePairs

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n_ids: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full ones behind a shorter first one."""
    first = n_ids % room or room
    return [(0, first)] + [(s, room) for s in range(first, n_ids, room)]


def pieces(docs: DataFrame, vocabulary: str, end_id: int, room: int, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents; with ``keep_ids`` also their ids, little-endian unsigned 32-bit."""
    schema = PIECES + (", ids binary" if keep_ids else "")
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BytePairs.of(vocabulary)
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for lo, ids, offs in coder.encode(batch.column(1), end_id):
                doc, piece, start, length, crc, raw = [], [], [], [], [], []
                for k in range(len(offs) - 1):
                    for p, (s, n) in enumerate(cut(int(offs[k + 1] - offs[k]), room)):
                        part = ids[offs[k] + s:offs[k] + s + n].tobytes()
                        doc.append(ids_of[lo + k])
                        piece.append(p)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(part))
                        raw.append(part)
                columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns, names = [*columns, pa.array(raw, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return narrow.mapInArrow(tokenise, schema)


def patterns(lengths: np.ndarray, room: int) -> np.ndarray:
    """All ways to fill ``room`` exactly with two or three of the given lengths, longest first, 0 for no third."""
    has = np.zeros(room + 1, bool)
    has[lengths] = True
    found = []
    two = lengths[(lengths * 2 >= room) & (lengths < room)]
    two = two[has[room - two]]
    found.append(np.stack([two, room - two, np.zeros_like(two)], axis=1))
    for a in lengths[lengths < room]:
        rest = room - a
        b = lengths[(lengths <= a) & (lengths * 2 >= rest) & (lengths < rest)]
        b = b[has[rest - b]]
        found.append(np.stack([np.full_like(b, a), b, rest - b], axis=1))
    return np.concatenate(found)


def least_squares(lines: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that brings the patterns' lengths near the histogram: accelerated projected gradients.

    Long pieces weigh more than short ones, which fill gaps later on.
    """
    size = len(histogram)
    weight = np.arange(size, dtype=float) / (size - 1)
    weight[0] = 0
    want = histogram.astype(float)

    def made(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(lines[:, j], x, minlength=size) for j in range(3))

    use = made(np.ones(len(lines))) * weight
    # A diagonal step: each pattern moves by the least slack of its lengths' curvatures.
    curve = np.maximum(1e-9, sum(use[lines[:, j]] for j in range(3)))
    x = np.zeros(len(lines))
    y, t = x.copy(), 1.0
    for _ in range(steps):
        error = (made(y) - want) * weight
        gradient = sum(error[lines[:, j]] for j in range(3))
        nxt = np.maximum(0, y - gradient / curve)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


def best_fit(left: np.ndarray, room: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): best fit on counts, longest first; equal sequences are filled together."""
    open_room: list[int] = []            # the distinct free rooms, ascending
    bins: dict[int, list[list]] = {}     # free room -> [lengths, repeats]
    done: list[tuple[tuple[int, ...], int]] = []

    def put(lengths: tuple[int, ...], free: int, repeats: int) -> None:
        if free == 0:
            done.append((lengths, repeats))
            return
        if free not in bins:
            insort(open_room, free)
            bins[free] = []
        bins[free].append([lengths, repeats])

    for length in range(room, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(open_room, length)
            if at == len(open_room):
                fit = room // length
                if n >= fit:
                    put((length,) * fit, room - fit * length, n // fit)
                if n % fit:
                    put((length,) * (n % fit), room - (n % fit) * length, 1)
                break
            free = open_room[at]
            group = bins[free][-1]
            each = min(free // length, max(1, n // group[1]))
            take = min(group[1], n // each)
            group[1] -= take
            if not group[1]:
                bins[free].pop()
                if not bins[free]:
                    del bins[free]
                    open_room.pop(at)
            n -= take * each
            put(group[0] + (length,) * each, free - each * length, take)
    return done + [(lengths, repeats) for groups in bins.values() for lengths, repeats in groups if repeats]


def plan(histogram: np.ndarray, room: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of all sequences; ``histogram[n]`` pieces have length n."""
    left = histogram.astype(np.int64).copy()
    out = [((room,), int(left[room]))] if left[room] else []
    left[room] = 0
    lines = patterns(np.flatnonzero(left), room)
    if len(lines):
        x = np.floor(least_squares(lines, left) + 1e-6).astype(np.int64)
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 1:
                break
            line = tuple(int(n) for n in lines[k] if n)
            kinds, need = np.unique(line, return_counts=True)
            repeats = int(min(x[k], (left[kinds] // need).min()))
            if repeats:
                left[kinds] -= repeats * need
                out.append((line, repeats))
    return out + best_fit(left, room)


def places(sequences: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """length, first, sequence, step, offset: a length's pieces from number ``first`` on go to sequences
    ``sequence``, ``sequence + 1`` …, at ``offset``; one row per length and place of a pattern."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, repeats in sequences:
        offset = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), base, offset))
            used[n] = used.get(n, 0) + repeats
            offset += n
        base += repeats
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).sort_values(["length", "first"])


def pack(cut_pieces: DataFrame, room: int) -> DataFrame:
    """The pieces with sequence_id and offset."""
    staged = stage(cut_pieces, "pieces")
    counts = staged.groupBy("length").count().collect()  # at most ``room`` rows
    histogram = np.zeros(room + 1, np.int64)
    for row in counts:
        histogram[row["length"]] = row["count"]
    table = places(plan(histogram, room))
    length, first = table["length"].to_numpy(np.int64), table["first"].to_numpy(np.int64)
    sequence, offset = table["sequence"].to_numpy(np.int64), table["offset"].to_numpy(np.int64)
    start = np.searchsorted(length, np.arange(room + 2))  # where a length's rows begin
    # Numbers inside a length stay below 2^48.
    key = (length << 48) + first

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(lengths: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        n = lengths.to_numpy(np.int64)
        at = np.searchsorted(key, (n << 48) + numbers.to_numpy(np.int64), "right") - 1
        assert (at >= start[n]).all()
        return pd.DataFrame({"sequence_id": sequence[at] + numbers.to_numpy(np.int64) - first[at], "offset": offset[at]})

    numbered = number_rows(staged, ["length"], ["doc_id", "piece", "ids_crc32"], "__number")
    placed = numbered.withColumn("__place", place("length", "__number"))
    return placed.select(*staged.columns, "__place.sequence_id", "__place.offset")

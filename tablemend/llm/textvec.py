"""Whole batches of texts as byte arrays: words, their hashes and their shingles, without a loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

# Random words for bytes, and odd multipliers with their inverses modulo 2^64.
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C17
_BACK = pow(_STEP, -1, 1 << 64)
#: Bytes up to which sums of powers are used.
_SHORT = 64
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 … base^(n-1) modulo 2^64, kept and grown by doubling."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def chunks(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) of about ``most`` bytes; a null is an empty text.

    Only one chunk is copied at a time: a batch of texts is large next to a worker's memory."""
    n = len(column)
    upto = np.concatenate([[0], np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False))])
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(upto, upto[lo] + most, "right")) - 1))
        part = column.slice(lo, hi - lo).fill_null("").cast(pa.large_string())
        _, offsets, data = part.buffers()
        offs = np.frombuffer(offsets, np.int64, hi - lo + 1, part.offset * 8)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        yield lo, hi, raw[offs[0]:offs[-1]], offs - offs[0]
        lo = hi


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of true positions; no run crosses rows."""
    n = len(inside)
    first = np.zeros(n + 1, bool)
    first[offs] = True
    first = first[:n]
    begin, end = inside.copy(), inside.copy()
    if n:
        begin[1:] &= first[1:] | ~inside[:-1]
        end[:-1] &= first[1:] | ~inside[1:]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return start, stop, np.searchsorted(offs, start, "right") - 1


def span_hash(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes give equal hashes.

    Up to ``_SHORT`` bytes, a sum of powers modulo 2^64.  Such a sum cannot tell some long words apart (those that
    alternate like the Thue-Morse sequence and its complement), so longer ranges get XXH3 of their bytes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_STEP, len(data)), out=total[1:])
    if len(data):
        powers(_BACK, len(data))
    back = _powers[_BACK] if len(data) else np.ones(1, np.uint64)
    out = mix((total[stop] - total[start]) * back[start])
    long = np.flatnonzero(stop - start > _SHORT)
    if len(long):
        raw = data.tobytes()
        out[long] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start[long], stop[long], strict=True)]
    return out


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word, A-Z lower-cased, in order."""
    start, stop, row = runs(~_BLANK[data], offs)
    return row, span_hash(_FOLD[data], start, stop)


def stems(data: np.ndarray, offs: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word of letters and digits and of its first bytes, A-Z lower-cased; order is not kept.

    A beginning of n bytes counts for words that are longer, and differs from a word that is equal to it."""
    start, stop, row = runs(_TERM[data], offs)
    folded = _FOLD[data]
    rows, hashes = [row], [span_hash(folded, start, stop)]
    for n in lengths:
        longer = stop - start > n
        rows.append(row[longer])
        hashes.append(mix(span_hash(folded, start[longer], start[longer] + n) + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(hashes)


def shingles(row: np.ndarray, word: np.ndarray, n_rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct word shingles, ordered by both; fewer words than ``width`` count as one."""
    c = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(width)]
    n = len(word)
    if n >= width:
        full = row[: n - width + 1] == row[width - 1:]
        total = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            total += word[k:n - width + 1 + k] * c[k]
        rows, hashes = row[: n - width + 1][full], mix(total[full])
    else:
        rows, hashes = row[:0], word[:0]
    count = np.bincount(row, minlength=n_rows)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        at = np.searchsorted(row, short)
        total = count[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        for k in range(width - 1):
            has = count[short] > k
            total[has] += word[at[has] + k] * c[k]
        rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, mix(total)])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    if len(rows):
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        rows, hashes = rows[new], hashes[new]
    return rows, hashes

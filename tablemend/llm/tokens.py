"""Token ids of whole batches: the text is cut where the tokenizer cuts it for certain, and each distinct part is encoded once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tablemend.llm.textvec import chunks, span_hash

#: Distinct parts that a worker keeps; beyond them it starts anew.
KEPT = 400_000
#: Bytes of parts that a worker keeps.
KEPT_BYTES = 1 << 26
_SLOTS = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def certain_cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Positions where a part begins.

    The byte-level pattern never joins a non-space with a white space behind it, a single
    control white space with the non-space behind it, or a letter with a punctuation mark behind it
    (apostrophes are left alone).  A byte above 127 before a space only counts as a non-space in a
    two-byte character that is no white space (lead byte above 0xC2).
    """
    n = len(data)
    begin = np.zeros(n + 1, bool)
    begin[offs] = True
    begin = begin[:n]
    if n < 2:
        return np.flatnonzero(begin)
    before, here = data[:-1], data[1:]
    two = np.zeros(n - 1, bool)
    two[1:] = (before[1:] >= 0x80) & (before[1:] < 0xC0) & (data[:-2] > 0xC2) & (data[:-2] < 0xE0)
    solid = ((before > 32) & (before < 127)) | two
    begin[1:] |= solid & _SPACE[here]
    begin[1:] |= begin[:-1] & _SPACE[before] & (before != 32) & (here > 32) & (here < 127)
    begin[1:] |= _LETTER[before] & _MARK[here]
    return np.flatnonzero(begin)


class BytePairs:
    """A byte-level BPE of a ``tokenizers`` file."""

    _open: dict[str, BytePairs] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.whole.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.shown = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
        self._forget()

    @classmethod
    def of(cls, path: str) -> BytePairs:
        """One per Python worker, with what it has learnt."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _forget(self, room: int = KEPT) -> None:
        self.size, self.room = 0, room
        self.keys = np.zeros(room, np.uint64)    # hashes of the parts, in the order learnt
        self.first = np.zeros(room, np.int64)    # where their ids begin
        self.count = np.zeros(room, np.int64)
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0
        self.begin = np.zeros(room, np.int64)    # where their bytes begin
        self.length = np.zeros(room, np.int64)
        self.text, self.n_bytes = np.zeros(1 << 16, np.uint8), 0
        self.slots = np.full(_SLOTS, -1, np.int32)

    def _encode_part(self, part: bytes) -> list[int]:
        body = (part[1:] if part[:1] == b" " else part).decode("utf-8")
        if body.isalpha() and max(body) < "\u0250":  # Latin letters, at most one space before: one word for the merges
            return [t.id for t in self.model.tokenize(part.decode("latin-1").translate(self.shown))]
        return self.whole.encode(part.decode("utf-8"), add_special_tokens=False).ids

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Numbers of the parts, -1 for unknown ones.  Each part lives in one of two slots."""
        found = np.full(len(key), -1, np.int64)
        for shift in (0, 32):
            at = self.slots[((key >> np.uint64(shift)) & np.uint64(_SLOTS - 1)).astype(np.int64)]
            hit = (at >= 0) & (self.keys[at] == key)
            found[hit] = at[hit]
        return found

    def _learn(self, key: np.ndarray, parts: list[bytes]) -> np.ndarray:
        """Numbers of new parts.  One that finds both slots taken replaces another, which is learnt again when needed."""
        number = self._keep(key, parts)
        one, two = (((key >> np.uint64(s)) & np.uint64(_SLOTS - 1)).astype(np.int64) for s in (0, 32))
        self.slots[np.where((self.slots[one] >= 0) & (self.slots[two] < 0), two, one)] = number
        return number

    def _grow(self, more: int) -> None:
        """Room for as many parts again."""
        if self.size + more > self.room:
            self.room = self.size + more
            for name in ("keys", "first", "count", "begin", "length"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros(self.room - len(old), old.dtype)]))

    def _keep(self, key: np.ndarray, parts: list[bytes]) -> np.ndarray:
        """Numbers of parts whose ids and bytes are now kept."""
        found = [self._encode_part(p) for p in parts]
        count = np.array([len(f) for f in found], np.int64)
        ids = np.array([i for f in found for i in f], np.uint32)
        number = np.arange(self.size, self.size + len(key))
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.n_ids:self.n_ids + len(ids)] = ids
        self.keys[number], self.count[number] = key, count
        self.first[number] = self.n_ids + np.cumsum(count) - count
        joined, length = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts], np.int64)
        while self.n_bytes + len(joined) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.text[self.n_bytes:self.n_bytes + len(joined)] = joined
        self.begin[number], self.length[number] = self.n_bytes + np.cumsum(length) - length, length
        self.size, self.n_ids, self.n_bytes = self.size + len(key), self.n_ids + len(ids), self.n_bytes + len(joined)
        return number

    def _same(self, at: np.ndarray, data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Whether the kept bytes are the parts' own; the parts tile ``data``."""
        same = self.length[at] == stop - begin
        span = np.where(same, self.begin[at] - begin, -begin)  # any bytes for those of another length
        where = np.repeat(span, stop - begin) + np.arange(len(data))
        return same & ~np.logical_or.reduceat(self.text[where] != data, begin)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets of the rows in them) of chunks of texts; each row ends with ``end_id``."""
        for lo, hi, data, offs in chunks(texts):
            begin = certain_cuts(data, offs[offs < len(data)]) if len(data) else np.zeros(0, np.int64)
            stop = np.append(begin[1:], len(data)) if len(begin) else begin
            key = span_hash(data, begin, stop)
            at = self._find(key)
            lacking = np.flatnonzero(at < 0)
            if len(lacking):
                kinds, sample, where = np.unique(key[lacking], return_index=True, return_inverse=True)
                if self.size + len(kinds) > self.room or self.n_bytes > KEPT_BYTES:
                    kinds, sample, where = np.unique(key, return_index=True, return_inverse=True)
                    lacking = np.arange(len(key))
                    self._forget(max(KEPT, len(kinds)))
                raw = data.tobytes()
                at[lacking] = self._learn(kinds, [raw[begin[s]:stop[s]] for s in lacking[sample]])[where]
            other = np.flatnonzero(~self._same(at, data, begin, stop)) if len(data) else np.zeros(0, np.int64)
            if len(other):  # parts that share a hash with others are encoded each for itself
                raw = data.tobytes()
                self._grow(len(other))
                at[other] = self._keep(key[other], [raw[begin[k]:stop[k]] for k in other])
            n, first = self.count[at], self.first[at]
            row = np.searchsorted(offs, begin, "right") - 1
            extra = 0 if end_id is None else 1
            per_row = np.bincount(row, n, minlength=hi - lo).astype(np.int64) + extra
            ends = np.concatenate([[0], np.cumsum(per_row)])
            out = np.empty(int(ends[-1]), np.uint32)
            target = np.cumsum(n) - n + row * extra  # rows before this one have one id more each
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(target, n) + inner] = self.ids[np.repeat(first, n) + inner]
            if extra:
                out[ends[1:] - 1] = end_id
            yield lo, out, ends

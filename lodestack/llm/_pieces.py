"""Texts as pieces whose byte-level BPE encodings can simply be joined, encoded once each.

The pre-tokenizer of byte-level BPE always cuts before a single space and around a single
line feed that stand between characters other than white space, and between a letter and a
punctuation mark other than an apostrophe.  A :class:`PieceTable` cuts there, keeps the codes
and bytes of pieces it has met in a bounded hash table, and has only new ones encoded.  All
but that runs in NumPy over many texts at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np

from . import _vec as V

U64 = np.uint64
#: Slots of a worker's table; it starts anew when half full.
SLOTS = 1 << 22
#: Text whose pieces are looked up together, and bytes of pieces kept to compare (one may be longer).
CHUNK, RAW_BYTES = 1 << 19, 1 << 25

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[x for x in range(33, 127) if not chr(x).isalnum() and x != 39]] = True
_PLAIN = np.arange(256) > 32  # neither white space nor a control character
#: Lead bytes of characters that may be white space (U+0085, U+00A0, U+1680, U+2000 to U+3000).
_MAYBE2 = np.arange(256) == 0xC2
_MAYBE3 = np.isin(np.arange(256), [0xE1, 0xE2, 0xE3])


def cut_points(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted positions at which pieces start, those of the texts included."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    pad = np.concatenate([np.zeros(3, np.uint8), text, np.zeros(1, np.uint8)])
    before, after = pad[2 : n + 2], pad[4 : n + 4]
    gap = np.flatnonzero((text == 32) | (text == 10))
    ok = _PLAIN[before[gap]] & _PLAIN[after[gap]] & ~_MAYBE2[pad[gap + 1]] & ~_MAYBE3[pad[gap]] & ~_MAYBE2[after[gap]] & ~_MAYBE3[after[gap]]
    gap = gap[ok]
    feeds = gap[text[gap] == 10] + 1
    cuts = np.zeros(n, bool)
    cuts[1:] = _LETTER[text[:-1]] & _MARK[text[1:]]
    cuts[gap] = True
    cuts[feeds[feeds < n]] = True
    # a text's first and last byte have no neighbour in another text
    edges = np.unique(offsets[(offsets > 0) & (offsets < n)])
    for at in (edges, edges - 1, edges + 1):
        at = at[(at > 0) & (at < n)]
        cuts[at] &= _LETTER[text[at - 1]] & _MARK[text[at]]
    cuts[edges] = True
    cuts[0] = True
    return np.flatnonzero(cuts)


def spans_of(words: list[bytes], text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(start, end) of the leftmost longest matches of ``words`` in each text."""
    raw = text.tobytes()
    if not any(w in raw for w in words):
        return np.zeros((0, 2), np.int64)
    find = re.compile(b"|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))).finditer
    at = offsets.tolist()
    return np.array([m.span() for a, b in zip(at[:-1], at[1:], strict=True) for m in find(raw, a, b)], np.int64).reshape(-1, 2)


class PieceTable:
    """``encode`` gets distinct pieces (str) and returns the ids of each as int32 bytes.  Where
    a text holds one of ``words``, that is a piece, and what stands beside it is cut like a text."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], words: Sequence[str] = ()):
        self.encode = encode
        self.words = [w.encode() for w in words]
        self._clear()

    def _clear(self) -> None:
        self.slot = np.full(SLOTS, -1, np.int32)
        self.key = np.zeros(SLOTS // 2 + CHUNK, U64)
        self.head = np.zeros(SLOTS // 2 + CHUNK, U64)
        self.size = np.zeros(SLOTS // 2 + CHUNK, np.int32)
        self.place = np.zeros(SLOTS // 2 + CHUNK, np.int32)
        self.begin = np.zeros(SLOTS // 2 + CHUNK, np.int32)
        self.count = np.zeros(SLOTS // 2 + CHUNK, np.int32)
        self.ids = np.zeros(1 << 20, np.int32)
        self.raw = np.zeros(1 << 20, np.uint8)
        self.n = self.used = self.kept = 0

    def _same(self, e: np.ndarray, eight: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the pieces at ``start`` are the bytes of entries ``e`` of equal size and first
        eight bytes: the rest is compared eight bytes at a time, the last eight overlapping."""
        out = np.ones(len(e), bool)
        long = np.flatnonzero(size > 8)
        if len(long):
            n = (size[long] - 1) // 8
            of = np.repeat(np.arange(len(long)), n)
            step = 8 * (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + 1)
            step = np.minimum(step, size[long][of] - 8)
            held = np.ndarray(len(self.raw) - 7, "<u8", self.raw, strides=(1,))
            out[long[of[eight[start[long][of] + step] != held[self.place[e[long]][of] + step]]]] = False
        return out

    def _find(self, key: np.ndarray, eight: np.ndarray, start: np.ndarray, size: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Entry of each piece or -1; entries are compared byte by byte, so equal hashes of
        different pieces only cost another probe."""
        out = np.full(len(key), -1, np.int32)
        left, at = np.arange(len(key)), (key & U64(SLOTS - 1)).astype(np.int64)
        while len(left):
            e = self.slot[at]
            hit = np.flatnonzero((self.key[e] == key[left]) & (self.head[e] == head[left]) & (self.size[e] == size[left]) & (e >= 0))
            same = self._same(e[hit], eight, start[left[hit]], size[left[hit]])
            hit = hit[same]
            out[left[hit]] = e[hit]
            go = e >= 0
            go[hit] = False
            left, at = left[go], (at[go] + 1) & (SLOTS - 1)
        return out

    def _full(self, pieces: int, size: int) -> bool:
        return self.n > 0 and (self.n + pieces > SLOTS // 2 or self.kept + size > RAW_BYTES)

    def _insert(self, key: np.ndarray, head: np.ndarray, pieces: list[bytes], codes: list[bytes]) -> None:
        new = np.arange(self.n, self.n + len(key), dtype=np.int32)
        size = np.array([len(p) for p in pieces], np.int32)
        self.key[new], self.head[new], self.size[new] = key, head, size
        long = np.flatnonzero(size > 8)  # the head holds a shorter one
        flat = np.frombuffer(b"".join(pieces[i] for i in long.tolist()), np.uint8)
        if self.kept + len(flat) > len(self.raw):
            self.raw = np.concatenate([self.raw[: self.kept], np.zeros(max(len(flat), self.kept), np.uint8)])
        self.raw[self.kept : self.kept + len(flat)] = flat
        self.place[new[long]] = self.kept + np.cumsum(size[long]) - size[long]
        self.kept += len(flat)
        count = np.array([len(c) // 4 for c in codes], np.int32)
        flat = np.frombuffer(b"".join(codes), np.int32)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(flat), self.used), np.int32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.begin[new], self.count[new] = self.used + np.cumsum(count) - count, count
        self.used += len(flat)
        self.n += len(key)
        left, at = new, (key & U64(SLOTS - 1)).astype(np.int64)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]  # of several that want a slot one gets it
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & (SLOTS - 1)

    def _chunk(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces in order, how many each has)."""
        key, eight, size = V.span_hashes(text, start, end), V.words_at(text), (end - start).astype(np.int32)
        head = eight[start] & (~U64(0) >> (U64(64) - np.minimum(size, 8).astype(U64) * U64(8)))
        found, raw = self._find(key, eight, start, size, head), text.tobytes()
        while len(miss := np.flatnonzero(found < 0)):
            # one piece for each hash; different pieces of one hash are learnt in later rounds
            _, first = np.unique(key[miss], return_index=True)
            first = miss[first]
            pieces = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            if self._full(len(first), int(size[first].sum())):
                self._clear()  # and learn what it knew of this chunk again
                found[:] = -1
                continue
            self._insert(key[first], head[first], pieces, self.encode([p.decode("utf-8", "replace") for p in pieces]))
            found[miss] = self._find(key[miss], eight, start[miss], size[miss], head[miss])
        count = self.count[found]
        place = np.repeat(self.begin[found] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return self.ids[place], count

    def codes(self, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's ids)."""
        spans = spans_of(self.words, text, offsets) if self.words else ()
        if len(spans):
            start = cut_points(text, np.union1d(offsets, spans))
            nth = np.searchsorted(spans[:, 0], start) - 1  # the last match that starts before
            start = start[(nth < 0) | (start >= spans[nth, 1])]
        else:
            start = cut_points(text, offsets)
        end = np.append(start[1:], len(text))
        ids, counts, at = [], [], 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(start, start[at] + CHUNK)))
            lo, hi = start[at], end[to - 1]
            got, n = self._chunk(text[lo:hi], start[at:to] - lo, end[at:to] - lo)
            ids.append(got)
            counts.append(n)
            at = to
        if not ids:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        total = np.concatenate([[0], np.cumsum(np.concatenate(counts), dtype=np.int64)])
        return np.concatenate(ids), total[np.searchsorted(start, offsets)]

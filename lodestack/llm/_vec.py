"""Vectorised text primitives shared by the operators of this subpackage.

Everything here works on the UTF-8 buffer of an Arrow string column, many
documents at once, so no Python code runs per word or per byte.  Hashes are
64-bit; they route, filter and sketch.  Where a contract asks for equality the
callers compare the text itself.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are expanded into 8-byte arrays at a time.
SLICE_BYTES = 1 << 19

U64 = np.uint64
#: Longer spans are hashed one by one.
LONG_SPAN = 512


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xC2B2AE3D27D4EB4F)
    h ^= h >> U64(32)
    return h


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1 entries) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    text = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return text[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Text after which a worker gives freed memory back.
TRIM_BYTES = 8 << 20
_handled = 0


def trim() -> None:
    """Give memory that was freed back to the system, as workers live on from task to task."""
    with contextlib.suppress(OSError, AttributeError):
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts take up to ``limit`` bytes together (one row at least)."""
    global _handled
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to
    _handled += int(offsets[-1])
    if _handled > TRIM_BYTES:
        trim()
        _handled = 0


def word_spans(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the words ``[^\\x20\\x09-\\x0D]+``: byte positions, and for
    each document the index of its first word (n + 1 entries).  Words end with their document."""
    if not len(text):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~((text == 32) | ((text >= 9) & (text <= 13)))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    inner = offsets[:-1][offsets[:-1] < len(text)]
    begins[inner] = inside[inner]
    ends = np.zeros(len(text) + 1, bool)
    ends[1:-1] = inside[:-1] & ~inside[1:]
    ends[-1] = inside[-1]
    cut = inner[inner > 0]
    ends[cut] |= inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return start, end, np.searchsorted(start, offsets)


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one little-endian number; zeros follow the text."""
    pad = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray(len(text) + 1, "<u8", pad, strides=(1,))


def span_hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes hash equally wherever they stand.
    Eight bytes at a time are mixed in, so spans of one length up to eight bytes never
    collide; spans over LONG_SPAN bytes get a BLAKE2 digest."""
    size = end - start
    if not len(start):
        return np.zeros(0, U64)
    eight = words_at(text)
    h = mix(size.astype(U64) * U64(0x2545F4914F6CDD1D) + U64(0x9E3779B97F4A7C15))
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    at, left = start[live], size[live]
    while len(live):
        word = eight[at]
        part = left < 8
        if part.any():
            word[part] &= ~U64(0) >> (U64(64) - left[part].astype(U64) * U64(8))
        h[live] = mix((h[live] ^ word) * U64(0x9FB21C651E98DF25))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(text[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def gram_hashes(symbols: np.ndarray, m: int) -> np.ndarray:
    """Hash of each run of ``m`` symbols (len - m + 1 entries, none if shorter)."""
    n = len(symbols) - m + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.zeros(n, U64)
    for j in range(m):
        h *= U64(0x9FB21C651E98DF25)
        h += symbols[j : j + n]
    return mix(h)


def byte_gram_hashes(text: np.ndarray, m: int) -> np.ndarray:
    """As :func:`gram_hashes` for bytes; ``m`` is a multiple of 8."""
    n = len(text) - m + 1
    if n <= 0:
        return np.zeros(0, U64)
    text = np.ascontiguousarray(text)
    h = np.zeros(n, U64)
    for j in range(0, m, 8):
        h ^= h >> U64(31)
        h *= U64(0x9FB21C651E98DF25)
        h += np.ndarray(n, "<u8", text, offset=j, strides=(1,))
    return mix(h)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive entries, in log(w) passes."""
    if len(h) < w:
        return h[:0]
    width = 1
    while 2 * width <= w:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (w - width)], h[w - width :]) if width < w else h


def shingle_rows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each run of ``size`` words within a document.  A document of
    fewer words, but not none, has one shingle of all its words."""
    n = np.diff(first)
    doc_of = np.repeat(np.arange(len(n)), n)
    grams = gram_hashes(hashes, size)
    at = np.arange(len(grams))
    ok = at + size <= first[doc_of[: len(grams)] + 1] if len(grams) else np.zeros(0, bool)
    out, docs = grams[ok], doc_of[: len(grams)][ok]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        tail = np.zeros(len(short), U64)
        for j in range(size):
            has = j < n[short]
            tail = np.where(has, tail * U64(0x9FB21C651E98DF25) + hashes[np.minimum(first[short] + j, len(hashes) - 1)], tail)
        out = np.concatenate([out, mix(tail + n[short].astype(U64))])
        docs = np.concatenate([docs, short])
    return out, docs


def superkmers(grams: np.ndarray, k: int, m: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive k-windows of one document that share their minimiser, the least
    hash among a window's m-grams: (minimiser, document, first window, windows).  Windows are
    numbered by their first symbol in the concatenated documents, whose bounds ``first`` has."""
    low = sliding_min(grams, k - m + 1)
    n = np.diff(first)
    windows = np.maximum(n - k + 1, 0)
    has = np.flatnonzero(windows)
    if not len(has):
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z, z
    fresh = np.zeros(len(low) + 1, bool)
    fresh[1:-1] = low[1:] != low[:-1]
    fresh[first[has]] = True
    fresh[first[has] + windows[has]] = True  # what follows a document's last window belongs to no window
    starts = np.flatnonzero(fresh)
    doc = np.searchsorted(first, starts, "right") - 1
    doc = np.minimum(doc, len(n) - 1)
    ok = starts < first[doc] + windows[doc]
    length = np.diff(np.append(starts, len(low)))[: len(starts)]
    starts, doc, length = starts[ok], doc[ok], length[ok]
    return low[starts], doc, starts, length

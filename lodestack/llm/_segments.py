"""Repeated k-windows across documents, found by super-k-mers.

Two operators look for windows of ``k`` symbols (bytes or words) that also start in a
document with a smaller doc_id.  Both route windows the same way and differ in how a
bucket is solved:

1. *Census.*  Every window has a minimiser, the least hash among its m-grams; equal windows
   have equal minimisers.  Each map task reports its distinct minimisers, a bucket learns
   which of them two documents share, and returns a fixed-size block of a Bloom filter.  A
   window whose minimiser one document alone has is in no other document, so it needs no
   further work.  The filter's size is capped; a saturated filter prunes less and changes
   no result.
2. *Routing.*  Consecutive windows of one document with the same minimiser travel as one
   packed string.  Within a map task equal strings are merged: only the document with the
   least id still has to ask, for all others a smaller document with the string is known.  So
   a string sends a bucket at most one document for each map task, however many have it.
   Buckets of one reduce task travel in one row, gathered from more text the more tasks there
   are.  A minimiser found in very many tasks is routed by whole windows instead, which
   spreads the strings around a passage that a large part of the corpus quotes.  Strings are
   routed in rounds, each for a range of the tasks, and a round's shuffle goes when its spans
   are stored: what is on disk at a time is bounded by ROUND_SHARE of the text, however many
   windows repeat.
3. *Solving.*  A bucket gets its distinct strings with their least doc_id, and a solver says
   for each window the least document that has it.  Windows whose least document is smaller
   than their own are removed.

Nothing is sampled or capped: Bloom filter and merges only save work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _vec as V
from ._common import LAST_ID, drop, id_key, ship, shuffle_partitions, staged, text_of

U64 = np.uint64
#: Longest run of windows in one packed string.
MAX_RUN = 60
#: A map task hands over what it has gathered when it reaches so many bytes: a row for each
#: reduce task then holds about ROW_BYTES, so rows grow with the text and not with its square.
FLUSH_BYTES, MAX_FLUSH_BYTES, ROW_BYTES = 8 << 20, 64 << 20, 4 << 10
#: Bytes that a round of routing shuffles, about: a share of the text, or so many at least; and
#: bytes that a string takes there, with what is said of it.
ROUND_SHARE, ROUND_BYTES, STRING_BYTES = 0.4, 128 << 20, {"bytes": 48, "words": 192}
#: Bytes that a string has, about.
RAW_BYTES = {"bytes": 64, "words": 448}
#: Bloom filter: bits at least, and at most (32 MB on each worker).
MIN_BITS, MAX_BITS = 1 << 16, 1 << 28
#: Text bytes that feed one bucket, roughly, and buckets of one reduce task.
BUCKET_BYTES, TASK_BUCKETS = 2 << 20, 4
#: A minimiser that so many map tasks report is routed by whole windows, if its strings take so
#: many bytes, or as many as a bucket's text: a window then travels alone and not with 17 others.
HOT_TASKS, HOT_BYTES = 64, 1 << 20

#: Stands before a text's first byte; UTF-8 doesn't have it.
NO_BYTE = 255

KEY, TAG, SPANS = "__ls_key", "__ls_tag", "__ls_spans"


@dataclass(frozen=True)
class Plan:
    """kind: bytes or words; k, m: symbols of a window and of the m-grams it is routed by."""

    kind: str
    k: int
    m: int
    buckets: int
    tasks: int
    bits: int
    hot_tasks: int = HOT_TASKS
    #: bytes of context behind a window that travel with it, and one before; all occurrences do
    reach: int | None = None
    #: strings that a hot minimiser has at least
    hot_strings: int = 0
    #: bytes of text, and rounds of routing (0: by what the census finds)
    total: int = 0
    rounds: int = 0

    @property
    def block(self) -> int:
        return self.bits // self.buckets

    @property
    def subs(self) -> int:
        """Buckets of a reduce task: those whose numbers share its leading bits."""
        return self.buckets // self.tasks

    @property
    def flush(self) -> int:
        return min(MAX_FLUSH_BYTES, max(FLUSH_BYTES, self.tasks // max(1, self.rounds) * ROW_BYTES))

    def in_rounds(self, strings: int) -> Plan:
        """With rounds for so many routed strings, and as many more tasks as buckets allow, so that
        a round has enough of them."""
        size = STRING_BYTES[self.kind] + (self.reach or 0) // 2
        rounds = self.rounds or max(1, round(strings * size / max(ROUND_BYTES, ROUND_SHARE * self.total)))
        rounds = min(rounds, self.buckets)
        return replace(self, rounds=rounds, tasks=min(self.buckets, self.tasks << (rounds - 1).bit_length()))

    def turn(self, nth: int) -> tuple[int, int]:
        """The tasks of a round: from, to."""
        rounds = max(1, self.rounds)
        return nth * self.tasks // rounds, (nth + 1) * self.tasks // rounds


def plan_for(df: DataFrame, kind: str, k: int, m: int, **override: int) -> Plan:
    """Sizes buckets and filter by the bytes of text, one aggregate over the column."""
    total = df.agg(F.sum(F.octet_length(F.col("text"))).alias("n")).first()["n"] or 0
    pow2 = lambda n: 1 << max(0, int(n) - 1).bit_length()
    tasks = override.get("tasks") or min(1 << 18, max(pow2(shuffle_partitions(df.sparkSession)), pow2(total // (BUCKET_BYTES * TASK_BUCKETS))))
    buckets = override.get("buckets") or min(1 << 20, max(tasks, pow2(total // BUCKET_BYTES)))
    tasks = min(tasks, buckets)
    per_bit = 8 if kind == "bytes" else 64
    bits = override.get("bits") or min(MAX_BITS, max(MIN_BITS, pow2(total // per_bit)))
    hot_strings = 0 if "hot_tasks" in override else min(HOT_BYTES, total // buckets) // RAW_BYTES[kind]
    return Plan(kind, k, m, buckets, tasks, max(bits, 64 * buckets), override.get("hot_tasks", HOT_TASKS), override.get("reach"), hot_strings, total, override.get("rounds", 0))


class Symbols:
    """The symbols of a slice of documents: bytes as they are, or words joined by one space."""

    def __init__(self, plan: Plan, text: np.ndarray, offsets: np.ndarray):
        if plan.kind == "bytes":
            self.text, self.first = np.ascontiguousarray(text), offsets
            self.grams = V.byte_gram_hashes(self.text, plan.m)
        else:
            start, end, self.first = V.word_spans(text, offsets)
            self.grams = V.gram_hashes(V.span_hashes(text, start, end), plan.m)
            keep = np.zeros(len(text) + 1, np.int8)
            np.add.at(keep, start, 1)
            np.add.at(keep, end, -1)
            inside = np.cumsum(keep[:-1], dtype=np.int8) > 0
            gaps = end[end < len(text)]
            gaps = gaps[~inside[gaps]]
            inside[gaps] = True
            at = np.concatenate([[0], np.cumsum(inside)])
            self.text = text[inside].copy()
            self.text[at[gaps]] = 32
            self.start, self.end = at[start], at[end]

    def spans(self, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte range in ``text`` of ``count`` symbols from ``start``."""
        if hasattr(self, "start"):
            return self.start[start], self.end[start + count - 1]
        return start, start + count


def _runs(plan: Plan, sym: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    mini, doc, start, length = V.superkmers(sym.grams, plan.k, plan.m, sym.first)
    return V.mix(mini + U64(0x632BE59BD9B4E019)), doc, start, length  # minima crowd at zero, so mix again


def _bucket_of(plan: Plan, key: np.ndarray) -> np.ndarray:
    return (key >> U64(64 - plan.buckets.bit_length() + 1)).astype(np.int64) if plan.buckets > 1 else np.zeros(len(key), np.int64)


def _probes(low: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    low = low.astype(U64)
    return (low % U64(size)).astype(np.int64), (V.mix(low + U64(77)) % U64(size)).astype(np.int64)


def _fill(low: np.ndarray, size: int) -> bytes:
    bits = np.zeros(size, bool)
    for p in _probes(low, size):
        bits[p] = True
    return np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """Blocked Bloom filter over minimisers: which are shared, which are hot."""

    def __init__(self, plan: Plan, rows: list[tuple[int, bytes, bytes]]):
        self.plan, self.hot_block = plan, max(64, plan.block // 8)
        self.any_hot = False
        self.shared = np.zeros((plan.buckets, plan.block // 8), np.uint8)
        self.hot = np.zeros((plan.buckets, self.hot_block // 8), np.uint8)
        for b, shared, hot in rows:
            self.shared[b] = np.frombuffer(shared, np.uint8)
            if hot:
                self.any_hot = True
                self.hot[b] = np.frombuffer(hot, np.uint8)

    def _has(self, table: np.ndarray, size: int, key: np.ndarray) -> np.ndarray:
        flat, base = table.reshape(-1), _bucket_of(self.plan, key) * (size // 8)
        ok = np.ones(len(key), bool)
        for p in _probes(key & U64(0xFFFFFFFF), size):
            ok &= (flat[base + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 > 0
        return ok

    def is_shared(self, key: np.ndarray) -> np.ndarray:
        return self._has(self.shared, self.plan.block, key)

    def is_hot(self, key: np.ndarray) -> np.ndarray:
        return self._has(self.hot, self.hot_block, key) if self.any_hot else np.zeros(len(key), bool)


def _by_task(plan: Plan, key: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(task, range of each of its buckets) for the tasks that ascending keys fall into."""
    bucket = _bucket_of(plan, key)
    task = bucket // plan.subs
    first = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=True):
        t = int(task[a])
        cut = a + np.searchsorted(bucket[a:b], np.arange(t * plan.subs, (t + 1) * plan.subs + 1))
        yield t, list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))


def _census(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def hand_over(parts: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(parts), return_counts=True)
        parts.clear()
        low, rows = (key & U64(0xFFFFFFFF)).astype(np.uint32), []
        many = np.minimum(n, 0xFFFF).astype(np.uint16)
        for t, ranges in _by_task(plan, key):
            found = [(low[a:b], n[a:b] > 1) for a, b in ranges]
            rows.append((t, [x[~m].tobytes() for x, m in found], [x[m].tobytes() for x, m in found], [many[a:b][m].tobytes() for (a, b), (_, m) in zip(ranges, found, strict=True)]))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), _BLOBS, _BLOBS, _BLOBS), strict=True)], ["task", "once", "more", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for rb in batches:
            text, off = V.buffers(rb.column("text"))
            for a, b in V.slices(off):
                sym = Symbols(plan, text[off[a] : off[b]], off[a : b + 1] - off[a])
                key, doc, _, _ = _runs(plan, sym)
                if not len(key):
                    continue
                order = np.lexsort((key, doc))  # a document counts a minimiser once
                key, doc = key[order], doc[order]
                fresh = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))
                parts.append(key[fresh])
                held += 8 * len(parts[-1])
                if held > plan.flush:
                    yield hand_over(parts)
                    held = 0
        if parts:
            yield hand_over(parts)
        V.trim()

    return run


def _task_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of a partition sorted by task, one task at a time."""
    now, rows = None, []
    for rb in batches:
        for row in rb.to_pylist():
            if row["task"] != now and rows:
                yield now, rows
                rows = []
            now = row["task"]
            rows.append(row)
    if rows:
        yield now, rows


def _tally(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, rows in _task_rows(batches):
            for sub in range(plan.subs):
                once, more = ([np.frombuffer(r[c][sub], np.uint32) for r in rows] for c in ("once", "more"))
                many = [np.ones(sum(map(len, once)), np.int64), *(np.frombuffer(r["many"][sub], np.uint16) for r in rows)]
                low, at, tasks = np.unique(np.concatenate(once + more), return_inverse=True, return_counts=True)
                n = np.bincount(at, np.concatenate(many), len(low))  # strings of a minimiser
                shared = n > 1
                hot = low[(tasks >= plan.hot_tasks) & (n >= plan.hot_strings)]
                if shared.any():
                    row = {"bucket": t * plan.subs + sub, "shared": _fill(low[shared], plan.block), "hot": _fill(hot, max(64, plan.block // 8)) if len(hot) else b"", "strings": int(n[shared].sum())}
                    yield pa.RecordBatch.from_pylist([row], pa.schema([("bucket", pa.int32()), ("shared", pa.binary()), ("hot", pa.binary()), ("strings", pa.int64())]))

    return run


class _Pack:
    """What a map task has gathered: strings, and who has them."""

    def __init__(self) -> None:
        self.cols: list[tuple[np.ndarray, ...]] = []
        self.text: list[np.ndarray] = []
        self.size = 0

    def add(self, text: np.ndarray, bs: np.ndarray, be: np.ndarray, *cols: np.ndarray) -> None:
        length = be - bs
        at = np.concatenate([[0], np.cumsum(length)])
        index = np.arange(at[-1]) + np.repeat(bs - at[:-1], length)
        self.text.append(text[index])
        self.cols.append((length, V.span_hashes(text, bs, be), *cols))
        self.size += int(at[-1]) + 40 * len(bs)


def _coalesce(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals by document number."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    reach = np.maximum.accumulate((doc << 32) + end)
    fresh = np.append(True, ((doc << 32) + start)[1:] > reach[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last] - (doc[first] << 32)


def _deltas(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def _planes(v: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on."""
    return np.ascontiguousarray(v.view(np.uint8).reshape(len(v), -1).T).tobytes()


def _from_planes(raw: bytes, dtype: type, count: int, at: int) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, count * width, at).reshape(width, count).T).view(dtype).reshape(count)


_BLOBS = pa.list_(pa.binary())
_SPANS = "doc long, tag long, start long, end long"
_ROUTED = "task int, blobs array<binary>, " + _SPANS


def _span_batch(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (doc, tag, start, end)], ["doc", "tag", "start", "end"])


def _route(plan: Plan, shared: Any, nth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    lo, hi = plan.turn(nth)

    def now(key: np.ndarray) -> np.ndarray:
        bucket = _bucket_of(plan, key)
        return (bucket >= lo * plan.subs) & (bucket < hi * plan.subs)

    def hand_over(pack: _Pack) -> Iterator[pa.RecordBatch]:
        length, digest, key, doc, tag, start, runs = (np.concatenate(c) for c in zip(*pack.cols, strict=True))
        text = np.concatenate(pack.text)
        pack.text.clear()
        end = np.cumsum(length)
        begin = end - length
        order = np.lexsort((doc, digest, key))
        raw = memoryview(text)
        k, d = key[order], digest[order]
        same = np.append(False, (k[1:] == k[:-1]) & (d[1:] == d[:-1]))
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        b_, e_ = begin.tolist(), end.tolist()
        o_ = order.tolist()
        for i in np.flatnonzero(same).tolist():  # equal hashes: compare the strings themselves
            x, y = o_[i], o_[lead[i]]
            if raw[b_[x] : e_[x]] != raw[b_[y] : e_[y]]:
                same[i], lead[i] = False, i
        # least id of its string in this task
        asks = doc[order] == doc[order[lead]] if plan.reach is None else np.ones(len(order), bool)
        done = order[~asks]
        if len(done):
            rows, at = np.unique(np.stack([doc[done], tag[done]], 1), axis=0, return_inverse=True)
            n, s, e = _coalesce(at.reshape(-1).astype(np.int64), start[done], start[done] + runs[done] + plan.k - 1)
            spans = _span_batch(rows[n, 0], rows[n, 1], s, e)
            # settled: any task can pass them on; by a hash, as ids may ascend in steps or repeat
            name = V.mix(rows[n, 0].astype(U64) + rows[n, 1].astype(U64))
            to = pa.array((name % U64(hi - lo)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([to, pa.nulls(len(n), _BLOBS), *spans.columns], ["task", "blobs", *spans.schema.names])
        order, lead = order[asks], lead[asks]
        zip_ = zstandard.ZstdCompressor(level=3)
        lead_bits = U64(plan.buckets.bit_length() - 1)

        def blob(a: int, b: int) -> bytes | None:
            rows, of = order[a:b], lead[a:b]
            if not len(rows):
                return None
            head = np.append(True, of[1:] != of[:-1])
            firsts = rows[head]
            sel = length[firsts]
            at = np.concatenate([[0], np.cumsum(sel)])
            body = text[np.arange(at[-1]) + np.repeat(begin[firsts] - at[:-1], sel)]
            # what follows the bucket's bits in a key: it only brings strings together that may share a window
            short = ((key[firsts] << lead_bits) >> U64(32)).astype(np.uint32)
            fields = [_deltas(short), runs[firsts].astype(np.int32), (sel - runs[firsts]).astype(np.int32), _deltas((np.cumsum(head) - 1).astype(np.int32)), doc[rows], tag[rows], start[rows].astype(np.int32)]
            # numbers by planes of bytes and text by itself, as each packs worse with another kind
            packed = zip_.compress(b"".join(map(_planes, fields)))
            return np.array([len(firsts), len(rows), len(packed)], np.int64).tobytes() + packed + zip_.compress(body.tobytes())

        if len(order):
            tasks, blobs = zip(*((t - lo, [blob(a, b) for a, b in ranges]) for t, ranges in _by_task(plan, key[order])), strict=True)  # order ascends by key
            none = pa.nulls(len(tasks), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(tasks, pa.int32()), pa.array(blobs, _BLOBS), none, none, none, none], ["task", "blobs", "doc", "tag", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pack = shared.value, _Pack()
        for rb in batches:
            text, off = V.buffers(rb.column("text"))
            ids, tags = rb.column(KEY).to_numpy(zero_copy_only=False), rb.column(TAG).to_numpy(zero_copy_only=False)
            for a, b in V.slices(off):
                sym = Symbols(plan, text[off[a] : off[b]], off[a : b + 1] - off[a])
                key, doc, start, length = _runs(plan, sym)
                hot = known.is_hot(key) if plan.reach is None else np.zeros(len(key), bool)
                ok = now(key) | hot  # a hot one's windows have rounds of their own
                ok[ok] = known.is_shared(key[ok])
                key, doc, start, length, hot = key[ok], doc[ok], start[ok], length[ok], hot[ok]
                if not len(key):
                    continue
                step = np.where(hot, 1, MAX_RUN)
                pieces = -(-length // step)
                if (pieces > 1).any() or hot.any():
                    at = np.repeat(np.arange(len(key)), pieces)
                    nth = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    key, doc, hot = key[at], doc[at], hot[at]
                    start, length = start[at] + nth * step[at], np.minimum(step[at], length[at] - nth * step[at])
                bs, be = sym.spans(start, length + plan.k - 1)
                source = sym.text
                if plan.reach is not None:  # each text gets a byte in front that no text has
                    be = np.minimum(be + plan.reach, sym.first[doc + 1]) + doc + 1
                    bs = bs + doc
                    source = np.insert(source, sym.first[:-1], NO_BYTE)
                if hot.any():
                    key = np.where(hot, V.mix(V.span_hashes(sym.text, bs, be) + U64(5)), key)
                    ok = now(key)
                    bs, be, key, doc, start, length = bs[ok], be[ok], key[ok], doc[ok], start[ok], length[ok]
                    if not len(key):
                        continue
                pack.add(source, bs, be, key, ids[a + doc], tags[a + doc], start - sym.first[doc], length)
                if pack.size > plan.flush:
                    yield from hand_over(pack)
                    pack = _Pack()
        if pack.cols:
            yield from hand_over(pack)
        V.trim()

    return run


def unpacked(blobs: list[bytes]) -> tuple:
    """The strings of a bucket in order of first sight, their keys and runs, and for each
    occurrence its string, document, tag and start."""
    unzip = zstandard.ZstdDecompressor()
    index: dict[bytes, int] = {}
    keys, runs, owner, docs, tags, starts = [], [], [], [], [], []
    for blob in blobs:
        n, m, size = np.frombuffer(blob, np.int64, 3).tolist()
        packed, raw = unzip.decompress(blob[24 : 24 + size]), unzip.decompress(blob[24 + size :])
        at, fields = 0, []
        for dtype, count in ((np.uint32, n), (np.int32, n), (np.int32, n), (np.int32, m), (np.int64, m), (np.int64, m), (np.int32, m)):
            fields.append(_from_planes(packed, dtype, count, at))
            at += count * np.dtype(dtype).itemsize
        step, run, over, next_, doc, tag, start = fields
        key, who = np.cumsum(step, dtype=np.uint32), np.cumsum(next_, dtype=np.int32)
        ends, at = np.cumsum(run + over).tolist(), 0
        place = np.empty(n, np.int64)
        for i, (e, kk, rr) in enumerate(zip(ends, key.tolist(), run.tolist(), strict=True)):
            s = raw[at:e]
            at = e
            j = index.setdefault(s, len(index))
            if j == len(keys):
                keys.append(kk)
                runs.append(rr)
            place[i] = j
        owner.append(place[who])
        docs.append(doc)
        tags.append(tag)
        starts.append(start)
    return index, keys, runs, owner, docs, tags, starts


Solver = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _solve(plan: Plan, solver: Solver) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def bucket(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        index, keys, runs, owner, docs, tags, starts = unpacked(blobs)
        if not keys:
            return
        owner, docs, tags, starts = (np.concatenate(x).astype(np.int64) for x in (owner, docs, tags, starts))
        key, run = np.array(keys, U64), np.array(runs, np.int64)
        least = np.full(len(keys), LAST_ID, np.int64)
        np.minimum.at(least, owner, docs)
        base = np.concatenate([[0], np.cumsum(run)])
        low = solver(list(index), key, run, least)
        for a in range(0, len(owner), 40_000):  # bounds what is expanded at a time
            o, d, t, s = owner[a : a + 40_000], docs[a : a + 40_000], tags[a : a + 40_000], starts[a : a + 40_000]
            n = run[o]
            row = np.repeat(np.arange(len(o)), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            gone = low[base[o][row] + nth] < d[row]
            row, nth = row[gone], nth[gone]
            if not len(row):
                continue
            fresh = np.append(True, (row[1:] != row[:-1]) | (nth[1:] != nth[:-1] + 1))
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(row)) - 1
            yield _span_batch(d[row[first]], t[row[first]], s[row[first]] + nth[first], s[row[first]] + nth[last] + plan.k)

    return _each_bucket(bucket)


def _each_bucket(bucket: Callable[[list[bytes]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs ``bucket`` on each bucket of the routed rows; spans that are settled pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def solved() -> Iterator[pa.RecordBatch]:
            for sub in range(len(held[0]) if held else 0):
                blobs = [x for x in (row[sub].as_py() for row in held) if x is not None]
                if blobs:
                    yield from bucket(blobs)

        for rb in batches:
            known = rb.column("blobs").is_null()
            if known.true_count:
                yield rb.filter(known).select(["doc", "tag", "start", "end"])
            if known.true_count == len(rb):
                continue
            rb = rb.filter(pc.invert(known))
            for t, row in zip(rb.column("task").to_pylist(), rb.column("blobs"), strict=True):
                if t != now:
                    yield from solved()
                    now, held = t, []
                held.append(row)
        yield from solved()
        V.trim()

    return run


def with_keys(df: DataFrame, tagged: bool = True) -> DataFrame:
    """The rows with a sortable id and a tag of the text, which together name a row: rows that
    repeat a doc_id with another text keep apart.  Columns named ``__ls_*`` are reserved."""
    keep = [c for c in df.columns if not c.startswith("__ls_")]
    return df.select(*keep, id_key().alias(KEY), (F.xxhash64(text_of()) if tagged else F.lit(0).cast("long")).alias(TAG))


def with_short_keys(df: DataFrame) -> DataFrame:
    """As :func:`with_keys`; where no id comes twice the tags, which travel with every string and
    span, are all 0."""
    n = df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(id_key()).alias("ids")).first()
    return with_keys(df, n["rows"] > n["ids"])


def with_spans(keyed: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows with SPANS; ``text`` is compressed for the shuffle (see :func:`unzipped`)."""
    ship(keyed.sparkSession)
    return keyed.withColumn("text", F.arrow_udf(_zipped, "binary")(F.col("text"))).join(spans, [KEY, TAG], "left")


def _zipped(text: pa.Array) -> pa.Array:
    zip_ = zstandard.ZstdCompressor(level=3)
    raw = text.cast(pa.binary())  # bytes as they are, in UTF-8 or not
    return pa.array([None if x is None else zip_.compress(x) for x in raw.to_pylist()], pa.binary())


def unzipped(column: pa.Array) -> list[bytes | None]:
    unzip = zstandard.ZstdDecompressor()
    return [None if x is None else unzip.decompress(x) for x in column.to_pylist()]


def solved_by(df: DataFrame, plan: Plan, solve: Any, schema: str) -> DataFrame:
    """Census and routing of ``df``, and what ``solve`` makes of the reduce tasks' rows: it is
    stored, so that no shuffle of one round is there in the next, or when texts are joined."""
    spark = df.sparkSession
    ship(spark)
    slim = df.select(KEY, TAG, text_of().alias("text"))
    counted = slim.select("text").mapInArrow(_census(plan), "task int, once array<binary>, more array<binary>, many array<binary>")
    blocks = counted.repartitionById(max(shuffle_partitions(spark), plan.tasks), F.col("task")).sortWithinPartitions("task")
    blocks = staged(blocks.mapInArrow(_tally(plan), "bucket int, shared binary, hot binary, strings long"))
    # One block of fixed size for each bucket, MAX_BITS in all and as much again / 8 for hot ones.
    known = spark.sparkContext.broadcast(Filter(plan, [(r["bucket"], bytes(r["shared"]), bytes(r["hot"])) for r in blocks.drop("strings").toLocalIterator()]))
    plan = plan.in_rounds(blocks.agg(F.sum("strings")).first()[0] or 0)
    drop(blocks)

    def done(nth: int) -> DataFrame:
        lo, hi = plan.turn(nth)
        # A partition for each reduce task: hashed, up to seven of 4096 would share one and a third be idle.
        parts = max(shuffle_partitions(spark), hi - lo)
        return staged(routed(slim, plan, known, nth).repartitionById(parts, F.col("task")).sortWithinPartitions("task").mapInArrow(solve, schema))

    found = [done(nth) for nth in range(plan.rounds)]
    known.destroy()
    return reduce(DataFrame.union, found)


def all_occurrences(df: DataFrame, plan: Plan, solver: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``solver`` makes of each bucket's strings with ``plan.reach`` bytes of context and all
    their occurrences: it gets what :func:`unpacked` returns."""
    return solved_by(df, plan, _each_bucket(lambda blobs: solver(*unpacked(blobs))), schema)


def removable(df: DataFrame, plan: Plan, solver: Solver) -> DataFrame:
    """(key, tag, spans): for each document with windows that also start in a smaller document,
    the symbol ranges they cover, as ``start << 32 | end`` in no order, overlapping or not."""
    found = solved_by(df, plan, _solve(plan, solver), _SPANS)
    packed: Column = F.shiftleft(F.col("start"), 32).bitwiseOR(F.col("end"))
    # a set, so that rows repeated without end gather no more than one of them
    return found.groupBy(F.col("doc").alias(KEY), F.col("tag").alias(TAG)).agg(F.collect_set(packed).alias(SPANS))


def routed(slim: DataFrame, plan: Plan, known: Any, nth: int = 0) -> DataFrame:
    """Rows for the reduce tasks of a round, numbered from 0: the packed strings of a task's buckets
    that were gathered by a map task, or spans that are settled already."""
    return slim.mapInArrow(_route(plan, known, nth), _ROUTED)


def merged(packed: list[int] | np.ndarray | None) -> list[tuple[int, int]]:
    """Maximal runs of a document's spans."""
    out: list[tuple[int, int]] = []
    for x in sorted(packed if packed is not None else ()):
        s, e = x >> 32, x & 0xFFFFFFFF
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out

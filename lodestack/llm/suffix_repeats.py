"""Suffix-array dedup: maximal repeats from an enhanced suffix array's interval tree.

Texts are UTF-8 bytes.  Equal 50-byte windows meet in one bucket (see ``_segments``).  There
the bucket's strings get an enhanced suffix array (order by prefix doubling, common prefixes
by descent through the doubling's ranks), and a stack scan visits the tree of common-prefix
intervals.  An interval whose occurrences continue to the left in different ways, or start
their string, is a maximal repeat: it is reported with its length and all its occurrences.
Every repeated window lies in a maximal repeat with the same occurrences, so these decide
what may go.  For that decision strings end with their windows, and equal ones are one;
``repeat_groups`` follows repeats beyond them and returns the groups with all occurrences.

Edge cases: null and empty texts, and texts under ``k`` bytes, have no windows and stay as
they are; rows that share a doc_id never remove from each other; a null doc_id counts as the
largest; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _segments as S
from . import _vec as V
from ._common import LAST_ID, documents, text_of
from ._extend import extended

U64 = np.uint64
K, M = 50, 16
#: Bytes beyond a window that travel with it for repeat groups; longer ones are followed later.
REACH = 462
#: Bytes of strings under one suffix array.
ARRAY_BYTES = 1 << 18
#: left_of of a suffix that starts its string, and of an interval with several left symbols.
DIVERSE = 256


def _rank(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate([[1], 1 + np.cumsum(key[1:] != key[:-1])])
    return rank


class SuffixArray:
    """Suffixes of at least ``least`` bytes of several strings (each up to 112 bytes), sorted;
    ``lcp[i]`` is the common prefix of suffixes i - 1 and i, 0 at the start."""

    def __init__(self, text: np.ndarray, lengths: np.ndarray, least: int):
        end = np.repeat(np.cumsum(lengths), lengths)
        n = len(text)
        rem = end - np.arange(n)
        pad = np.concatenate([text, np.zeros(8, np.uint8)])
        word = np.zeros(n, U64)
        for j in range(7):
            word = (word << U64(8)) | np.where(rem > j, pad[j : j + n], 0).astype(U64)
        rank = {7: _rank((word << U64(3)) | np.minimum(rem, 7).astype(U64))}

        def after(h: int, at: np.ndarray, by: int) -> np.ndarray:
            return np.where(rem[at] > by, rank[h][np.minimum(at + by, n - 1)], 0)

        every = np.arange(n)
        for h in (7, 14):
            rank[2 * h] = _rank((rank[h].astype(U64) << U64(32)) | after(h, every, h).astype(U64))
        at = np.flatnonzero(rem >= least)
        high = (rank[28][at].astype(U64) << U64(32)) | after(28, at, 28).astype(U64)
        low = (after(28, at, 56).astype(U64) << U64(32)) | after(28, at, 84).astype(U64)
        self.at = at[np.lexsort((low, high))]
        a, b = self.at[:-1], self.at[1:]
        common, going = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        for h in (28, 28, 28, 28, 14, 7):
            x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
            same = (common < rem[a]) & (common < rem[b]) & (rank[h][x] == rank[h][y])
            common += np.where(same, h, 0)
        common = np.minimum(common, np.minimum(rem[a], rem[b]))
        for _ in range(6):
            going &= (common < rem[a]) & (common < rem[b])
            going &= text[np.minimum(a + common, n - 1)] == text[np.minimum(b + common, n - 1)]
            common += going
        self.lcp = np.concatenate([[0], common]).astype(np.int64)
        self.left = np.where((rem[np.maximum(self.at - 1, 0)] == 1) | (self.at == 0), DIVERSE, text[np.maximum(self.at - 1, 0)].astype(np.int64))


def maximal_repeats(lcp: list[int], left: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, lo, hi) for each interval of the suffix array, bounds included, whose suffixes
    share a prefix of ``length >= least`` that can't be extended to the right or left.

    A stack holds the open intervals of the tree, each with the left symbol that its suffixes
    share so far; a closed interval hands its symbol to the one around it."""
    stack: list[list[int]] = []  # [length, lo, left symbol]
    for i in range(1, len(lcp) + 1):
        depth = lcp[i] if i < len(lcp) else 0
        lo, sym = i - 1, left[i - 1]
        while stack and stack[-1][0] > depth:
            length, lo, own = stack.pop()
            sym = own if own == sym else DIVERSE
            if sym == DIVERSE:
                yield length, lo, i - 1
        if depth >= least:
            if stack and stack[-1][0] == depth:
                top = stack[-1]
                if top[2] != sym:
                    top[2] = DIVERSE
            else:
                stack.append([depth, lo, sym])
        elif stack:  # below the threshold nothing stays open
            stack.clear()


def ordered(text: np.ndarray, lengths: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes ``at`` of strings of any length, sorted by their first ``most`` bytes, and the
    common prefix of each with the one before it (0 at the start, ``most`` at the most)."""
    n = len(text)
    end = np.repeat(np.cumsum(lengths), lengths)
    rem = end - np.arange(n)
    pad = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.zeros(n, U64)
    for j in range(7):
        word = (word << U64(8)) | np.where(rem > j, pad[j : j + n], 0).astype(U64)
    h = 7
    rank = {h: _rank((word << U64(3)) | np.minimum(rem, 7).astype(U64))}
    every = np.arange(n)
    while 2 * h <= most:
        after = np.where(rem > h, rank[h][np.minimum(every + h, n - 1)], 0)
        rank[2 * h] = _rank((rank[h].astype(U64) << U64(32)) | after.astype(U64))
        h *= 2
    tail = np.where(rem[at] > most - h, rank[h][np.minimum(at + most - h, n - 1)], 0)  # overlaps the first h
    at = at[np.lexsort((tail, rank[h][at]))]
    a, b = at[:-1], at[1:]
    common = np.zeros(len(a), np.int64)
    for h in [h, *sorted(rank, reverse=True)]:
        x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        same = (common < rem[a]) & (common < rem[b]) & (rank[h][x] == rank[h][y])
        common += np.where(same, h, 0)
    common = np.minimum(common, np.minimum(rem[a], rem[b]))
    for _ in range(6):
        x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        common += (common < rem[a]) & (common < rem[b]) & (text[x] == text[y])
    return at, np.concatenate([[0], np.minimum(common, most)]).astype(np.int64)


GROUPS = "group long, length int, cut boolean, doc long, tag long, start long"


def _grouped(k: int, reach: int) -> Callable[..., Iterator[pa.RecordBatch]]:
    """Maximal repeat groups of a bucket's strings, each with a byte in front and ``reach`` bytes
    behind its windows: one row for each occurrence."""
    most = k + reach
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())

    def solve(index: dict[bytes, int], keys: list[int], runs: list[int], *refs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not keys:
            return
        owner, docs, tags, starts = (np.concatenate(x).astype(np.int64) for x in refs)
        order = np.argsort(owner, kind="stable")
        owner, docs, tags, starts = owner[order], docs[order], tags[order], starts[order]
        first = np.searchsorted(owner, np.arange(len(keys) + 1))  # occurrences of each string
        strings, key, run = list(index), np.array(keys, U64), np.array(runs, np.int64)
        size = np.array([len(x) for x in strings])
        by_key = np.argsort(key, kind="stable")
        held, at = np.cumsum(size[by_key]), 0
        while at < len(by_key):
            to = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + ARRAY_BYTES, "right")))
            to = int(np.searchsorted(key[by_key], key[by_key[to - 1]], "right"))  # to the minimiser's end
            ids, at = by_key[at:to], to
            text = np.frombuffer(b"".join(strings[i] for i in ids.tolist()), np.uint8)
            base = np.cumsum(size[ids]) - size[ids]
            n = run[ids]
            windows = np.repeat(base - (np.cumsum(n) - n), n) + np.arange(n.sum()) + 1
            suffix, lcp = ordered(text, size[ids], windows, most)
            of = np.searchsorted(base, suffix, "right") - 1
            offset = suffix - base[of] - 1
            left = text[suffix - 1].astype(np.int64)
            left[left == S.NO_BYTE] = DIVERSE
            room = np.minimum(base[of] + size[ids][of] - suffix, most)
            beside = np.maximum(lcp, np.append(lcp[1:], 0))
            own = first[ids[of] + 1] - first[ids[of]]
            # a string of several texts' starts is a repeat by itself where nothing is as long
            found = [(int(room[i]), i, i) for i in np.flatnonzero((own > 1) & (left == DIVERSE) & (room > beside) & (room >= k)).tolist()]
            for lo, hi in _stretches(lcp >= k):
                found += [(length, a + lo, b + lo) for length, a, b in maximal_repeats(lcp[lo:hi].tolist(), left[lo:hi].tolist(), k)]
            for length, lo, hi in found:
                rows = np.concatenate([np.arange(first[x], first[x + 1]) for x in ids[of[lo : hi + 1]].tolist()])
                if (docs[rows] == docs[rows[0]]).all():
                    continue  # within one document
                begin = starts[rows] + np.repeat(offset[lo : hi + 1], own[lo : hi + 1])
                name = hashlib.blake2b(text[suffix[lo] : suffix[lo] + length].tobytes(), digest_size=8).digest()
                same = [int.from_bytes(name, "little", signed=True)], [length], [length == most]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((*(x * len(rows) for x in same), docs[rows], tags[rows], begin), kinds, strict=True)], ["group", "length", "cut", "doc", "tag", "start"])

    return solve


def repeat_groups(docs: DataFrame, k: int = K, m: int = M, reach: int = REACH, **plan: int) -> DataFrame:
    """Maximal repeat groups of at least ``k`` bytes that several documents hold, with all their
    occurrences: a row (group, length, doc_id, tag, start) for each.  ``group`` is a hash of the
    repeated bytes, ``tag`` one of the whole text, as rows may repeat a doc_id, ``start`` the byte
    where the occurrence begins.  A repeat can't be extended to either side without losing an
    occurrence, however long it is: the buckets' arrays see ``k + reach`` bytes, and what is
    longer is followed from there (see ``_extend``)."""
    keyed = S.with_keys(docs)
    found = S.all_occurrences(keyed, S.plan_for(docs, "bytes", k, m, reach=reach, **plan), _grouped(k, reach), GROUPS)
    texts = keyed.select(F.col(S.KEY).alias("doc"), F.col(S.TAG).alias("tag"), F.encode(text_of(), "UTF-8").alias("text"))
    longer = extended(found.where("cut").drop("cut"), texts, maximal_repeats)
    every = found.where("not cut").select("group", F.col("length").cast("long").alias("length"), "doc", "tag", "start").union(longer)
    return every.select("group", "length", F.nullif("doc", F.lit(LAST_ID)).alias("doc_id"), "tag", "start")


def _array_low(strings: list[bytes], run: np.ndarray, least_doc: np.ndarray, k: int) -> np.ndarray:
    """For each window of each string the least document among its occurrences."""
    low = np.repeat(least_doc, run)
    text = np.frombuffer(b"".join(strings), np.uint8)
    lengths = run + k - 1
    sa = SuffixArray(text, lengths, k)
    starts = np.cumsum(lengths) - lengths
    of = np.searchsorted(starts, sa.at, "right") - 1
    window = np.cumsum(run)[of] - run[of] + sa.at - starts[of]
    docs = least_doc[of]
    near = sa.lcp >= k
    for lo_run, hi_run in _stretches(near):
        for length, lo, hi in maximal_repeats(sa.lcp[lo_run:hi_run].tolist(), sa.left[lo_run:hi_run].tolist(), k):
            lo, hi = lo + lo_run, hi + lo_run
            group = docs[lo : hi + 1]
            first = group.min()
            for i in np.flatnonzero(group > first):
                w = window[lo + i]
                part = low[w : w + length - k + 1]
                np.minimum(part, first, out=part)
    return low


def _stretches(near: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of the suffix array in which each neighbour is near, with the one before them."""
    edge = np.diff(np.concatenate([[False], near, [False]]).astype(np.int8))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        yield a - 1, b


def solve_bucket(strings: list[bytes], key: np.ndarray, run: np.ndarray, least: np.ndarray, k: int = K) -> np.ndarray:
    """Least document of every window of the bucket's strings, string after string.  Strings of
    different minimisers share no window, so whole minimisers are taken into arrays of about
    ARRAY_BYTES; a string alone with its minimiser is its own maximal repeat."""
    base = np.concatenate([[0], np.cumsum(run)])
    out = np.repeat(least, run)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    groups = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1]))
    size = np.diff(np.append(groups, len(order)))
    alone = np.repeat(size == 1, size)
    rest = order[~alone]
    if not len(rest):
        return out
    group_of = np.repeat(np.arange(len(groups)), size)[~alone]
    held = np.cumsum(run[rest] + k - 1)
    at = 0
    while at < len(rest):
        to = int(np.searchsorted(held, (held[at - 1] if at else 0) + ARRAY_BYTES, "right"))
        to = max(to, at + 1)
        to = int(np.searchsorted(group_of, group_of[to - 1], "right"))  # to the minimiser's end
        ids = rest[at:to]
        low = _array_low([strings[i] for i in ids.tolist()], run[ids], least[ids], k)
        n = run[ids]
        place = np.repeat(base[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[place] = low
        at = to
    return out


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in spans:
        out.append(text[at:s])
        at = e
    out.append(text[at:])
    return b"".join(out)


def repeated_bytes(docs: DataFrame, k: int = K, m: int = M, **plan: int) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...), texts compressed, with the byte ranges covered by
    k-byte windows that also start in a smaller doc_id (see ``_segments.removable``)."""
    keyed = S.with_short_keys(docs)
    return S.with_spans(keyed, S.removable(keyed, S.plan_for(docs, "bytes", k, m, **plan), solve_bucket))


def _finish(fields: list[str], schema: pa.Schema, make: object) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            spans = rb.column(S.SPANS)
            rows = [make(text or b"", S.merged(spans[i].values.to_numpy(zero_copy_only=False) if spans[i].is_valid else None)) for i, text in enumerate(S.unzipped(rb.column("text")))]
            new = dict(zip(fields, zip(*rows, strict=True), strict=True)) if rows else {f: () for f in fields}
            yield pa.RecordBatch.from_arrays([pa.array(list(new[f.name]), f.type) if f.name in new else rb.column(f.name) for f in schema], schema=schema)

    return run


def removal_report(docs: DataFrame, k: int = K, m: int = M, **plan: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""

    def make(text: bytes, spans: list[tuple[int, int]]) -> tuple:
        return len(text), sum(e - s for s, e in spans), len(spans), hashlib.sha256(_cut(text, spans)).hexdigest()

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in names[:3]), (names[3], pa.string())])
    rows = repeated_bytes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, m, **plan)
    return rows.select("doc_id", "text", S.SPANS).mapInArrow(_finish(names, schema, make), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, k: int = K, m: int = M, **plan: int) -> DataFrame:
    """``docs`` with what repeats an earlier document cut out of ``text`` (and ``n_chars`` of the
    new text, where that column exists).  Bytes of a character cut in two go with it; a row is
    kept even if nothing of its text stays."""
    fields = [c for c in docs.columns if not c.startswith("__ls_")]
    rows = repeated_bytes(docs, k, m, **plan).select(*fields, S.SPANS)
    cut = rows.withColumn("text", F.arrow_udf(_cut_column, "string")(F.col("text"), F.col(S.SPANS)))
    if "n_chars" in fields:
        cut = cut.withColumn("n_chars", F.when(F.col(S.SPANS).isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*fields)


def _cut_column(text: pa.Array, spans: pa.Array) -> pa.Array:
    def cut(t: bytes, s: pa.ListScalar) -> bytes:
        return _cut(t, S.merged(s.values.to_numpy(zero_copy_only=False))).decode("utf-8", "ignore").encode() if s.is_valid else t

    return pa.array([None if t is None else cut(t, s) for t, s in zip(S.unzipped(text), spans, strict=True)], pa.binary()).view(pa.string())


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(documents(spark, sf_dir))

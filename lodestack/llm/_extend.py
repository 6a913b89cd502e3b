"""Repeat groups that were cut at a length, followed to where their occurrences part.

A node is a set of occurrences that share ``depth`` bytes.  In each round the next block of
bytes of every occurrence is read; equal blocks of a node are merged before anything is
collected, and the distinct ones, with how many and whose they are, make a small tree of common
prefixes.  Its intervals that can't be extended to the left are groups; occurrences that share
the whole block are nodes of the next round, with a block twice as long.  A node's distinct
blocks hold ``NODE_BYTES`` at most: where they would be more, its block is shortened first, in
the end to one byte, of which there are 256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop, staged

#: Bytes of a first block, of any block, and of a node's distinct blocks.
FIRST, MOST, NODE_BYTES = 512, 1 << 20, 4 << 20
#: Left of an occurrence that starts its text, and of a set with several bytes on its left.
DIVERSE = 256

Intervals = Callable[[list[int], list[int], int], Iterator[tuple[int, int, int]]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences with the block behind what they share and the byte before it."""
    for rb in batches:
        blocks, left = [], []
        for text, start, depth, b in zip(rb.column("text"), *(rb.column(c).to_pylist() for c in ("start", "depth", "b")), strict=True):
            raw = text.as_buffer()
            blocks.append(raw[start + depth : start + depth + b].to_pybytes())
            left.append(memoryview(raw)[start - 1] if start else DIVERSE)
        yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in ("node", "depth", "b", "doc", "tag", "start")), pa.array(left, pa.int32()), pa.array(blocks, pa.binary())], ["node", "depth", "b", "doc", "tag", "start", "left", "block"])


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def _tree(intervals: Intervals) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each node's distinct blocks: the groups that its tree has, a row for each block of one,
    and the blocks that are nodes of the next round (length null)."""

    def solve(node: int, depth: int, b: int, rows: list[dict]) -> Iterator[tuple]:
        rows.sort(key=lambda r: r["block"])
        leaves: list[int] = []  # a block of several occurrences is two leaves, alike to its end
        left, lcp = [], []
        for i, r in enumerate(rows):
            two = r["n"] > 1
            lcp.append(1 + common(rows[i - 1]["block"], r["block"]) if i else 0)
            leaves.append(i)
            left.append(r["left0"])
            if two:
                lcp.append(1 + len(r["block"]))
                leaves.append(i)
                left.append(r["left1"] if r["left0"] != DIVERSE else DIVERSE)
        for length, lo, hi in intervals(lcp, left, 1):
            mine = rows[leaves[lo] : leaves[hi] + 1]
            if min(r["doc0"] for r in mine) == max(r["doc1"] for r in mine):
                continue  # within one document
            name = int.from_bytes(hashlib.blake2b(repr((node, depth, length, mine[0]["block"][: length - 1])).encode(), digest_size=8).digest(), "little", signed=True)
            for r in mine:
                yield node, r["block"], name, None if length - 1 == b else depth + length - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for r in rb.to_pylist():
                found = list(solve(r["node"], r["depth"], r["b"], r["rows"]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["node", "block", "name", "length"])

    return run


OCCURRENCES = "group long, length long, doc long, tag long, start long"


def extended(cut: DataFrame, texts: DataFrame, intervals: Intervals) -> DataFrame:
    """Groups (group, length, doc, tag, start) in place of those of ``cut`` (group, length, doc, tag,
    start), whose occurrences share ``length`` bytes and may share more.  ``texts`` (doc, tag,
    text) are binary; ``group`` hashes the repeated bytes."""
    texts = staged(texts.join(cut.select("doc", "tag").distinct(), ["doc", "tag"], "left_semi").dropDuplicates(["doc", "tag"]))
    nodes = staged(cut.select(F.col("group").alias("node"), F.col("length").cast("long").alias("depth"), F.lit(FIRST).alias("b"), "doc", "tag", "start"))
    groups: list[DataFrame] = []
    while not nodes.isEmpty():
        rows = staged(nodes.join(texts, ["doc", "tag"]).select("node", "depth", "b", "doc", "tag", "start", "text").mapInArrow(_blocks, "node long, depth long, b int, doc long, tag long, start long, left int, block binary"))
        kinds = rows.groupBy("node", "depth", "b", "block").agg(F.count("*").alias("n"), F.min("left").alias("left0"), F.max("left").alias("left1"), F.min("doc").alias("doc0"), F.max("doc").alias("doc1"))
        kinds = staged(kinds.withColumn("left0", F.when(F.col("left1") == DIVERSE, F.lit(DIVERSE)).otherwise(F.col("left0"))))
        wide = kinds.groupBy("node", "b").agg(F.count("*").alias("d")).where((F.col("b") > 1) & (F.col("d") * F.col("b") > NODE_BYTES))
        wide = staged(wide.select("node", F.greatest(F.lit(1), F.least(F.floor(F.col("b") / 4), F.floor(F.lit(NODE_BYTES) / F.col("d")))).cast("int").alias("less")))
        fit = kinds.join(wide, "node", "left_anti").groupBy("node", "depth", "b").agg(F.collect_list(F.struct("block", "n", "left0", "left1", "doc0", "doc1")).alias("rows"))
        found = staged(fit.mapInArrow(_tree(intervals), "node long, block binary, name long, length long"))
        groups.append(staged(rows.join(found.where("length is not null"), ["node", "block"]).select("name", "length", "doc", "tag", "start")))
        onward = rows.join(found.where("length is null"), ["node", "block"]).select(F.col("name").alias("node"), (F.col("depth") + F.col("b")).alias("depth"), F.least(F.col("b") * 2, F.lit(MOST)).alias("b"), "doc", "tag", "start")
        again = nodes.join(wide, "node").select("node", "depth", F.col("less").alias("b"), "doc", "tag", "start")
        before, nodes = nodes, staged(onward.unionByName(again))
        drop(before, rows, kinds, wide, found)
    if not groups:
        return cut.select("group", F.col("length").cast("long").alias("length"), "doc", "tag", "start").limit(0)
    out = staged(reduce(DataFrame.union, groups))
    # the name of the bytes themselves, from one occurrence of each group
    one = out.groupBy("name").agg(F.min(F.struct("doc", "tag", "start", "length")).alias("x")).select("name", "x.*")
    named = one.join(texts, ["doc", "tag"]).select("name", "text", "start", "length").mapInArrow(_names, "name long, group long")
    return out.join(named, "name").select("group", "length", "doc", "tag", "start")


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        spans = zip(rb.column("text"), rb.column("start").to_pylist(), rb.column("length").to_pylist(), strict=True)
        hashes = [int.from_bytes(hashlib.blake2b(t.as_buffer()[s : s + n].to_pybytes(), digest_size=8).digest(), "little", signed=True) for t, s, n in spans]
        yield pa.RecordBatch.from_arrays([rb.column("name"), pa.array(hashes, pa.int64())], ["name", "group"])

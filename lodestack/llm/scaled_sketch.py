"""Document fingerprints: every shingle hash below a fixed fraction of the hash range.

A fingerprint holds the hashes of a text's five-word shingles that fall below ``FRACTION`` of
the range, so fingerprints of parts merge into that of the whole, and two fingerprints
estimate likeness or containment however unequal their texts are.  A text whose shingles all
lie above keeps its least hash, so that only texts without words have an empty fingerprint.

``with_next`` pairs each document with the next by doc_id in one shuffle of the texts: ranges
of ids are sorted side by side, and each range also gets the first document of the next one.
Ranges are found from ids, hashes and lengths, which are taken from the texts once.

Edge cases: null and empty texts, and texts of white space, have the empty fingerprint; two
empty ones are alike (1), an empty and another are not (0); a text under five words has one
shingle; rows that repeat a doc_id are ordered by a hash of their text; a null doc_id comes
last; a lone document is its own next; an empty table gives an empty result; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec as V
from ._common import documents, id_key, ship, shuffle_partitions, staged, text_of

WORDS = 5
FRACTION = 0.25
SLICE = 256 << 10
#: Text of a slot, and slots at most; a slot passes through its task and is not held.
SLOT_BYTES, MAX_SLOTS = 64 << 20, 10_000


class Sketches:
    """Fingerprints of several texts: sorted 32-bit values, ``at`` bounds each text's."""

    def __init__(self, text: np.ndarray, offsets: np.ndarray, fraction: float = FRACTION):
        start, end, first = V.word_spans(text, offsets)
        h, doc = V.shingle_rows(V.span_hashes(text, start, end), first, WORDS)
        h >>= np.uint64(32)
        n = len(offsets) - 1
        keep = h < np.uint64(int(fraction * (1 << 32)))
        least = np.full(n, 1 << 32, np.uint64)
        np.minimum.at(least, doc, h)
        bare = np.flatnonzero((np.bincount(doc[keep], minlength=n) == 0) & (least < 1 << 32))
        key = np.unique(np.concatenate([(doc[keep].astype(np.uint64) << np.uint64(32)) | h[keep], (bare.astype(np.uint64) << np.uint64(32)) | least[bare]]))
        self.key, self.n = key, n
        self.values = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
        self.at = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
        self.sizes = np.diff(self.at)

    def strings(self) -> list[str]:
        at = self.at.tolist()
        return [base64.b64encode(self.values[a:b].tobytes()).decode() for a, b in zip(at, at[1:], strict=False)]

    def common(self, mine: np.ndarray, other: Sketches, theirs: np.ndarray) -> np.ndarray:
        """Values that text ``mine[i]`` of this shares with text ``theirs[i]`` of ``other``."""
        out = []
        for s, rows in ((self, mine), (other, theirs)):
            n = s.sizes[rows]
            place = np.repeat(s.at[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((np.repeat(np.arange(len(rows), dtype=np.uint64), n) << np.uint64(32)) | s.values[place])
        both = np.sort(np.concatenate(out))
        hit = both[1:][both[1:] == both[:-1]] >> np.uint64(32)
        return np.bincount(hit.astype(np.int64), minlength=len(mine))


def likeness(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared part of the union; two empty fingerprints are alike."""
    union = a + b - common
    return np.where(union == 0, 1.0, common / np.maximum(union, 1))


def containment(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared part of the smaller fingerprint; nothing contains or is contained but by another empty one."""
    least = np.minimum(a, b)
    return np.where(least == 0, (a == b) * 1.0, common / np.maximum(least, 1))


def merge(*fingerprints: str) -> str:
    """Fingerprint of what has the shingles of all."""
    values = np.unique(np.concatenate([np.frombuffer(base64.b64decode(f), "<u4") for f in fingerprints]))
    below = values[values < int(FRACTION * (1 << 32))]
    return base64.b64encode((below if len(below) else values[:1]).tobytes()).decode()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint for every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            text, off = V.buffers(rb.column("text"))
            for a, b in V.slices(off):
                yield pa.RecordBatch.from_arrays([rb.column("doc_id").slice(a, b - a), pa.array(Sketches(text[off[a] : off[b]], off[a : b + 1] - off[a]).strings(), pa.string())], ["doc_id", "fingerprint"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (slot, guest, doc_id, text) of ``docs``, partitioned and sorted so that within a
    slot each row is followed by the next document; guests only follow, they are not its own.

    Slots are ranges of (doc_id, hash of the text), about SLOT_BYTES of text each; an id that
    fills several slots alone is cut by the hash.  Only slot bounds come to the driver."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), id_key().alias("key"), F.xxhash64(text_of()).alias("tag"))
    keys = staged(rows.select("key", "tag", F.octet_length("text").alias("bytes")))
    size = keys.agg(F.sum("bytes")).first()[0] or 0
    n = min(MAX_SLOTS, max(shuffle_partitions(spark), -(-size // SLOT_BYTES)))
    found = keys.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10 * MAX_SLOTS)).first()[0] or [0]
    bounds, times = zip(*sorted(Counter(found).items()), strict=True)  # and slots that the id at a bound fills
    first = [1, *(1 + x for x in accumulate(times))]  # slot 0 lies before all bounds
    of = lambda values: F.get(F.lit(list(values)), F.col("range") - 1)
    part = F.floor(F.shiftrightunsigned("tag", 32) * of(times) / F.lit(float(1 << 32))).cast("int")
    slot = F.when(F.col("range") == 0, 0).otherwise(of(first) + F.when(of(bounds) == F.col("key"), part).otherwise(of(times) - 1))
    slotted = lambda d: d.withColumn("range", _range(list(bounds))).withColumn("slot", slot.cast("int"))
    rows = slotted(rows)
    order = [F.col("key"), F.col("tag").bitwiseXOR(F.lit(-(1 << 63)))]
    begins = slotted(keys).groupBy("slot").agg(F.min(F.struct("key", order[1].alias("order"))).alias("f")).orderBy("slot").collect()  # one row for each slot
    if not begins:
        return rows.select("slot", F.lit(False).alias("guest"), "doc_id", "text")
    # the first document of a slot also follows the slot before; the very first follows the last
    goes = [(b["slot"], b["f"]["key"], b["f"]["order"], begins[i - 1]["slot"]) for i, b in enumerate(begins)]
    heads = spark.createDataFrame(goes, "slot int, key long, order long, to int")
    guests = rows.withColumn("order", order[1]).join(F.broadcast(heads), ["slot", "key", "order"]).select(F.col("to").alias("slot"), F.lit(True).alias("guest"), "doc_id", "text", "key", "tag")
    sent = rows.select("slot", F.lit(False).alias("guest"), "doc_id", "text", "key", "tag").unionByName(guests.dropDuplicates(["slot"]))
    return sent.repartitionById(1 + sum(times), "slot").sortWithinPartitions("slot", "guest", *order).select("slot", "guest", "doc_id", "text")


def _range(bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` the key reaches: groups of them first, then those of
    the last group reached."""
    wide = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    reached = lambda some: F.aggregate(some, F.lit(0), lambda k, x: k + (x <= F.col("key")).cast("int"))
    group = reached(F.lit([g[0] for g in groups]))
    return F.when(group == 0, 0).otherwise((group - 1) * wide + reached(F.get(F.array(*(F.lit(g) for g in groups)), group - 1)))


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string())]
    + [(c, pa.float64()) for c in ("near_edited", "near_next", "inside_edited", "inside_next")]
)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def work(rows: list[tuple]) -> pa.RecordBatch:
        """All rows but the last, each with the row after it."""
        cur = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        texts = [r[3] for r in rows]
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 4] + texts[i + 1][: len(texts[i]) // 4] for i in cur]
        plain, changed = (Sketches(*V.buffers(pa.array(x, pa.large_string()))) for x in (texts, edited))
        at = np.array(cur, np.int64)
        ed, nx = plain.common(at, changed, np.arange(len(cur))), plain.common(at, plain, at + 1)
        a, e, b = plain.sizes[at], changed.sizes, plain.sizes[at + 1]
        prints = plain.strings()
        cols = [[rows[i][2] for i in cur], [len(texts[i]) for i in cur], [hashlib.sha256(x.encode()).hexdigest() for x in edited], [prints[i] for i in cur], changed.strings(), likeness(ed, a, e), likeness(nx, a, b), containment(ed, a, e), containment(nx, a, b)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _OUT.types, strict=True)], schema=_OUT)

    held: list[tuple] = []
    size = 0
    for rb in batches:
        for row in zip(*(rb.column(c).to_pylist() for c in ("slot", "guest", "doc_id", "text")), strict=True):
            held.append(row)
            size += len(row[3])
            if size > SLICE and len(held) > 1:
                yield work(held)
                held, size = held[-1:], len(held[-1][3])
    if len(held) > 1:
        yield work(held)


def compare_edited(docs: DataFrame) -> DataFrame:
    """For every row of ``docs`` its fingerprint, that of an edited text (the last quarter of its
    code points replaced by the start of the next document) and how near both and the next are."""
    ship(docs.sparkSession)
    return with_next(docs).mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, inside_edited double, inside_next double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(documents(spark, sf_dir))

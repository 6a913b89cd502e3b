"""Quality classifier: a factorisation machine over hashed words and structure statistics.

A text becomes a sparse vector: its words hashed to buckets (log counts, normalised) and a
few statistics of its structure and length.  The machine scores a bias, weights and all
pairwise interactions through low-rank factors; the sum-of-squares identity makes that linear
in the number of features.  It is trained on the driver, on at most ``MAX_ROWS`` labelled
rows, with AdaGrad on the logistic loss; scoring runs over all rows.

Edge cases: null and empty texts are scored by their statistics (all 0); a repeated label
counts once, the least quality; labels that are null are ignored; with no labels, or one
class, every text gets the smoothed share of label 1; repeated rows get equal scores; an empty
table gives an empty result; labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _vec as V
from ._common import documents, ship, text_of

BUCKETS = 1 << 15
#: Labelled rows that training takes at most, those with the least hash of doc_id.
MAX_ROWS = 8000
FACTORS, EPOCHS, BATCH, RATE, DECAY, SEED = 8, 8, 128, 0.05, 1e-5, 11
THRESHOLD = 0.3
STATS = ("one", "length", "words", "upper", "digits", "marks", "symbols", "wide", "word_length", "distinct", "repeated_lines", "lines", "spaces", "repeated_pairs")
SIZE = BUCKETS + len(STATS)


def features(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: (bounds of each text's features, feature, value)."""
    n = len(offsets) - 1
    start, end, first = V.word_spans(text, offsets)
    doc = np.repeat(np.arange(n), np.diff(first))
    h = V.span_hashes(text, start, end)
    words = np.diff(first).astype(float)
    size = np.diff(offsets).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1)

    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    fresh = np.append(True, (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])) if len(hs) else np.zeros(0, bool)
    distinct = np.bincount(ds[fresh], minlength=n)
    pairs = (h[:-1] * np.uint64(3) + V.mix(h[1:].copy()))[doc[1:] == doc[:-1]] if len(h) > 1 else h[:0]
    pair_doc = doc[:-1][doc[1:] == doc[:-1]] if len(h) > 1 else doc[:0]

    def repeated(value: np.ndarray, of: np.ndarray) -> np.ndarray:
        o = np.lexsort((value, of))
        v, d = value[o], of[o]
        again = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
        return np.bincount(d[1:][again], minlength=n) / np.maximum(np.bincount(of, minlength=n), 1)

    breaks = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(text == 10) + 1]))
    breaks = breaks[breaks < len(text)]
    stops = np.append(breaks[1:], len(text))
    line_doc = np.searchsorted(offsets, breaks, "right") - 1
    symbols = np.isin(text, np.frombuffer(b"#*$%&|<>", np.uint8))
    marks = ((text > 32) & (text < 48)) | ((text > 57) & (text < 65)) | ((text > 90) & (text < 97)) | ((text > 122) & (text < 127))
    stats = np.stack(
        [
            np.ones(n), np.log1p(size) / 12, np.log1p(words) / 10, share((text >= 65) & (text <= 90)), share((text >= 48) & (text <= 57)), share(marks), share(symbols), share(text >= 128),
            (size / np.maximum(words, 1)).clip(0, 50) / 20, distinct / np.maximum(words, 1), repeated(V.span_hashes(text, breaks, stops), line_doc), np.log1p(np.bincount(line_doc, minlength=n)) / 8, share(text == 32), repeated(pairs, pair_doc),
        ],
        axis=1,
    )
    bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
    key, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
    value = np.log1p(count)
    row = key // BUCKETS
    norm = np.sqrt(np.bincount(row, value * value, n))
    value = value / np.maximum(norm, 1e-9)[row]
    row = np.concatenate([row, np.repeat(np.arange(n), len(STATS))])
    col = np.concatenate([key % BUCKETS, np.tile(np.arange(BUCKETS, SIZE), n)])
    val = np.concatenate([value, stats.reshape(-1)])
    order = np.argsort(row, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), col[order], val[order]


@dataclass
class Machine:
    """bias, weight of each feature, factors (SIZE x FACTORS); mean is the score without a model."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, at: np.ndarray, col: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.factor[col] * val[:, None]
        total = np.add.reduceat(vx, at[:-1], axis=0)
        pairwise = 0.5 * (total**2 - np.add.reduceat(vx**2, at[:-1], axis=0)).sum(1)  # sum of squares, linear in features
        return self.bias + np.add.reduceat(self.weight[col] * val, at[:-1]) + pairwise, total, vx

    def score(self, at: np.ndarray, col: np.ndarray, val: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(at, col, val)[0].clip(-30, 30)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Machine:
    """rows: (label, features, values) in a fixed order."""
    rng = np.random.default_rng(SEED)
    label = np.array([r[0] for r in rows], float)
    share = (label.sum() + 1) / (len(label) + 2)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, FACTORS)))
    if len(np.unique(label)) < 2:
        m.factor[:] = 0
        return m
    g_b, g_w, g_v = 1e-6, np.full(SIZE, 1e-6), np.full((SIZE, FACTORS), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            at = np.concatenate([[0], np.cumsum([len(rows[i][1]) for i in part])])
            col, val = np.concatenate([rows[i][1] for i in part]), np.concatenate([rows[i][2] for i in part])
            raw, total, vx = m.raw(at, col, val)
            err = (1 / (1 + np.exp(-raw.clip(-30, 30))) - label[part]) / len(part)
            each = np.repeat(err, np.diff(at)) * val
            used, place = np.unique(col, return_inverse=True)
            dw = np.bincount(place, each, len(used)) + DECAY * m.weight[used]
            grad = each[:, None] * (np.repeat(total, np.diff(at), axis=0) - vx)
            dv = np.stack([np.bincount(place, grad[:, f], len(used)) for f in range(FACTORS)], 1) + DECAY * m.factor[used]
            db = err.sum()
            g_b += db * db
            g_w[used] += dw * dw
            g_v[used] += dv * dv
            m.bias -= RATE * db / np.sqrt(g_b)
            m.weight[used] -= RATE * dw / np.sqrt(g_w[used])
            m.factor[used] -= RATE * dv / np.sqrt(g_v[used])
    return m


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its doc_id as text is divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        text, off = V.buffers(rb.column("text"))
        for a, b in V.slices(off):
            at, col, val = features(text[off[a] : off[b]], off[a : b + 1] - off[a])
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.astype(t))) for x, t in ((col, np.int32), (val, np.float32))]
            yield pa.RecordBatch.from_arrays([rb.column("doc_id").slice(a, b - a), rb.column("label").slice(a, b - a), *lists], ["doc_id", "label", "col", "val"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Machine:
    """A machine fitted to rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality)
    marks and that are not held out, at most ``max_rows`` of them.  Of rows that repeat a
    doc_id the one whose text has the least hash counts."""
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).dropna()
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    sample = known.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(max_rows)
    # the sample has max_rows rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(sample), "doc_id")
    # merged in map tasks, so that the bound holds for what is collected
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "label", "text")
    got = rows.mapInArrow(_vectors, "doc_id long, label int, col array<int>, val array<float>").toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")[:max_rows]
    label, col, val = got["label"].to_numpy(), got["col"].combine_chunks(), got["val"].combine_chunks()
    return fit([(int(label[i]), col[i].values.to_numpy(), val[i].values.to_numpy().astype(float)) for i in order.tolist()])


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with ``score`` and ``predicted`` (1 from ``threshold`` on)."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(machine)  # SIZE x (FACTORS + 1) numbers
    keep = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            text, off = V.buffers(rb.column("text"))
            for a, b in V.slices(off):
                s = model.value.score(*features(text[off[a] : off[b]], off[a : b + 1] - off[a]))
                part = rb.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = docs.select(*keep).schema.add("score", T.DoubleType()).add("predicted", T.IntegerType())
    return docs.select(*keep).mapInArrow(run, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

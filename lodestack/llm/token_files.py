"""Token ids in Parquet files that can be read in part.

Documents are range-partitioned by doc_id, encoded, and written one file for each range, in
ascending order: ``shard`` (number of the range), ``row`` (place in it), ``doc_id``,
``n_tokens`` and ``tokens`` (list of ids).  Ids are dictionary-encoded, numbers are
delta-encoded; row groups and pages are kept small and carry a page index, so a reader that
wants a few documents, or only the counts, touches only those pages.  Spark's writer commits
files, so a lost executor leaves no half-written ones.

A text may hold the string of one of the file's added tokens, such as <|endoftext|>.  With
``added`` it gets that token's id, as the library does unless told otherwise, and as ``op3``
does; without, it is ordinary text where the token is a special one.

Edge cases: null and empty texts hold the end id alone; a null doc_id sorts last; rows that
repeat a doc_id are ordered by a hash of their text; an empty table gives an empty folder and
result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _vec as V
from ._common import documents, id_key, scratch_dir, ship, shuffle_partitions, text_of
from ._pieces import PieceTable

#: Fixed values of the file format.
END_ID = 2
ROW_GROUP_BYTES, PAGE_BYTES, DICTIONARY_BYTES = 16 << 20, 64 << 10, 1 << 20
#: Text that goes into one file, where that gives more files than shuffle partitions.
FILE_TEXT_BYTES = 256 << 20
SCHEMA = "shard int, row int, doc_id long, n_tokens int, tokens array<int>"
_CODERS: dict[tuple[str, bool], PieceTable] = {}


def coder(path: str, added: bool = False) -> PieceTable:
    """The tokenizers file at ``path`` behind a worker's table of pieces."""
    if (path, added) not in _CODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = not added
        tokens = list(tok.get_added_tokens_decoder().values()) if added else []
        if any(t.single_word or t.lstrip or t.rstrip for t in tokens) or (tokens and tok.normalizer):
            raise ValueError(f"{path}: added tokens that depend on what is beside them can't be cut from texts")
        words = [t.content for t in tokens]
        joins = not any("\n" in w for w in words)
        ids = lambda t: np.array(tok.encode_batch_fast([t], add_special_tokens=False)[0].ids, np.int32)
        feed = ids("\n")

        def encode(pieces: list[str]) -> list[bytes]:
            plain = [p for p in pieces if joins and "\n" not in p and p.strip() == p.lstrip(" ") and p.strip()]
            found: dict[str, bytes] = {}
            for a in range(0, len(plain), 4096):  # joined by line feeds: one call for many pieces
                part = plain[a : a + 4096]
                x = ids("\n".join(part))
                cuts = np.flatnonzero(x == feed[0]).tolist() if len(feed) == 1 else []
                if len(cuts) == len(part) - 1:
                    raw = x.tobytes()
                    found.update(zip(part, [raw[4 * i : 4 * j] for i, j in zip([0, *(c + 1 for c in cuts)], [*cuts, len(x)], strict=True)], strict=True))
            return [found[p] if p in found else ids(p).tobytes() for p in pieces]

        _CODERS[path, added] = PieceTable(encode, words)
    return _CODERS[path, added]


def _encode(path: str, added: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, row = coder(path, added), 0
        for rb in batches:
            text, off = V.buffers(rb.column("text"))
            for a, b in V.slices(off):
                size = b - a
                ids, at = table.codes(text[off[a] : off[b]], off[a : b + 1] - off[a])
                ids = np.insert(ids, at[1:], END_ID)
                offsets = (at + np.arange(size + 1)).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [rb.column("shard").slice(a, size), pa.array(np.arange(row, row + size, dtype=np.int32)), rb.column("doc_id").slice(a, size), pa.array(np.diff(offsets)), tokens],
                    ["shard", "row", "doc_id", "n_tokens", "tokens"],
                )
                row += size

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str, files: int | None = None, added: bool = False) -> None:
    """Encode ``docs`` (doc_id, text) with the tokenizers file ``tokenizer`` into folder ``path``.
    The tokenizer file must be at that path on every executor."""
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = files or max(shuffle_partitions(spark), -(-size // FILE_TEXT_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.repartitionByRange(n, id_key(), F.hash("text")).sortWithinPartitions(id_key(), F.hash("text"))
    rows = rows.withColumn("shard", F.spark_partition_id())
    out = rows.mapInArrow(_encode(tokenizer, added), SCHEMA).write
    options = {
        "compression": "zstd",
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.dictionary.page.size": DICTIONARY_BYTES,
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#tokens.list.element": "true",
        "parquet.enable.dictionary#shard": "true",
    }
    for k, v in options.items():
        out = out.option(k, str(v))
    out.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; filters on doc_id and column choice reach the scan."""
    return spark.read.schema(SCHEMA).parquet(path)


def with_starts(rows: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``start``: the ids of all documents before a row.  Shards are summed first, then rows
    within their shard, so no task takes more than a shard (or one number for each shard).
    ``counts`` (shard, n_tokens) may give the same numbers from a cheaper plan."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = (rows if counts is None else counts).groupBy("shard").agg(F.sum(F.col("n_tokens").cast("long")).alias("total"))
    ahead = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("ahead"))
    inner = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(F.col("n_tokens").cast("long")).over(inner), F.lit(0))
    return rows.withColumn("own", own).join(ahead, "shard").withColumn("start", F.col("ahead") + F.col("own")).drop("own", "ahead")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        tokens = rb.column("tokens")
        flat = tokens.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        at = tokens.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(flat)).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([rb.column(c) for c in ("shard", "row", "doc_id")] + [pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["shard", "row", "doc_id", "n_tokens", "ids_crc32"])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_dir(spark)
    write_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), path, added=True)
    ship(spark)
    files = read_tokens(spark, path)
    rows = files.mapInArrow(_crc, "shard int, row int, doc_id long, n_tokens long, ids_crc32 long")
    return with_starts(rows, files.select("shard", "n_tokens")).select("doc_id", "start", "n_tokens", "ids_crc32")

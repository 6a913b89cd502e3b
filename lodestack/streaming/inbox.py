"""Append-only inboxes: new text files become chunks as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunker import chunk_files
from ..sources.files import decode_text


def watch(spark: SparkSession, folder: str, corpus: str) -> DataFrame:
    """A stream of corpus, rel (the path below ``folder``), path, text, one row for each new file;
    edits in place and deletions need :func:`lodestack.operators.upkeep.snapshot_diff`."""
    # the scheme may be added or written another way: the folder's own name and what follows it
    tail = "/" + folder.split("://", 1)[-1].strip("/") + "/"
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    raw = raw.withColumn("tail", F.lit(tail))
    return raw.select(F.lit(corpus).alias("corpus"), F.expr("substring(path, instr(path, tail) + length(tail))").alias("rel"), "path", decode_text("content").alias("text"))


def chunk_inbox(spark: SparkSession, folder: str, corpus: str, out: str, checkpoint: str) -> StreamingQuery:
    """Chunk everything that is new in ``folder`` into Parquet at ``out``, then stop."""
    return chunk_files(watch(spark, folder, corpus)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

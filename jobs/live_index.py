"""Keep a term index of documents current: each run takes only the files that are new.

    python -m jobs.live_index --config jobs/live_index.json --input DIR --output DIR --checkpoint DIR

``input`` is a folder, or a pattern of paths, of Parquet files of documents (doc_id, text, lang,
source) where new files arrive.  A file stream with a checkpoint finds them; what is available is taken in
micro-batches, then the run ends.  ``output`` holds signed rows, merged when read:

* ``docs/batch=N``: a row with sign 1 for each version of a document, and one with sign -1
  (naming the batch that brought the version) where a later version replaces it;
* ``postings/batch=N/corpus=C``: the same for the postings of these versions.

A document that comes again with the same text, language and source changes nothing.  Where a
batch holds several versions, the one of the latest file counts, of one file that with the
greatest hash.  A document without doc_id is known by its text.  Only the partitions in which
a replaced version lies are read again.  A batch that was cut off is done again and overwrites its own
partitions, so nothing is there twice; it looks at earlier batches only.  An output belongs to
its checkpoint: neither is used with another.
"""

from __future__ import annotations

import logging
import sys
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobs.common import Settings, main, shared_folder, write_counted
from lodestack.functions import text as T
from lodestack.operators import retrieval as R

log = logging.getLogger("live_index")

DEFAULTS: dict[str, Any] = {"input": "", "output": "", "checkpoint": "", "max_files_per_batch": 1000}
INPUT = "doc_id bigint, text string, lang string, source string"
DOCS = "doc string, hash string, words bigint, corpus string, sign int, since int, batch int"
POSTINGS = "doc string, term string, tf bigint, words bigint, sign int, batch int, corpus string"
#: Documents of a batch up to which their ids are broadcast to earlier batches' rows: 10 MB or so.
BROADCAST_DOCS = 100_000


def versions(new: DataFrame) -> DataFrame:
    """The documents of a batch, one version each: doc, hash, and columns as the index takes them."""
    text = F.coalesce("text", F.lit(""))
    corpus, source = (F.coalesce(F.nullif(c, F.lit("")), F.lit("none")) for c in ("lang", "source"))
    digest = F.sha2(F.concat_ws("\n", F.char_length(corpus).cast("string"), corpus, F.char_length(source).cast("string"), source, text), 256)
    doc = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("sha256:"), F.sha2(text, 256)))
    x = new.select(doc.alias("doc"), corpus.alias("corpus"), F.concat_ws("/", source, doc).alias("rel"), text.alias("body"), F.lit("").alias("heading"), digest.alias("hash"), F.col("_metadata.file_modification_time").alias("at"))
    latest = Window.partitionBy("doc").orderBy(F.col("at").desc(), F.col("hash").desc())
    x = x.withColumn("nth", F.row_number().over(latest)).where("nth = 1").drop("nth", "at")
    return x.withColumn("words", T.word_count(F.col("body")))


def present(docs: DataFrame) -> DataFrame:
    """doc, hash, words, corpus and since of the versions that hold."""
    return docs.groupBy("doc", "hash", "words", "corpus", "since").agg(F.sum("sign").alias("n")).where("n > 0").drop("n")


def take(new: DataFrame, batch: int, output: str) -> None:
    """Write what a batch of documents adds to and takes from the index."""
    spark = new.sparkSession
    found = versions(new).persist()
    try:
        n = found.count()
        gone, old_posts = None, None
        if batch > 0:
            ids = found.select("doc")
            earlier = read(spark, output, "docs").where(F.col("batch") < batch)
            had = present(earlier.join(F.broadcast(ids) if n <= BROADCAST_DOCS else ids, "doc", "left_semi")).persist()
            new_hash = found.select("doc", F.col("hash").alias("new_hash"))
            gone = had.join(new_hash, "doc").where("hash <> new_hash").drop("new_hash")
            found_now = found.join(had.select("doc", F.col("hash")), ["doc", "hash"], "left_anti")
            # the partitions in which replaced versions lie: at most batches x corpora
            parts = [(r.since, r.corpus) for r in gone.select("since", "corpus").distinct().collect()]
            held = read(spark, output, "postings").where(F.col("batch").isin([b for b, _ in parts]) & F.col("corpus").isin([c for _, c in parts]) & (F.col("sign") == 1)) if parts else None
            if held is not None:
                old_posts = held.join(gone.select("doc", F.col("since").alias("batch"), "corpus"), ["doc", "batch", "corpus"]).select("doc", "term", "tf", "words", "corpus", F.lit(-1).alias("sign"))
        else:
            found_now, had = found, None
        docs = found_now.select("doc", "hash", "words", "corpus", F.lit(1).alias("sign"), F.lit(batch).alias("since"))
        chunks = found_now.withColumnRenamed("doc", "chunk_id")
        posts = R.postings(chunks, also=("corpus", "words")).select(F.col("chunk_id").alias("doc"), "term", "tf", "words", "corpus", F.lit(1).alias("sign"))
        if gone is not None:
            docs = docs.unionByName(gone.withColumn("sign", F.lit(-1)))
        if old_posts is not None:
            posts = posts.unionByName(old_posts)
        for name, rows, by in (("postings", posts, ("batch", "corpus")), ("docs", docs, ("batch",))):
            out = rows.withColumn("batch", F.lit(batch))
            written = write_counted(out, lambda d, by=by: d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by), f"{output}/{name}")
            log.info("batch %d: %d documents read, %d rows written to %s", batch, n, written, name)
        if had is not None:
            had.unpersist()
    finally:
        found.unpersist()


def read(spark: SparkSession, output: str, name: str) -> DataFrame:
    """The signed rows of ``docs`` or ``postings``."""
    return spark.read.schema({"docs": DOCS, "postings": POSTINGS}[name]).parquet(f"{output}/{name}")


def current(spark: SparkSession, output: str) -> DataFrame:
    """doc, term, tf, words, corpus as they are now."""
    rows = read(spark, output, "postings").groupBy("doc", "term", "tf", "words", "corpus").agg(F.sum("sign").alias("n"))
    return rows.where("n > 0").drop("n")


def run(spark: SparkSession, settings: Settings) -> dict[str, Any]:
    """Take all files that are new, then end; returns the number of batches and input rows."""
    s = {**DEFAULTS, **settings}
    stream = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", s["max_files_per_batch"]).parquet(s["input"])
    stream = stream.select("*", "_metadata")
    query = stream.writeStream.foreachBatch(lambda df, i: take(df, i, s["output"])).option("checkpointLocation", s["checkpoint"]).trigger(availableNow=True).start()
    query.awaitTermination()
    done = [p for p in query.recentProgress if p.numInputRows]
    report = {"batches": len(done), "rows": sum(p.numInputRows for p in done)}
    log.info("%(batches)d batches, %(rows)d rows from the stream", report)
    return report


def job1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the whole table into a new folder: all signed postings after the second."""
    at = shared_folder(spark, "live-index")
    settings = {"input": f"{sf_dir}/documents*.parquet", "output": f"{at}/index", "checkpoint": f"{at}/checkpoint"}
    for _ in range(2):
        run(spark, settings)
    return read(spark, settings["output"], "postings")


if __name__ == "__main__":
    sys.exit(main(run, DEFAULTS, __doc__.split("\n")[0]))

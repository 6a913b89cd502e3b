"""Answer saved searches over a table of documents in one job, with excerpts.

    python -m jobs.saved_searches --config jobs/saved_searches.json --documents FILE --searches FILE --output DIR

``searches`` is a Parquet table of texts (item_id, text), each a search.  Every search is
ranked by BM25 over all documents, once for the whole table and not by corpus; the best ``k``
documents of each, at most ``per_source`` of a source, go to ``output``, partitioned by the documents'
language, with an excerpt around the first word of the search that they hold.  A run replaces
the output as a whole, so it can be repeated.
"""

from __future__ import annotations

import logging
import sys
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import Settings, main, shared_folder, write_counted
from lodestack.functions import text as T
from lodestack.operators import retrieval as R

log = logging.getLogger("saved_searches")

DEFAULTS: dict[str, Any] = {"documents": "", "searches": "", "output": "", "k": 10, "per_source": 3, "excerpt": 120, "corpora": []}
OUTPUT = "search_id bigint, place int, doc_id bigint, source string, score double, excerpt string, corpus string"


def excerpt(text: Column, word: Column, limit: int) -> Column:
    """About ``limit`` characters of a text from a quarter of them before ``word``, or its start."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    at = F.greatest(F.lit(0), F.coalesce(F.call_function("instr", F.lower(flat), word), F.lit(0)) - 1 - limit // 4)
    return F.trim(F.substring(flat, at + 1, F.lit(limit)))


def answers(documents: DataFrame, searches: DataFrame, k: int, per_source: int, limit: int, corpora: list[str]) -> DataFrame:
    """The rows of the output.  Documents without an id can't be named and aren't searched."""
    text, some = F.coalesce("text", F.lit("")), lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("none"))
    docs = documents.where("doc_id is not null").select(F.col("doc_id").alias("chunk_id"), some("lang").alias("corpus"), some("source").alias("source"), text.alias("body"))
    chunks = docs.select("chunk_id", "corpus", F.concat_ws("/", "source", "chunk_id").alias("rel"), F.lit("").alias("heading"), "body", T.word_count(F.col("body")).alias("words"))
    asked = searches.where("item_id is not null").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("ask"))
    asked = asked.groupBy("query_id").agg(F.max("ask").alias("ask"))  # a search has one text
    queries = asked.select("query_id", T.tokens(F.col("ask")).alias("terms"))
    pool = R.bm25(R.postings(chunks), chunks, queries, max(40, 3 * k), corpora)
    hits = pool.join(docs.select(F.col("chunk_id").alias("id"), "corpus", "source", "body"), "id").withColumn("ref", F.col("source"))
    best = R.per_file_cap(hits, per_source, k).join(asked, "query_id")
    first = F.get(F.filter(T.tokens(F.col("ask"), stem=False), lambda w: F.contains(F.lower("body"), w)), F.lit(0))
    return best.select(F.col("query_id").alias("search_id"), "place", F.col("id").alias("doc_id"), "source", "score", excerpt(F.col("body"), first, limit).alias("excerpt"), "corpus")


def run(spark: SparkSession, settings: Settings) -> dict[str, Any]:
    s = {**DEFAULTS, **settings}
    documents, searches = (spark.read.parquet(s[x]) for x in ("documents", "searches"))
    log.info("documents from %s, searches from %s", s["documents"], s["searches"])
    rows = answers(documents, searches, s["k"], s["per_source"], s["excerpt"], list(s["corpora"]))
    # few rows: k for each search, so a file for each corpus
    n = write_counted(rows.repartition("corpus"), lambda d: d.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("corpus"), s["output"])
    log.info("%d hits written to %s", n, s["output"])
    return {"hits": n}


def read(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(OUTPUT).parquet(output)


def job2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the whole benchmark table as searches into one new folder."""
    settings = {"documents": f"{sf_dir}/documents.parquet", "searches": f"{sf_dir}/benchmark.parquet", "output": shared_folder(spark, "saved-searches")}
    for _ in range(2):
        run(spark, settings)
    return read(spark, settings["output"])


if __name__ == "__main__":
    sys.exit(main(run, DEFAULTS, __doc__.split("\n")[0]))

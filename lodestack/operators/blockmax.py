"""BM25 that reads the postings it needs: blocks with bounds, and a threshold to hold them against.

A term's postings lie in blocks by ranges of ``WIDTH`` chunk ids, the same ranges for every
term, each with the greatest weight that a posting in it has at the average length when it was
made.  Where that length has grown since, no weight has grown by a greater factor.  So these
bound any score in the block, and they are read without the postings.

1. The ranges of the highest bounds, ``LEAD`` for each hit wanted, are read for all terms; the
   pool-th best score in them is a threshold that the answer can't fall below.
2. From the lowest bound up, terms whose bounds together stay below the threshold are optional:
   a chunk with no other term can't be a hit.  So a range is live if its blocks' bounds reach
   the threshold, and of the other terms only the live ranges' blocks are read.
3. A chunk found there whose sum, with the optional blocks' bounds of its range, reaches the
   threshold is a candidate; of the optional terms only the blocks of its range are read.

What is skipped can't be among the hits, so they are those of a full evaluation.  Blocks are
made by grouping on (term, range): a frequent term is many blocks, not one list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import retrieval as R

#: Chunk ids of a range, and ranges read for a first threshold for each hit wanted.
WIDTH, LEAD = 64, 2
#: Scores are rounded to six digits before they are compared, so bounds get as much room.
ROOM = 1e-6


def blocks(post: DataFrame, avg: float, width: int = WIDTH) -> DataFrame:
    """term, range, n, peak (greatest weight, without idf), posts of postings (term, chunk_id, tf,
    words) of a collection whose chunks have ``avg`` words on average."""
    at = F.floor(F.col("chunk_id") / width).alias("range")
    peak = F.max(T.term_weight(F.col("tf"), F.col("words"), F.lit(avg))).alias("peak")
    return post.groupBy("term", at).agg(F.count("*").alias("n"), peak, F.collect_list(F.struct("chunk_id", "tf", "words")).alias("posts"))


def average(n: int, words: int) -> float:
    return words / n if n and words else 1.0


def _weight(idf: Column, tf: Column, words: Column, avg: float) -> Column:
    return idf * T.term_weight(tf, words, F.lit(avg))


def bm25(blocks: DataFrame, n: int, words: int, queries: DataFrame, pool: int, made_at: float | None = None, lead: int = LEAD, digits: int = 6) -> DataFrame:
    """query_id, id, score of the ``pool`` best chunks for each of ``queries`` (query_id, terms), and
    postings_read of postings_all.  ``n`` chunks and ``words`` words are those of the collection;
    blocks were made at an average length of ``made_at``, or the present one."""
    avg = average(n, words)
    grown = max(1.0, avg / (made_at or avg))
    asked = R._asked(queries)
    hint = R._hint(asked)
    mine = blocks.join(hint(asked), "term")
    heads = mine.drop("posts")
    idf = T.idf(F.lit(n), F.col("df"))

    sizes = heads.groupBy("query_id", "term").agg(F.sum("n").alias("df"))
    limits = heads.join(hint(sizes), ["query_id", "term"]).withColumn("idf", idf).withColumn("bound", F.col("idf") * F.col("peak") * grown)

    def scores(some: DataFrame, *keep: str) -> DataFrame:
        one = some.select("query_id", "idf", *keep, F.explode("posts").alias("p"))
        return one.groupBy("query_id", F.col("p.chunk_id").alias("id"), *keep).agg(F.sum(_weight(F.col("idf"), F.col("p.tf"), F.col("p.words"), avg)).alias("score"))

    # a threshold from the leading ranges: their bounds are rounded, so that all orders of adding agree
    sums = limits.groupBy("query_id", "range").agg(F.round(F.sum("bound"), 9).alias("all"))
    first = R.ranked(sums, ["query_id"], "all", "range").where(F.col("rank") <= lead * pool).select("query_id", "range", F.lit(True).alias("lead"))
    idfs = limits.select("query_id", "term", "idf").distinct()
    near = scores(mine.join(hint(idfs), ["query_id", "term"]).join(first, ["query_id", "range"]))
    best = R.ranked(near, ["query_id"]).where(F.col("rank") <= pool)
    least = best.groupBy("query_id").agg(F.when(F.count("*") >= pool, F.min("score") - ROOM).otherwise(0.0).alias("least_score"))
    # from here on a term of a query is a row of kinds
    lists = limits.groupBy("query_id", "term", "idf").agg(F.max("bound").alias("bound")).join(hint(least), "query_id")
    below = F.sum("bound").over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "term").rowsBetween(0, Window.unboundedFollowing))
    kinds = lists.withColumn("optional", below < F.col("least_score")).select("query_id", "term", "idf", "optional", "least_score")

    # ranges whose bounds reach it
    ranged = limits.select("query_id", "term", "range", "n", "bound").join(hint(kinds.drop("idf")), ["query_id", "term"])
    live = ranged.groupBy("query_id", "range", "least_score").agg(F.sum("bound").alias("all"), F.sum(F.when(F.col("optional"), F.col("bound")).otherwise(0.0)).alias("rest"))
    live = live.where("all >= least_score").select("query_id", "range", "least_score", "rest")
    needed = mine.join(hint(kinds.where("not optional").select("query_id", "term", "idf")), ["query_id", "term"]).join(live, ["query_id", "range"])
    found = scores(needed, "range", "rest", "least_score").where(F.col("score") + F.col("rest") >= F.col("least_score"))

    # what the optional terms add to these
    visited = found.select("query_id", "range").distinct()
    more = mine.join(hint(kinds.where("optional").select("query_id", "term", "idf")), ["query_id", "term"]).join(visited, ["query_id", "range"], "left_semi")
    added = scores(more).join(found.select("query_id", "id"), ["query_id", "id"], "left_semi")
    total = found.select("query_id", "id", "score").union(added).groupBy("query_id", "id").agg(F.round(F.sum("score"), digits).alias("score"))
    hits = R.ranked(total, ["query_id"]).where(F.col("rank") <= pool).drop("rank")

    # how much of the lists that was
    of = lambda d: F.broadcast(d) if hint is F.broadcast else d
    status = ranged.join(live.select("query_id", "range", F.lit(True).alias("live")), ["query_id", "range"], "left").join(visited.withColumn("visited", F.lit(True)), ["query_id", "range"], "left").join(first, ["query_id", "range"], "left")
    read = F.col("lead").isNotNull() | (~F.col("optional") & F.col("live").isNotNull()) | (F.col("optional") & F.col("visited").isNotNull())
    share = status.groupBy("query_id").agg(F.sum(F.when(read, F.col("n")).otherwise(0)).alias("postings_read"), F.sum("n").alias("postings_all"))
    return hits.join(of(share), "query_id")

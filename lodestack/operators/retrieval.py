"""Lexical lane, vector lane, fusion and hybrid search as DataFrame plans.

Many queries run in one job: ``queries`` (query_id, terms) joins postings on term.  A table of
queries is broadcast only if it has few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import ship

BROADCAST_ROWS = 100_000
#: Vectors of a block; a task holds a block of queries and one of vectors at a time.
VECTOR_BLOCK = 1024
FIELD_WEIGHTS = {"heading": 2.0, "body": 1.0, "path": 0.5}


def token_rows(rows: DataFrame, text: Column, keep: Sequence[str]) -> DataFrame:
    """``keep`` and term of each indexed token of ``text``.  Tokens are lowered, filtered and
    stemmed as rows: Spark compiles that, but not functions over arrays."""
    cased = rows.select(*keep, F.explode(T.cased_tokens(text)).alias("term"))
    low = cased.select(*keep, F.lower("term").alias("term")).where(T.is_indexed(F.col("term")))
    # never null, as a join would ask of each token, stemming it once more
    return low.select(*keep, F.coalesce(T.light_stem(F.col("term")), F.lit("")).alias("term"))


def postings(chunks: DataFrame, heading_weight: int = 2, also: Sequence[str] = ()) -> DataFrame:
    """(term, chunk_id, tf, and columns ``also`` of the chunk): tokens of the body, of the heading (counted twice) and of the path."""
    text = F.concat_ws(" ", "body", *["heading"] * heading_weight, T.path_text(F.concat_ws("/", "corpus", "rel")))
    return token_rows(chunks, text, ["chunk_id", *also]).groupBy("term", "chunk_id", *also).agg(F.count("*").alias("tf"))


def field_postings(chunks: DataFrame) -> DataFrame:
    """(field, term, chunk_id, tf) for :func:`bm25_fields`."""
    parts = {"body": F.col("body"), "heading": F.col("heading"), "path": T.path_text(F.concat_ws("/", "corpus", "rel"))}
    x = chunks.select("chunk_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), c.alias("text")) for f, c in parts.items()))).alias("x"))
    return token_rows(x.select("chunk_id", "x.*"), F.col("text"), ["field", "chunk_id"]).groupBy("field", "term", "chunk_id").agg(F.count("*").alias("tf"))


def doc_freq(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def ranked(lane: DataFrame, by: Sequence[str] = (), score: str = "score", id_: str = "id") -> DataFrame:
    """``rank`` from 1 by score, ties by id."""
    return lane.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(id_))))


def _hint(rows: DataFrame | int, each: int = 1) -> Callable[[DataFrame], DataFrame]:
    """Broadcasting for what has at most ``each`` rows for every row of ``rows`` (or so many), if that is few."""
    most = BROADCAST_ROWS // each
    n = rows if isinstance(rows, int) else rows.limit(most + 1).count()
    return F.broadcast if n <= most else lambda d: d


def _best(hits: DataFrame, n: Column, avg: Column, pool: int, digits: int) -> DataFrame:
    """(query_id, id, score) from hits (query_id, chunk_id, tf, words, df).  Scores are rounded
    before they are ordered, as sums in another order differ in the last bits."""
    weight = T.idf(n, F.col("df")) * T.term_weight(F.col("tf"), F.col("words"), avg)
    scored = hits.groupBy("query_id", F.col("chunk_id").alias("id")).agg(F.round(F.sum(weight), digits).alias("score"))
    return ranked(scored, ["query_id"]).where(F.col("rank") <= pool).drop("rank")


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))


def bm25(post: DataFrame, chunks: DataFrame, queries: DataFrame, pool: int, corpora: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """(query_id, id, score) of the ``pool`` best chunks for each of ``queries`` (query_id, terms).
    With ``corpora`` only their chunks count, for the statistics too."""
    c = chunks.where(F.col("corpus").isin(*corpora)) if corpora else chunks
    c = c.select("chunk_id", "words")
    asked = _asked(queries)
    hint = _hint(asked)
    wanted = post.join(hint(asked.select("term").distinct()), "term", "left_semi").join(c, "chunk_id")
    stats = c.agg(F.count("*").alias("n"), F.avg("words").alias("avg"))
    # a row for each asked term; what is counted is read by hits too, so both share one shuffle of postings
    freq = wanted.groupBy("term").agg(F.count(F.nullif("tf", F.lit(0))).alias("df"))
    hits = wanted.join(hint(asked), "term").join(hint(freq), "term").crossJoin(F.broadcast(stats))  # stats is one row
    return _best(hits, F.col("n"), F.col("avg"), pool, digits)


def stored_postings(chunks: DataFrame) -> DataFrame:
    """:func:`postings` with the corpus and length of the chunk, as an index keeps them."""
    return postings(chunks, also=("corpus", "words"))


def bm25_stored(post: DataFrame, terms: DataFrame, n: int, words: int, queries: DataFrame, pool: int, corpora: Sequence[str] = (), digits: int = 6, n_asked: int | None = None) -> DataFrame:
    """As :func:`bm25`, from an index: :func:`stored_postings`, ``terms`` (corpus, term, df) and
    the ``n`` chunks and ``words`` words of the corpora searched.  Reads postings once."""
    asked = _asked(queries)
    hint = _hint(asked if n_asked is None else n_asked)
    if corpora:
        post, terms = post.where(F.col("corpus").isin(*corpora)), terms.where(F.col("corpus").isin(*corpora))
    freq = terms.join(hint(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    hits = post.select("term", "chunk_id", "tf", "words").join(hint(asked.join(hint(freq), "term")), "term")
    return _best(hits, F.lit(n), F.lit(words / n if n and words else 1.0), pool, digits)


def bm25_fields(post: DataFrame, queries: DataFrame, pool: int, chunks: DataFrame, weights: dict[str, float] | None = None, digits: int = 6) -> DataFrame:
    """BM25 with a weight for each field and statistics of the whole table, whatever the filter."""
    w = weights or FIELD_WEIGHTS
    weigh = F.coalesce(*(F.when(F.col("field") == f, F.lit(x)) for f, x in w.items()))
    tf = post.groupBy("term", "chunk_id").agg(F.sum(F.col("tf") * weigh).alias("tf"))
    return bm25(tf, chunks, queries, pool, (), digits)


def knn(vectors: DataFrame, queries: DataFrame, pool: int, digits: int = 6) -> DataFrame:
    """(query_id, id, score) of the nearest of ``vectors`` (id, vec) for each of ``queries``
    (query_id, vec) by dot product: a stated set of queries against all rows.  Vectors of
    another dimension are skipped.  More queries than a block go by blocks."""
    if queries.limit(VECTOR_BLOCK + 1).count() > VECTOR_BLOCK:
        return knn_blocks(vectors, queries, pool, digits)
    pairs = vectors.crossJoin(F.broadcast(queries.select("query_id", F.col("vec").alias("q"))))  # a block at most
    scored = pairs.where(F.size("vec") == F.size("q")).select("query_id", "id", F.round(T.dot(F.col("vec"), F.col("q")), digits).alias("score"))
    return ranked(scored, ["query_id"]).where(F.col("rank") <= pool).drop("rank")


def _blocks(rows: DataFrame, id_: str, name: str) -> DataFrame:
    """Rows (id, vec) in blocks of about ``VECTOR_BLOCK``, for each dimension by itself."""
    n = max(1, -(-rows.count() // VECTOR_BLOCK))
    cut = rows.where(F.col("vec").isNotNull()).groupBy(F.size("vec").alias(f"{name}_dim"), F.pmod(F.xxhash64(id_, "vec"), F.lit(n)).alias(f"{name}_block"))
    return cut.agg(F.collect_list(F.struct(F.col(id_).alias("id"), F.col("vec").cast("array<double>").alias("vec"))).alias(name))


def _nearest(pool: int, digits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def part(rows: pa.ListScalar, dim: int) -> tuple[np.ndarray, np.ndarray]:
        ids = rows.values.field("id").to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        return ids[order], rows.values.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i in range(rb.num_rows):
                dim = rb.column("q_dim")[i].as_py()
                if dim != rb.column("v_dim")[i].as_py():
                    continue
                (asked, q), (ids, v) = part(rb.column("q")[i], dim), part(rb.column("v")[i], dim)
                score = np.round(q @ v.T, digits) + 0.0
                # of each query those that reach its pool-th best score, then the first of them by id
                k = min(pool, len(ids))
                row, col = np.nonzero(score >= np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k, None])
                order = np.lexsort((col, -score[row, col], row))
                row, col = row[order], col[order]
                few = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, col = row[few], col[few]
                yield pa.RecordBatch.from_arrays([pa.array(asked[row]), pa.array(ids[col]), pa.array(score[row, col])], ["query_id", "id", "score"])

    return run


def knn_blocks(vectors: DataFrame, queries: DataFrame, pool: int, digits: int = 6) -> DataFrame:
    """As :func:`knn`, for queries that grow with the table: blocks of queries against blocks of
    vectors, each pair of which returns ``pool`` rows for each of its queries at most."""
    ship(vectors.sparkSession)
    v = _blocks(vectors.select("id", "vec"), "id", "v")
    q = _blocks(queries.select(F.col("query_id").cast("long").alias("query_id"), "vec"), "query_id", "q")
    pairs = v.crossJoin(q).repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), "v_dim", "v_block", "q_dim", "q_block")
    scored = pairs.select("v_dim", "v", "q_dim", "q").mapInArrow(_nearest(pool, digits), "query_id long, id long, score double")
    out = ranked(scored, ["query_id"]).where(F.col("rank") <= pool).drop("rank")
    return out.withColumn("query_id", F.col("query_id").cast(queries.schema["query_id"].dataType))


def rrf(lanes: Sequence[tuple[DataFrame, Column]], k: int = 20, digits: int = 9) -> DataFrame:
    """Weighted reciprocal-rank fusion of lanes (query_id, id, score): a lane that lacks an id
    adds nothing.  Returns query_id, id, score, rank_1, rank_2, ..., ordered by rank."""
    rows = None
    for i, (lane, weight) in enumerate(lanes, 1):
        x = ranked(lane, ["query_id"]).select("query_id", "id", "rank", weight.cast("double").alias("w"), F.lit(i).alias("lane"))
        rows = x if rows is None else rows.union(x)
    ranks = [F.max(F.when(F.col("lane") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(1, len(lanes) + 1)]
    fused = rows.groupBy("query_id", "id").agg(F.round(F.sum(F.col("w") / (k + F.col("rank"))), digits).alias("score"), *ranks)
    return ranked(fused, ["query_id"])


def per_file_cap(hits: DataFrame, limit: int, k: int) -> DataFrame:
    """At most ``limit`` hits of a ref (corpus:rel) in each query, then the best ``k``."""
    order = [F.col("score").desc(), F.col("id")]
    kept = hits.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "ref").orderBy(*order))).where(F.col("nth") <= limit)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= k).drop("nth")


def coverage_weight(lexical: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, coverage, vec_weight): how many of a query's terms its best lexical hit has."""
    top = ranked(lexical, ["query_id"]).where("rank = 1")
    seen = F.concat(T.tokens(F.col("heading")), T.tokens(F.col("body")), T.tokens(F.translate("rel", "/_", "  ")))
    best = top.join(chunks, F.col("id") == F.col("chunk_id")).select("query_id", seen.alias("doc"))
    cov = F.coalesce(T.coverage(F.col("terms"), F.col("doc")), F.lit(0.0))
    return queries.join(best, "query_id", "left").select("query_id", cov.alias("coverage")).withColumn("vec_weight", T.adaptive_weight(F.col("coverage")))


def pool_of(k: int) -> int:
    """Hits of a lane from which the best ``k`` are fused."""
    return max(40, 3 * k)


def candidates(lexical: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """query_id, id, lex_rank, bm25, vec_rank, cosine of the chunks that either lane has."""
    none = F.lit(None).cast
    lanes = ranked(lexical, ["query_id"]).select("query_id", "id", F.col("rank").alias("lex_rank"), F.col("score").alias("bm25"), none("int").alias("vec_rank"), none("double").alias("cosine"))
    if near is not None:
        lanes = lanes.union(ranked(near, ["query_id"]).select("query_id", "id", none("int"), none("double"), "rank", "score"))
    return lanes.groupBy("query_id", "id").agg(*(F.max(c).alias(c) for c in ("lex_rank", "bm25", "vec_rank", "cosine")))


def fused(found: DataFrame, chunks: DataFrame, queries: DataFrame, k: int, cap: int, hybrid: bool, rrf_k: int = 20, also: Sequence[str] = (), n_queries: int | None = None) -> DataFrame:
    """Hits from :func:`candidates` and their chunks, which are joined once: weights and order come
    from windows over these rows."""
    many = queries if n_queries is None else n_queries
    rows = _hint(many, 2 * pool_of(k))(found).join(chunks, F.col("id") == F.col("chunk_id")).join(_hint(many)(queries.select("query_id", "terms")), "query_id")
    seen = F.concat(T.tokens(F.col("heading")), T.tokens(F.col("body")), T.tokens(F.translate("rel", "/_", "  ")))
    best = F.max(F.when(F.col("lex_rank") == 1, T.coverage(F.col("terms"), seen))).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("coverage", F.coalesce(best, F.lit(0.0))).withColumn("vec_weight", T.adaptive_weight(F.col("coverage")) if hybrid else F.lit(0.0))
    part = lambda w, r: F.coalesce(w / (rrf_k + F.col(r)), F.lit(0.0))
    rows = rows.withColumn("score", F.round(part(F.lit(1.0), "lex_rank") + part(F.col("vec_weight"), "vec_rank"), 9)).withColumn("ref", F.concat_ws(":", "corpus", "rel"))
    hits = per_file_cap(rows, cap, k)
    return hits.select("query_id", "place", "id", "ref", "heading", "line_start", "line_end", F.round("score", 5).alias("score"), "lex_rank", "vec_rank", F.round("bm25", 3).alias("bm25"), F.round("cosine", 4).alias("cosine"), F.round("coverage", 2).alias("lexical_coverage"), F.round("vec_weight", 2).alias("vec_weight"), "body", *also)


def search(chunks: DataFrame, post: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, k: int = 6, cap: int = 3, mode: str = "auto", corpora: Sequence[str] = (), rrf_k: int = 20) -> DataFrame:
    """Hybrid search: the lexical lane, weighed against the vector lane by coverage, fused, capped
    for each file and cut to ``k``; lexical only where vectors are absent or the mode says so."""
    k = k or 6
    lexical = bm25(post, chunks, queries, pool_of(k), corpora)
    near = None
    if mode != "lexical" and vectors is not None and query_vectors is not None:
        mine = vectors.join(chunks.where(F.col("corpus").isin(*corpora)).select(F.col("chunk_id").alias("id")), "id", "left_semi") if corpora else vectors
        near = knn(mine, query_vectors, max(20, k))
    return fused(candidates(lexical, near), chunks, queries, k, cap, near is not None, rrf_k)

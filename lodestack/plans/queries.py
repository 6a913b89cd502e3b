"""Queries over the test tables, and the same in SQL.

A document stands for a chunk: id doc_id, corpus lang, rel source/doc_id, no heading; an
embedding belongs to the document of the same number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blockmax, cells, chunker, phrases, upkeep
from ..operators import retrieval as R

QUERY = "The tion onnt of ereaer, haor"
MORE = ((1, QUERY), (2, "reble anhashed things"), (3, "édetre queeau leau"))
#: Searches for words in sequence, with stop words in them.
SEQUENCES = ((1, "in the"), (2, "Attion to thanedble"), (3, "de la"), (4, "the anea eriner"), (5, "nothing of it"))
NOW = "2024-01-31 00:00:00"
SIG = "table"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents")
    body = F.coalesce("text", F.lit(""))
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("corpus"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("rel"), F.lit("").alias("heading"), body.alias("body"), T.word_count(body).alias("words"), F.lit(1).alias("line_start"), F.size(F.split(body, "\n")).alias("line_end"), F.sha2(body, 256).alias("hash"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "events")
    return e.select(F.col("event_type").alias("corpus"), F.concat_ws("/", F.col("user_id").cast("string"), F.concat(F.col("event_id").cast("string"), F.lit(".md"))).alias("rel"), F.concat(F.lit("/kb/"), "event_type", F.lit("/"), F.col("event_id").cast("string")).alias("path"), F.sha2("props", 256).alias("sha256"), F.col("ts").alias("mtime"), F.length("props").cast("long").alias("size"), "event_id")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def asked(spark: SparkSession, which: tuple = MORE) -> DataFrame:
    return spark.createDataFrame([(i, T.stemmed_terms(q)) for i, q in which], "query_id int, terms array<string>")


def query_vectors(spark: SparkSession, sf: str, n: int = 1) -> DataFrame:
    return vectors(spark, sf).where(F.col("id") < n).select((F.col("id") + 1).cast("int").alias("query_id"), "vec")


def q_vector_batch_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every row whose id is divisible by 20 asks all rows: the queries grow with the table."""
    v = vectors(spark, sf)
    return R.knn_blocks(v, v.where("id % 20 = 0").select((F.col("id") + 1).cast("int").alias("query_id"), "vec"), 5)


def q_vector_cells(spark: SparkSession, sf: str) -> DataFrame:
    """As :func:`q_vector_batch_all`, by cells of which a query reads those that can matter."""
    v = vectors(spark, sf)
    return cells.knn(v, v.where("id % 20 = 0").select((F.col("id") + 1).cast("int").alias("query_id"), "vec"), 5)


def old_files(spark: SparkSession, sf: str) -> DataFrame:
    """An earlier state of :func:`files`: every seventh missing, some with another content or time."""
    f, i = files(spark, sf), F.col("event_id")
    day = F.make_dt_interval(F.lit(1))
    f = f.where(i % 7 != 0).withColumns({"sha256": F.when(i % 5 == 0, F.sha2(F.concat("sha256", F.lit("x")), 256)).otherwise(F.col("sha256")), "mtime": F.when(i % 5 < 2, F.col("mtime") - day).otherwise(F.col("mtime"))})
    return f


def new_files(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).where(F.col("event_id") % 11 != 0)


def old_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select(F.col("id").alias("chunk_id"), F.lit(SIG).alias("sig"), "vec")


def q_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf).select("chunk_id", T.tokens(F.col("body")).alias("t"))
    return c.select("chunk_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


def q_light_stem(spark: SparkSession, sf: str) -> DataFrame:
    t = chunks(spark, sf).select(F.explode(T.tokens(F.col("body"), stem=False)).alias("token")).distinct()
    return t.select("token", T.light_stem(F.col("token")).alias("stem"))


def q_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    return R.bm25(R.postings(c), c, asked(spark, MORE[:1]), 40).select("id", "score")


def q_bm25_corpus(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    return R.bm25(R.postings(c), c, asked(spark, MORE[:1]), 40, ["en"]).select("id", "score")


def q_bm25_batch(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    return R.bm25(R.postings(c), c, asked(spark), 20)


def q_bm25_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """As bm25_batch, from blocks that are read where they can matter.  Blocks and statistics are
    what an index keeps; here they are made of the asked terms' postings, which are held."""
    c = chunks(spark, sf)
    queries = asked(spark)
    terms = sorted({t for _, q in MORE for t in T.stemmed_terms(q)})
    size = c.agg(F.count("*").alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    post = R.postings(c, also=("words",)).where(F.col("term").isin(terms))
    held = blockmax.blocks(post, blockmax.average(*size)).persist()
    return blockmax.bm25(held, *size, queries, 20)


def q_bm25_fields(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    return R.bm25_fields(R.field_postings(c), asked(spark, MORE[:1]), 40, c).select("id", "score")


def q_bm25_phrase(spark: SparkSession, sf: str) -> DataFrame:
    """Each word of a search and all of them in sequence, in body and path, weighed 1 and 0.5.  The
    asked words' postings are held."""
    c = chunks(spark, sf)
    fields = [F.col("body"), F.concat_ws("/", "corpus", "rel")]
    post = phrases.postings(c, [T.cased_tokens(f) for f in fields], ("corpus",), lambda t: T.light_stem(F.lower(t)))
    wanted = sorted({t for _, ps in _sequences() for p in ps for t in p})
    full = c.select("chunk_id", sum(F.regexp_count(f, F.lit(T.TOKEN)) for f in fields).cast("long").alias("tokens")).where("tokens > 0")
    size = full.agg(F.countDistinct("chunk_id").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    terms = spark.createDataFrame([(t,) for t in wanted], "term string")  # a filter would stem each token in its own terms
    held = post.join(F.broadcast(terms), "term", "left_semi").persist()  # read for frequencies, rare words and others
    return phrases.rank(held, _sequences(), (1.0, 0.5), size["n"], size["tokens"], 20)


def _sequences() -> list[tuple[int, list[list[str]]]]:
    stem = lambda ws: [T.stem(w) for w in ws]
    return [(i, [[t] for t in stem(T.query_terms(q))] + [stem(q.lower().split())]) for i, q in SEQUENCES]


def _lanes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = chunks(spark, sf)
    return c, R.bm25(R.postings(c), c, asked(spark, MORE[:1]), 40), R.knn(vectors(spark, sf), query_vectors(spark, sf), 20)


def q_rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    _, lex, vec = _lanes(spark, sf)
    return R.rrf([(lex, F.lit(1.0)), (vec, F.lit(0.5))]).select("id", "score", "rank_1", "rank_2")


def q_per_file_cap(spark: SparkSession, sf: str) -> DataFrame:
    c, lex, _ = _lanes(spark, sf)
    hits = lex.join(c, F.col("id") == F.col("chunk_id")).withColumn("ref", F.split("rel", "/")[0])
    return R.per_file_cap(hits, 3, 25).select("id", "ref", "score", "place")


def q_coverage_weight(spark: SparkSession, sf: str) -> DataFrame:
    c, lex, _ = _lanes(spark, sf)
    return R.coverage_weight(lex, c, asked(spark, MORE[:1])).select(F.round("coverage", 4).alias("coverage"), F.round("vec_weight", 4).alias("vec_weight"))


def q_hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    out = R.search(c, R.postings(c), asked(spark, MORE[:1]), vectors(spark, sf), query_vectors(spark, sf), k=10)
    return out.select("place", "id", "score", "lex_rank", "vec_rank", "lexical_coverage", "vec_weight")


def q_snippet(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("chunk_id", T.snippet(F.col("body"), T.query_terms(QUERY), 120).alias("snippet"))


def q_recent(spark: SparkSession, sf: str) -> DataFrame:
    f = files(spark, sf)
    n = f.select("corpus", "rel").where("length(rel) % 2 = 0")
    out = upkeep.recent(f, n, F.lit(NOW).cast("timestamp"), 7, 20)
    return out.select("corpus", "rel", F.date_format("mtime", "yyyy-MM-dd HH:mm").alias("modified"), "chunks", "size")


def q_find_file(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.find_file(files(spark, sf), "7.MD").select("corpus", "rel")


def _tailed(spark: SparkSession, sf: str) -> DataFrame:
    return upkeep.with_tail(files(spark, sf))


def old_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """An earlier state of :func:`chunks`: every seventh missing, every fifth without its end."""
    c = chunks(spark, sf).where("chunk_id % 7 <> 0")
    body = F.when(F.col("chunk_id") % 5 == 0, F.substring("body", F.lit(1), F.floor(F.char_length("body") / 2).cast("int"))).otherwise(F.col("body"))
    c = c.withColumn("body", body)
    return c.withColumns({"words": T.word_count(F.col("body")), "hash": F.sha2("body", 256)})


def q_postings_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Postings of the earlier state and the signed rows that lead to the state without every
    eleventh chunk: what a rebuild would give."""
    old, new = old_chunks(spark, sf), chunks(spark, sf).where("chunk_id % 11 <> 0")
    return upkeep.with_deltas(R.postings(old), [upkeep.posting_deltas(old, new, R.postings)])


def q_doc_freq_delta(spark: SparkSession, sf: str) -> DataFrame:
    old, new = old_chunks(spark, sf), chunks(spark, sf).where("chunk_id % 11 <> 0")
    return upkeep.freq_with_deltas(R.doc_freq(R.postings(old)), [upkeep.posting_deltas(old, new, R.postings)])


def _in_folders(f: DataFrame) -> DataFrame:
    """Files by folders of two levels, of which changes touch some."""
    i = F.col("event_id").cast("string")
    return f.withColumn("rel", F.concat_ws("/", F.concat(F.lit("y"), F.floor(F.col("event_id") / 1000).cast("string")), F.concat(F.lit("w"), F.floor(F.col("event_id") / 20).cast("string")), F.concat(i, F.lit(".md"))))


def q_snapshot_tree(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot against an earlier one that differs in one week of files in ten."""
    new = _in_folders(files(spark, sf))
    week = F.floor(F.col("event_id") / 20)
    old = new.where(~((week % 10 == 3) & (F.col("event_id") % 3 == 0)))
    old = old.withColumn("sha256", F.when((week % 10 == 7) & (F.col("event_id") % 4 == 0), F.sha2(F.concat("sha256", F.lit("x")), 256)).otherwise(F.col("sha256"))).withColumn("size", F.when((week % 10 == 7) & (F.col("event_id") % 4 == 0), F.col("size") + 1).otherwise(F.col("size")))
    return upkeep.tree_diff(old, new, upkeep.folder_digests(old), upkeep.folder_digests(new))


def q_corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    return upkeep.corpus_stats(c.select("corpus", "rel"), c, old_vectors(spark, sf), SIG)


def q_carry_over(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    new = c.where("chunk_id % 3 <> 0").withColumn("chunk_id", F.col("chunk_id") + 1_000_000)
    return upkeep.carry_over(new, c, old_vectors(spark, sf), SIG).select("chunk_id", F.round(T.dot(F.col("vec"), F.col("vec")), 4).alias("norm2"))


def q_replace(spark: SparkSession, sf: str) -> DataFrame:
    """The index after an update: removed and changed files' rows go, fresh rows come."""
    old, new = old_files(spark, sf), new_files(spark, sf)
    diff = upkeep.snapshot_diff(old, new)
    fresh = upkeep.purge(new, diff.where("status in ('new', 'changed', 'touched')"))
    return upkeep.replace_files(old, diff.where("status <> 'unchanged'"), fresh).select("corpus", "rel", "sha256")


def q_chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents")
    f = d.select(F.col("lang").alias("corpus"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("rel"), F.lit("").alias("path"), "text")
    return chunker.chunk_files(f).select("corpus", "rel", "ordinal", "heading", "line_start", "line_end", "words", "hash")


def headed(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as Markdown files (corpus, rel, path, text): headings of three levels, fences
    and blank lines go between the lines by their number, fields above every fourth text."""
    d = _table(spark, sf, "documents")

    def line(t: Column, i: Column) -> Column:
        k = (i * 7 + F.col("doc_id")) % 13
        start = lambda n: F.substring(t, 1, n)
        marks = ((0, F.concat(F.lit("# "), start(20))), (3, F.concat(F.lit("## "), start(12), F.lit("\n"), t)), (5, F.concat(F.lit("### "), start(9), F.lit(" ##\n"), t)), (7, F.concat(F.lit("\n"), t)), (9, F.concat(F.lit("```\n# not a heading\n"), t)), (10, F.lit("~~~")))
        out = F.when(k == marks[0][0], marks[0][1])
        for at, text in marks[1:]:
            out = out.when(k == at, text)
        return out.otherwise(t)

    above = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("---\nname: note "), F.col("doc_id").cast("string"), F.lit('\ndescription: "About '), F.col("doc_id").cast("string"), F.lit('"\n---\n'))).otherwise("")
    body = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n")
    return d.select(F.col("lang").alias("corpus"), F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("rel"), F.lit("").alias("path"), F.concat(above, body).alias("text"))


def q_chunk_headed(spark: SparkSession, sf: str) -> DataFrame:
    return chunker.chunk_files(headed(spark, sf)).select("corpus", "rel", "title", "ordinal", "heading", "line_start", "line_end", "words", "hash")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "tokenize": q_tokenize,
        "light_stem": q_light_stem,
        "word_count": lambda s, d: chunks(s, d).select("chunk_id", "words"),
        "file_hash": lambda s, d: chunks(s, d).select("chunk_id", "hash"),
        "postings": lambda s, d: R.postings(chunks(s, d)),
        "doc_freq": lambda s, d: R.doc_freq(R.postings(chunks(s, d))),
        "bm25_topk": q_bm25_topk,
        "bm25_topk_corpus": q_bm25_corpus,
        "bm25_batch": q_bm25_batch,
        "bm25_blocks": q_bm25_blocks,
        "bm25_fields": q_bm25_fields,
        "bm25_phrase": q_bm25_phrase,
        "vector_topk": lambda s, d: R.knn(vectors(s, d), query_vectors(s, d), 20).select("id", "score"),
        "vector_batch_all": q_vector_batch_all,
        "vector_cells": q_vector_cells,
        "normalize": lambda s, d: vectors(s, d).select("id", F.transform(T.normalize(F.col("vec")), lambda x: F.round(x, 5)).alias("v")).select("id", F.posexplode("v").alias("i", "x")),
        "rrf_fuse": q_rrf_fuse,
        "per_file_cap": q_per_file_cap,
        "coverage_weight": q_coverage_weight,
        "hybrid_search": q_hybrid_search,
        "snippet": q_snippet,
        "recent": q_recent,
        "find_file": q_find_file,
        "find_file_tail": lambda s, d: upkeep.find_by_tail(_tailed(s, d), "7.MD").select("corpus", "rel"),
        "postings_delta": q_postings_delta,
        "doc_freq_delta": q_doc_freq_delta,
        "snapshot_tree": q_snapshot_tree,
        "corpus_stats": q_corpus_stats,
        "index_status": lambda s, d: upkeep.status(q_corpus_stats(s, d)),
        "pending_embeddings": lambda s, d: upkeep.pending(chunks(s, d), old_vectors(s, d), SIG).select("chunk_id"),
        "snapshot_diff": lambda s, d: upkeep.snapshot_diff(old_files(s, d), new_files(s, d)),
        "index_report": lambda s, d: upkeep.snapshot_diff(old_files(s, d), new_files(s, d)).groupBy("status").agg(F.count("*").alias("files")),
        "purge": lambda s, d: upkeep.purge(old_files(s, d), new_files(s, d)).select("corpus", "rel"),
        "carry_over": q_carry_over,
        "replace_files": q_replace,
        "chunk_documents": q_chunk_documents,
        "chunk_headed": q_chunk_headed,
    }


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_STEM = """CASE WHEN length(t) > 5 AND t LIKE '%ies' THEN t[:length(t)-3] || 'y' WHEN length(t) > 5 AND t LIKE '%ing' THEN t[:length(t)-3]
 WHEN length(t) > 4 AND t LIKE '%ed' THEN t[:length(t)-2] WHEN length(t) > 3 AND t LIKE '%s' AND NOT t LIKE '%ss' THEN t[:length(t)-1] ELSE t END"""
_CHUNKS = r"""c AS (SELECT doc_id AS chunk_id, lang AS corpus, source || '/' || doc_id AS rel, coalesce(text, '') AS body,
 len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> ''))::BIGINT AS words FROM documents)"""
_TOKENS = rf"""raw AS (SELECT chunk_id, unnest(regexp_extract_all(lower(body || ' ' || replace(replace(corpus || '/' || rel, '/', ' '), '.', ' ')), '[\p{{L}}\p{{N}}]+')) AS t FROM c),
 tok AS (SELECT chunk_id, {_STEM} AS term FROM raw WHERE length(t) >= 2 AND t NOT IN ({_STOP})),
 post AS (SELECT term, chunk_id, count(*)::BIGINT AS tf FROM tok GROUP BY ALL)"""

#: For SQL elsewhere: stop words, the stem of ``t``, and the postings of a table ``c`` of chunks.
STOP_SQL, STEM_SQL, TOKENS_SQL = _STOP, _STEM, _TOKENS


def _asked(which: tuple) -> str:
    rows = ", ".join(f"({i}, '{t}')" for i, q in which for t in T.stemmed_terms(q))
    return f"asked AS (SELECT * FROM (VALUES {rows}) v(query_id, term))"


def _bm25(which: tuple, where: str = "true", weight: str = "tf", local: bool = True) -> str:
    return f"""{_CHUNKS}, {_TOKENS}, {_asked(which)}, cc AS (SELECT * FROM c WHERE {where}), st AS (SELECT count(*) AS n, avg(words) AS a FROM cc),
 hit AS (SELECT p.term, p.chunk_id, tf, words FROM post p JOIN cc USING (chunk_id) WHERE p.term IN (SELECT term FROM asked)),
 df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
 lex AS (SELECT query_id, chunk_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * words / a))), 6) AS score
  FROM hit JOIN df USING (term) JOIN asked USING (term), st GROUP BY ALL)"""


_TOP = "SELECT id, score FROM lex ORDER BY score DESC, id LIMIT 40"
_DOT = "round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6)"
_VEC = f"vec AS (SELECT v.vec_id AS id, {_DOT} AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY 2 DESC, 1 LIMIT 20)"
_LANES = f"{_bm25(MORE[:1])}, {_VEC}, l AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM lex QUALIFY r <= 40), v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM vec)"
_COVER = f"""best AS (SELECT id FROM l WHERE r = 1), bt AS (SELECT DISTINCT {_STEM} AS term FROM (SELECT unnest(regexp_extract_all(lower(body || ' ' || replace(replace(rel, '/', ' '), '_', ' ')), '[\\p{{L}}\\p{{N}}]+')) AS t FROM c JOIN best ON id = chunk_id) WHERE length(t) >= 2 AND t NOT IN ({_STOP})),
 cov AS (SELECT count(*) FILTER (term IN (SELECT term FROM bt)) / count(*)::DOUBLE AS coverage FROM asked)"""
_FILES = "f AS (SELECT event_type AS corpus, user_id || '/' || event_id || '.md' AS rel, sha256(props) AS sha256, ts AS mtime, length(props)::BIGINT AS size, event_id FROM events)"
_SNAPS = f"""{_FILES}, o AS (SELECT corpus, rel, CASE WHEN event_id % 5 = 0 THEN sha256(sha256 || 'x') ELSE sha256 END AS sha256, CASE WHEN event_id % 5 < 2 THEN mtime - INTERVAL 1 DAY ELSE mtime END AS mtime, size FROM f WHERE event_id % 7 <> 0),
 nw AS (SELECT * FROM f WHERE event_id % 11 <> 0),
 diff AS (SELECT corpus, rel, CASE WHEN o.sha256 IS NULL THEN 'new' WHEN nw.sha256 IS NULL THEN 'removed' WHEN o.mtime = nw.mtime AND o.size = nw.size THEN 'unchanged' WHEN o.sha256 = nw.sha256 THEN 'touched' ELSE 'changed' END AS status FROM nw FULL JOIN o USING (corpus, rel))"""
_STATS = f"""{_CHUNKS}, stats AS (SELECT corpus, count(*) AS files, count(*) AS chunks, sum(words)::BIGINT AS words, count(vec_id) AS embedded FROM c LEFT JOIN embeddings ON vec_id = chunk_id GROUP BY corpus)"""


def _snippet_sql(limit: int = 120) -> str:
    probes = [t[: max(4, len(t) - 2)] if len(t) > 4 else t for t in T.query_terms(QUERY)]
    first = "coalesce(least(" + ", ".join(f"nullif(instr(lower(s), '{p}'), 0)" for p in probes) + "), 1) - 1"
    return rf"""WITH a AS (SELECT doc_id AS chunk_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS s FROM documents),
 b AS (SELECT *, greatest(0, {first} - {limit // 4}) AS rough FROM a), d AS (SELECT *, instr(reverse(substr(s, 1, rough)), ' ') AS back FROM b),
 e AS (SELECT *, CASE WHEN back > 0 THEN rough - back + 1 ELSE rough END AS st FROM d)
 SELECT chunk_id, CASE WHEN length(s) <= {limit} THEN s ELSE CASE WHEN st > 0 THEN '...' ELSE '' END || trim(substr(s, st + 1, {limit})) || CASE WHEN st + {limit} < length(s) THEN '...' ELSE '' END END AS snippet FROM e"""


#: Texts without a heading: whole, or by paragraphs packed up to 800 words, a longer one by lines.
_CHUNKED = r"""WITH RECURSIVE d AS (SELECT doc_id, lang AS corpus, concat_ws('/', source, doc_id) AS rel, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
 l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS n, unnest(a) AS t FROM d),
 w AS (SELECT *, len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) AS w, sum(w) OVER (PARTITION BY doc_id) AS total FROM l),
 full_ AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS p FROM w WHERE w > 0),
 pw AS (SELECT doc_id, p, sum(w) > 800 AS big FROM full_ WHERE total > 800 GROUP BY ALL),
 seg AS (SELECT doc_id, p, big, sum((big OR before)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM (SELECT *, coalesce(lag(big) OVER (PARTITION BY doc_id ORDER BY p), false) AS before FROM pw)),
 units AS (SELECT doc_id, s, CASE WHEN big THEN n ELSE -p - 1 END AS u, min(n) AS a, max(n) AS b, sum(w) AS w FROM full_ JOIN seg USING (doc_id, p) GROUP BY ALL),
 unit AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY a) AS i FROM units),
 packed AS (SELECT doc_id, s, i, 1 AS g, w AS size, a, b FROM unit WHERE i = 1 UNION ALL
  SELECT u.doc_id, u.s, u.i, CASE WHEN size + u.w > 800 THEN g + 1 ELSE g END, CASE WHEN size + u.w > 800 THEN u.w ELSE size + u.w END, u.a, u.b FROM packed r JOIN unit u ON u.doc_id = r.doc_id AND u.s = r.s AND u.i = r.i + 1),
 piece AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM packed GROUP BY doc_id, s, g UNION ALL SELECT doc_id, min(n), max(n) FROM full_ WHERE total <= 800 GROUP BY doc_id),
 body AS (SELECT doc_id, a, b, sum(w) AS words, regexp_replace(string_agg(t, chr(10) ORDER BY n), '^\s+|\s+$', '', 'g') AS body FROM piece JOIN w USING (doc_id) WHERE n BETWEEN a AND b AND (w > 0 OR total <= 800) GROUP BY ALL)
 SELECT corpus, rel, (row_number() OVER (PARTITION BY doc_id ORDER BY a.a) - 1)::INTEGER AS ordinal, '' AS heading, a.a::INTEGER AS line_start, b::INTEGER AS line_end, words::INTEGER AS words, sha256(chr(10) || body) AS hash FROM body a JOIN d USING (doc_id)"""


def _blocks_sql(pool: int) -> str:
    weight = lambda tf, words: f"idf * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * {words} / a))"
    return f"""WITH {_bm25(MORE)},
 p AS (SELECT query_id, term, chunk_id, chunk_id // {blockmax.WIDTH} AS r, tf, words, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, df, a FROM hit JOIN df USING (term) JOIN asked USING (term), st),
 b AS (SELECT query_id, term, r, df, idf, count(*) AS n, max({weight("tf", "words")}) AS bound FROM p GROUP BY query_id, term, r, df, idf),
 fr AS (SELECT query_id, r FROM (SELECT query_id, r, round(sum(bound), 9) AS u FROM b GROUP BY query_id, r) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY u DESC, r) <= {blockmax.LEAD * pool}),
 fs AS (SELECT * FROM (SELECT query_id, chunk_id, sum({weight("tf", "words")}) AS score FROM p SEMI JOIN fr USING (query_id, r) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= {pool}),
 th AS (SELECT query_id, CASE WHEN count(*) >= {pool} THEN min(score) - {blockmax.ROOM} ELSE 0 END AS least FROM fs GROUP BY query_id),
 li AS (SELECT query_id, term, max(bound) AS bound FROM b GROUP BY ALL),
 k AS (SELECT query_id, term, sum(bound) OVER (PARTITION BY query_id ORDER BY bound DESC, term ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) < least AS optional, least FROM li JOIN th USING (query_id)),
 lv AS (SELECT query_id, r, least, sum(CASE WHEN optional THEN bound ELSE 0 END) AS rest FROM b JOIN k USING (query_id, term) GROUP BY query_id, r, least HAVING sum(bound) >= least),
 ca AS (SELECT query_id, chunk_id, r FROM p JOIN k USING (query_id, term) JOIN lv USING (query_id, r) WHERE NOT optional GROUP BY query_id, chunk_id, r, rest, lv.least HAVING sum({weight("tf", "words")}) + rest >= lv.least),
 rd AS (SELECT query_id, sum(n) FILTER ((query_id, r) IN (SELECT (query_id, r) FROM fr) OR (NOT optional AND (query_id, r) IN (SELECT (query_id, r) FROM lv)) OR (optional AND (query_id, r) IN (SELECT (query_id, r) FROM ca)))::BIGINT AS postings_read, sum(n)::BIGINT AS postings_all FROM b JOIN k USING (query_id, term) GROUP BY query_id)
 SELECT query_id, id, score, postings_read, postings_all FROM lex JOIN rd USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {pool}"""


def _cells_sql(pool: int) -> str:
    dot = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
    return f"""WITH e AS (SELECT vec_id AS id, embedding AS v, sqrt({dot("embedding", "embedding")}) AS norm FROM embeddings),
 pv AS (SELECT *, row_number() OVER (ORDER BY md5(id::VARCHAR), id) AS nth FROM e QUALIFY nth <= (SELECT ceil(sqrt(count(*))) FROM e)),
 an AS (SELECT e.id, e.norm, nth, acos(greatest(-1, least(1, CASE WHEN e.norm * pv.norm > 0 THEN {dot("e.v", "pv.v")} / (e.norm * pv.norm) ELSE 1 END))) AS angle FROM e, pv),
 own AS (SELECT * FROM an QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(angle, 9), nth) = 1),
 ce AS (SELECT nth, max(angle) + 1e-9 AS wide, min(norm) AS low, max(norm) AS high FROM own GROUP BY nth),
 x AS (SELECT (q.id + 1)::INTEGER AS query_id, q.id AS qid, e.id, round({dot("e.v", "q.v")}, 6) AS score FROM e, e q WHERE q.id % 20 = 0),
 inn AS (SELECT x.* FROM x JOIN own a ON a.id = x.qid JOIN own b ON b.id = x.id AND b.nth = a.nth QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, x.id) <= {pool}),
 th AS (SELECT query_id, qid, CASE WHEN count(*) >= {pool} THEN min(score) ELSE -1e308 END AS least FROM inn GROUP BY ALL),
 rd AS (SELECT query_id, 1 + count(*) FILTER (an.nth <> own.nth AND an.norm * CASE WHEN cos(greatest(0, an.angle - wide)) >= 0 THEN high ELSE low END * cos(greatest(0, an.angle - wide)) >= least - {cells.ROOM}) AS cells_read FROM th JOIN own ON own.id = th.qid JOIN an ON an.id = th.qid JOIN ce ON ce.nth = an.nth GROUP BY query_id)
 SELECT x.query_id, id, score, cells_read, (SELECT count(*) FROM ce) AS cells FROM x JOIN rd USING (query_id) QUALIFY row_number() OVER (PARTITION BY x.query_id ORDER BY score DESC, id) <= {pool}"""


def _phrase_sql(pool: int) -> str:
    rows = ", ".join(f"({i}, {j}, {len(p)}, '{t}', {o})" for i, ps in _sequences() for j, p in enumerate(ps) for o, t in enumerate(p))
    words = lambda text, f: f"SELECT chunk_id, {f} AS f, unnest(range(len(w))) AS pos, unnest(w) AS t FROM (SELECT chunk_id, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS w FROM c)"
    return f"""WITH {_CHUNKS}, raw AS ({words("body", 0)} UNION ALL {words("corpus || '/' || rel", 1)}), tok AS (SELECT chunk_id, f, pos, {_STEM} AS term FROM raw),
 q AS (SELECT * FROM (VALUES {rows}) v(query_id, phrase, length, term, o)), sz AS (SELECT chunk_id, count(*) AS words FROM tok GROUP BY chunk_id), st AS (SELECT count(*) AS n, sum(words) / count(*) AS a FROM sz),
 pl AS (SELECT query_id, phrase, chunk_id, f FROM tok JOIN q USING (term) GROUP BY query_id, phrase, length, chunk_id, f, pos - o HAVING count(*) = length),
 tf AS (SELECT query_id, phrase, chunk_id, sum(CASE f WHEN 0 THEN 1.0 ELSE 0.5 END)::DOUBLE AS tf FROM pl GROUP BY ALL), df AS (SELECT query_id, phrase, count(*) AS df FROM tf GROUP BY ALL),
 lex AS (SELECT query_id, chunk_id AS id, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * words / a))), 6) AS score FROM tf JOIN df USING (query_id, phrase) JOIN sz USING (chunk_id), st GROUP BY ALL)
 SELECT query_id, id, score FROM lex QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {pool}"""


def _headed_sql(least: int = 60, target: int = 500, most: int = 800) -> str:
    levels = range(1, 7)
    rows = "PARTITION BY doc_id ORDER BY s"
    last = ", ".join(f"coalesce(max(CASE WHEN level = {k} THEN s END) OVER ({rows}), 0) AS l{k}, last_value(CASE WHEN level = {k} THEN head END IGNORE NULLS) OVER ({rows}) AS h{k}" for k in levels)
    path = ", ".join(f"CASE WHEN level >= {k} AND l{k} > greatest({', '.join(['0', *(f'l{j}' for j in range(1, k))])}) THEN h{k} END" for k in levels)
    head = r"^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$"
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, lang AS corpus, concat_ws('/', source, doc_id || '.md') AS rel,
  CASE WHEN doc_id % 4 = 0 THEN '---' || chr(10) || 'name: note ' || doc_id || chr(10) || 'description: "About ' || doc_id || '"' || chr(10) || '---' || chr(10) ELSE '' END
  || array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda t, i: CASE ((i - 1) * 7 + doc_id) % 13 WHEN 0 THEN '# ' || t[:20] WHEN 3 THEN '## ' || t[:12] || chr(10) || t WHEN 5 THEN '### ' || t[:9] || ' ##' || chr(10) || t
   WHEN 7 THEN chr(10) || t WHEN 9 THEN '```' || chr(10) || '# not a heading' || chr(10) || t WHEN 10 THEN '~~~' ELSE t END), chr(10)) AS text FROM documents),
 l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS n, unnest(a) AS t, len(a) AS total FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM d)),
 k AS (SELECT doc_id, coalesce(min(n) FILTER (n > 1 AND trim(t) = '---'), 0) * max((n = 1 AND trim(t) = '---')::INT) AS skip FROM l GROUP BY doc_id),
 w AS (SELECT doc_id, n, t, len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) AS w, regexp_matches(t, '^\s{{0,3}}(```|~~~)') AS fence, length(regexp_extract(t, '{head}', 1)) AS mark, trim(regexp_extract(t, '{head}', 2)) AS head FROM l JOIN k USING (doc_id) WHERE n > skip AND NOT (n = total AND t = '')),
 f AS (SELECT *, mark > 0 AND sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY n) % 2 = 0 AS starts FROM w),
 h AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY n) AS s FROM f),
 sec AS (SELECT doc_id, s, min(n) AS a, max(n) AS b, sum(w) AS words, max(CASE WHEN starts THEN mark ELSE 0 END) AS level, max(CASE WHEN starts THEN head END) AS head, coalesce(sum(w) FILTER (NOT starts), 0) > 0 AS fully FROM h GROUP BY ALL HAVING s > 0 OR sum(w) > 0),
 up AS (SELECT *, {last} FROM sec),
 o AS (SELECT *, list_filter([{path}], lambda x: x IS NOT NULL) AS path, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS i FROM up),
 r AS (SELECT doc_id, i, path AS lp, level AS ll, words AS size, 1 AS g FROM o WHERE i = 1 UNION ALL
  SELECT doc_id, i, CASE WHEN same THEN lp ELSE path END, CASE WHEN same THEN ll ELSE level END, CASE WHEN same THEN size + words ELSE words END, CASE WHEN same THEN g ELSE g + 1 END
  FROM (SELECT o.doc_id, o.i, o.path, o.level, o.words, lp, ll, size, g, len(lp) > 0 AND (o.path[:len(lp)] = lp OR (o.level = ll AND o.path[1:len(o.path) - 1] = lp[1:len(lp) - 1])) AND (size < {least} OR (o.words < {least} AND size + o.words <= {target})) AS same FROM r JOIN o ON o.doc_id = r.doc_id AND o.i = r.i + 1)),
 grp AS (SELECT doc_id, g, min(a) AS a, max(b) AS b, sum(words) AS total, coalesce(arg_min(path, i) FILTER (fully), arg_min(path, i)) AS path FROM r JOIN o USING (doc_id, i) GROUP BY doc_id, g),
 gl AS (SELECT h.doc_id, g, n, t, w, total FROM grp JOIN h ON h.doc_id = grp.doc_id AND n BETWEEN a AND b),
 full_ AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id, g ORDER BY n) AS p FROM gl WHERE w > 0),
 pw AS (SELECT doc_id, g, p, sum(w) > {most} AS big FROM full_ WHERE total > {most} GROUP BY ALL),
 seg AS (SELECT doc_id, g, p, big, sum((big OR before)::INT) OVER (PARTITION BY doc_id, g ORDER BY p) AS sg FROM (SELECT *, coalesce(lag(big) OVER (PARTITION BY doc_id, g ORDER BY p), false) AS before FROM pw)),
 units AS (SELECT doc_id, g, sg, CASE WHEN big THEN n ELSE -p - 1 END AS u, min(n) AS a, max(n) AS b, sum(w) AS w FROM full_ JOIN seg USING (doc_id, g, p) GROUP BY ALL),
 unit AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g, sg ORDER BY a) AS i FROM units),
 packed AS (SELECT doc_id, g, sg, i, 1 AS q, w AS size, a, b FROM unit WHERE i = 1 UNION ALL
  SELECT u.doc_id, u.g, u.sg, u.i, CASE WHEN size + u.w > {most} THEN q + 1 ELSE q END, CASE WHEN size + u.w > {most} THEN u.w ELSE size + u.w END, u.a, u.b FROM packed r JOIN unit u ON u.doc_id = r.doc_id AND u.g = r.g AND u.sg = r.sg AND u.i = r.i + 1),
 piece AS (SELECT doc_id, g, min(a) AS a, max(b) AS b FROM packed GROUP BY doc_id, g, sg, q UNION ALL SELECT doc_id, g, min(n), max(n) FROM full_ WHERE total <= {most} GROUP BY doc_id, g),
 body AS (SELECT doc_id, g, a, b, sum(w) AS words, regexp_replace(string_agg(t, chr(10) ORDER BY n), '^\s+|\s+$', '', 'g') AS body FROM piece JOIN gl USING (doc_id, g) WHERE n BETWEEN a AND b AND (w > 0 OR total <= {most}) GROUP BY ALL),
 top AS (SELECT doc_id, arg_min(head, s) AS head FROM sec WHERE level = 1 GROUP BY doc_id),
 named AS (SELECT body.*, coalesce(nullif(array_to_string(path, ' > '), ''), CASE WHEN doc_id % 4 = 0 THEN 'About ' || doc_id ELSE '' END) AS heading FROM body JOIN grp USING (doc_id, g))
 SELECT corpus, rel, coalesce(nullif(head, ''), CASE WHEN doc_id % 4 = 0 THEN 'note ' || doc_id ELSE doc_id::VARCHAR END) AS title, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INTEGER AS ordinal, heading, a::INTEGER AS line_start, b::INTEGER AS line_end, words::INTEGER AS words, sha256(heading || chr(10) || body) AS hash FROM named JOIN d USING (doc_id) LEFT JOIN top USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    body_tokens = rf"r AS (SELECT chunk_id, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') AS w FROM c)"
    stem = _STEM.replace("t LIKE", "x LIKE").replace("length(t)", "length(x)").replace("t[", "x[").replace("ELSE t END", "ELSE x END")
    field = _bm25(MORE[:1]).replace("count(*)::BIGINT AS tf FROM tok", "count(*)::BIGINT AS tf FROM tok")
    weighed = field.replace(f"SELECT chunk_id, unnest(regexp_extract_all(lower(body || ' ' || replace(replace(corpus || '/' || rel, '/', ' '), '.', ' ')), '[\\p{{L}}\\p{{N}}]+')) AS t FROM c", "SELECT chunk_id, 1.0 AS w, unnest(regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+')) AS t FROM c UNION ALL SELECT chunk_id, 0.5, unnest(regexp_extract_all(lower(replace(replace(corpus || '/' || rel, '/', ' '), '.', ' ')), '[\\p{L}\\p{N}]+')) FROM c")
    weighed = weighed.replace("SELECT chunk_id, CASE", "SELECT chunk_id, w, CASE").replace("count(*)::BIGINT AS tf FROM tok GROUP BY ALL", "sum(w)::DOUBLE AS tf FROM tok GROUP BY term, chunk_id")
    return {
        "tokenize": f"WITH {_CHUNKS}, {body_tokens}, k AS (SELECT chunk_id, list_transform(list_filter(w, lambda x: length(x) >= 2 AND x NOT IN ({_STOP})), lambda x: {stem}) AS t FROM r) SELECT chunk_id, len(t)::BIGINT AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha256 FROM k",
        "light_stem": f"WITH {_CHUNKS}, {body_tokens} SELECT DISTINCT t AS token, {_STEM} AS stem FROM (SELECT unnest(w) AS t FROM r) WHERE length(t) >= 2 AND t NOT IN ({_STOP})",
        "word_count": f"WITH {_CHUNKS} SELECT chunk_id, words FROM c",
        "file_hash": f"WITH {_CHUNKS} SELECT chunk_id, sha256(body) AS hash FROM c",
        "postings": f"WITH {_CHUNKS}, {_TOKENS} SELECT * FROM post",
        "doc_freq": f"WITH {_CHUNKS}, {_TOKENS} SELECT term, count(*) AS df FROM post GROUP BY term",
        "bm25_topk": f"WITH {_bm25(MORE[:1])} {_TOP}",
        "bm25_topk_corpus": f"WITH {_bm25(MORE[:1], where="corpus = 'en'")} {_TOP}",
        "bm25_batch": f"WITH {_bm25(MORE)} SELECT query_id, id, score FROM lex QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20",
        "bm25_blocks": _blocks_sql(20),
        "bm25_phrase": _phrase_sql(20),
        "bm25_fields": f"WITH {weighed} {_TOP}",
        "vector_topk": f"WITH {_VEC} SELECT id, score FROM vec",
        "vector_batch_all": f"WITH x AS (SELECT (q.vec_id + 1)::INTEGER AS query_id, v.vec_id AS id, {_DOT} AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0) SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5",
        "vector_cells": _cells_sql(5),
        "normalize": "WITH n AS (SELECT vec_id AS id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS l FROM embeddings) SELECT id, (unnest(range(1, len(e) + 1)) - 1)::INTEGER AS i, round(unnest(e)::DOUBLE / CASE WHEN l = 0 THEN 1 ELSE l END, 5) AS x FROM n",
        "rrf_fuse": f"WITH {_LANES} SELECT id, round(coalesce(1.0 / (20 + l.r), 0) + coalesce(0.5 / (20 + v.r), 0), 9)::DOUBLE AS score, l.r AS rank_1, v.r AS rank_2 FROM l FULL JOIN v USING (id)",
        "per_file_cap": f"WITH {_LANES}, h AS (SELECT l.id, split_part(rel, '/', 1) AS ref, score FROM l JOIN c ON id = chunk_id), k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY ref ORDER BY score DESC, id) <= 3) SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM k QUALIFY place <= 25",
        "coverage_weight": f"WITH {_LANES}, {_COVER} SELECT round(coverage, 4) AS coverage, round(1 - 0.8 * coverage, 4) AS vec_weight FROM cov",
        "hybrid_search": f"""WITH {_LANES}, {_COVER}, fu AS (SELECT id, round(coalesce(1.0 / (20 + l.r), 0) + coalesce((1 - 0.8 * coverage) / (20 + v.r), 0), 9) AS s, l.r AS lex_rank, v.r AS vec_rank, coverage FROM l FULL JOIN v USING (id), cov)
 SELECT row_number() OVER (ORDER BY s DESC, id) AS place, id, round(s, 5)::DOUBLE AS score, lex_rank, vec_rank, round(coverage, 2) AS lexical_coverage, round(1 - 0.8 * coverage, 2) AS vec_weight FROM fu QUALIFY place <= 10""",
        "snippet": _snippet_sql(),
        "recent": f"WITH {_FILES} SELECT corpus, rel, strftime(mtime, '%Y-%m-%d %H:%M') AS modified, (length(rel) % 2 = 0)::BIGINT AS chunks, size FROM f WHERE mtime >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY ORDER BY mtime DESC, corpus, rel LIMIT 20",
        "find_file": f"WITH {_FILES} SELECT corpus, rel FROM f WHERE rel ILIKE '%7.MD'",
        "find_file_tail": f"WITH {_FILES} SELECT corpus, rel FROM f WHERE rel ILIKE '%7.MD'",
        "postings_delta": f"WITH {_CHUNKS}, {_TOKENS} SELECT * FROM post WHERE chunk_id % 11 <> 0",
        "doc_freq_delta": f"WITH {_CHUNKS}, {_TOKENS} SELECT term, count(*) AS df FROM post WHERE chunk_id % 11 <> 0 GROUP BY term",
        "snapshot_tree": """WITH f AS (SELECT event_type AS corpus, 'y' || event_id // 1000 || '/w' || event_id // 20 || '/' || event_id || '.md' AS rel, event_id AS i, event_id // 20 AS w FROM events),
 s AS (SELECT *, CASE WHEN w % 10 = 3 AND i % 3 = 0 THEN 'new' WHEN w % 10 = 7 AND i % 4 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM f)
 SELECT corpus, rel, status, bool_or(status <> 'unchanged') OVER (PARTITION BY corpus, w) AS compared FROM s""",
        "corpus_stats": f"WITH {_STATS} SELECT * FROM stats",
        "index_status": f"WITH {_STATS} SELECT sum(files)::BIGINT AS files, sum(chunks)::BIGINT AS chunks, sum(words)::BIGINT AS words, sum(embedded)::BIGINT AS embedded, round(sum(embedded) / sum(chunks), 3) AS embedded_ratio FROM stats",
        "pending_embeddings": "SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
        "snapshot_diff": f"WITH {_SNAPS} SELECT * FROM diff",
        "index_report": f"WITH {_SNAPS} SELECT status, count(*) AS files FROM diff GROUP BY status",
        "purge": f"WITH {_SNAPS} SELECT corpus, rel FROM o SEMI JOIN nw USING (corpus, rel)",
        "carry_over": f"WITH {_CHUNKS} SELECT chunk_id + 1000000 AS chunk_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS norm2 FROM c JOIN embeddings ON vec_id = chunk_id WHERE chunk_id % 3 <> 0",
        "chunk_documents": _CHUNKED,
        "chunk_headed": _headed_sql(),
        "replace_files": f"WITH {_SNAPS} SELECT corpus, rel, nw.sha256 FROM nw JOIN diff USING (corpus, rel) WHERE status <> 'unchanged' UNION ALL SELECT corpus, rel, o.sha256 FROM o JOIN diff USING (corpus, rel) WHERE status = 'unchanged'",
    }

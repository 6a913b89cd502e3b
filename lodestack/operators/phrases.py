"""Words in sequence by intersecting position lists, led by a phrase's rarest word.

A posting holds the places of its term in a chunk, fields end to end with a gap between them.
Of each phrase the word with the fewest postings is read first; postings of its other words
count only in chunks that have it, and bring their whole lists: shifted by the word's offset
they are intersected, and what is left are the places where the phrase begins.  So frequent
words bring no row for each of their places, and none at all where the rare word is absent.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import retrieval as R

#: Fields are laid end to end with a gap, so that no sequence spans two of them.
GAP = 1 << 28
#: (query_id, phrases), each phrase the terms it has in sequence.
Asked = Sequence[tuple[int, list[list[str]]]]


def postings(chunks: DataFrame, fields: Sequence[Column], also: Sequence[str] = (), term: Callable[[Column], Column] = lambda t: t) -> DataFrame:
    """term, chunk_id, ``also``, words (tokens of all fields), tf and ``at``, sorted places, of
    ``chunks`` by arrays of tokens: those of the i-th field start at i * GAP.  ``term`` makes a
    term of each token, one to a row."""
    x = chunks.select("chunk_id", *also, *(f.alias(f"f{i}") for i, f in enumerate(fields)))
    names = [f"f{i}" for i in range(len(fields))]
    words = sum((F.size(n) for n in names), F.lit(0))
    keep = ["chunk_id", *also, "words"]
    of = x.select("chunk_id", *also, words.alias("words"), F.explode(F.array(*(F.struct(F.col(n).alias("tokens"), F.lit(i * GAP).alias("base")) for i, n in enumerate(names)))).alias("f"))
    rows = of.select(*keep, "f.base", F.posexplode("f.tokens").alias("at", "token")).select(*keep, (F.col("at") + F.col("base")).alias("at"), F.coalesce(term(F.col("token")), F.lit("")).alias("term"))
    return rows.groupBy("term", *keep).agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("at")).alias("at"))


def _shifted(at: Column, by: Column) -> Column:
    return F.transform(at, lambda a: a - by)


def found(post: DataFrame, asked: Asked, terms: DataFrame | None = None, also: Sequence[str] = ()) -> DataFrame:
    """query_id, phrase (its number), chunk_id, ``also``, words and starts, the places where a phrase
    begins, of every chunk that holds it.  ``terms`` (term, df) says how frequent terms are."""
    spark = post.sparkSession
    rows = [(i, j, len(p), t, o) for i, ps in asked for j, p in enumerate(ps) for o, t in enumerate(p)]
    x = spark.createDataFrame(rows, "query_id int, phrase int, length int, term string, offset int")
    hint = R._hint(len(rows))
    if terms is None:
        freq = post.join(hint(x.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    else:
        freq = terms.join(hint(x.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    # a term that no chunk has is the rarest: its phrase leads nowhere
    by = Window.partitionBy("query_id", "phrase").orderBy("df", "offset")
    x = x.join(hint(freq), "term", "left").na.fill(0, ["df"]).withColumn("nth", F.row_number().over(by))
    key = ["query_id", "phrase", "chunk_id"]
    lead = post.join(hint(x.where("nth = 1")), "term").select(*key, "length", *also, "words", _shifted(F.col("at"), F.col("offset")).alias("starts"))
    rest = post.join(hint(x.where("nth > 1")), "term").select(*key, _shifted(F.col("at"), F.col("offset")).alias("starts"))
    lists = rest.join(lead.select(*key), key, "left_semi").groupBy(*key).agg(F.collect_list("starts").alias("lists"))  # one for each further word
    both = lead.join(lists, key, "left").where((F.col("length") == 1) | (F.size("lists") == F.col("length") - 1))
    none = F.expr("cast(array() as array<array<int>>)")
    starts = F.aggregate(F.coalesce("lists", none), F.col("starts"), lambda s, p: F.array_intersect(s, p))
    return both.select(*key, *also, "words", starts.alias("starts")).where("size(starts) > 0")


def rank(post: DataFrame, asked: Asked, weights: Sequence[float], n: int, tokens: int, pool: int, terms: DataFrame | None = None, corpora: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """query_id, id, score of the best ``pool`` chunks: BM25 with phrases in place of terms, a
    phrase's frequency being the weighted number of its places.  ``n`` chunks of ``tokens`` tokens
    in all are those of the whole index, whatever ``corpora`` are searched."""
    hits = found(post, asked, terms, ("corpus",))
    field = lambda a: F.coalesce(*(F.when(F.floor(a / GAP) == i, F.lit(float(w))) for i, w in enumerate(weights)))
    hits = hits.withColumn("tf", F.aggregate("starts", F.lit(0.0), lambda s, a: s + field(a))).drop("starts")
    df = hits.groupBy("query_id", "phrase").agg(F.count("*").alias("df"))  # a row for each phrase asked
    if corpora:
        hits = hits.where(F.col("corpus").isin(*corpora))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = F.when(idf > 0, idf).otherwise(1e-6) * T.term_weight(F.col("tf"), F.col("words"), F.lit(tokens / n if n and tokens else 1.0))
    hint = R._hint(sum(len(ps) for _, ps in asked))
    scored = hits.join(hint(df), ["query_id", "phrase"]).groupBy("query_id", F.col("chunk_id").alias("id")).agg(F.round(F.sum(score), digits).alias("score"))
    return R.ranked(scored, ["query_id"]).where(F.col("rank") <= pool).drop("rank")

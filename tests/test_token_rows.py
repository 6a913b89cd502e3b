"""Tokens as rows: the same terms as over arrays, read once for a search."""

import os

from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import retrieval as R
from lodestack.plans import queries as Q

TEXTS = ["", " \t\n", "...", "The Cities, goING and  passes!", "İstanbul ΟΔΟΣ naïve-ed x yy zz 𝟙𝟚 𐐀𐐀s", "a\u0085b c\x1cd e"]


def chunks(spark):
    rows = [(i, "en", f"src/{i}.md", "Head Heads", t) for i, t in enumerate(TEXTS)]
    c = spark.createDataFrame(rows, "chunk_id long, corpus string, rel string, heading string, body string")
    return c.withColumn("words", T.word_count(F.col("body")))


def test_terms_are_those_of_the_arrays(spark):
    c = chunks(spark)
    path = T.path_text(F.concat_ws("/", "corpus", "rel"))
    want = {}
    for r in c.select("chunk_id", T.tokens(F.col("body")).alias("b"), T.tokens(F.col("heading")).alias("h"), T.tokens(path).alias("p")).collect():
        for t in [*r.b, *r.h, *r.h, *r.p]:
            want[t, r.chunk_id] = want.get((t, r.chunk_id), 0) + 1
    assert {(r.term, r.chunk_id): r.tf for r in R.postings(c).collect()} == want
    fields = R.field_postings(c).groupBy("term", "chunk_id").agg(F.sum(F.when(F.col("field") == "heading", 2 * F.col("tf")).otherwise(F.col("tf"))).alias("tf"))
    assert {(r.term, r.chunk_id): r.tf for r in fields.collect()} == want


def test_words_are_those_between_white_space(spark):
    split = F.size(F.filter(F.split("body", r"(?U)\s+"), lambda w: w != ""))
    assert all(a == b for a, b in chunks(spark).select("words", split).collect())


def _generates(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return sum("Generate" in line and "explode(regexp_extract_all" in line for line in plan.splitlines())


def test_a_search_takes_texts_apart_once(spark):
    c = chunks(spark)
    found = R.bm25(R.postings(c), c, spark.createDataFrame([(1, ["city", "head"])], "query_id int, terms array<string>"), 10)
    assert _generates(found) == 1
    assert {r.id for r in found.collect()} == set(range(len(TEXTS)))


def test_a_phrase_search_holds_its_postings(spark):
    folder = os.environ.get("TESTDATA", "/root/testdata/sf0.001")
    plan = Q.q_bm25_phrase(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan

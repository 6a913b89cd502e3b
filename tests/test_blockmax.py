"""Block-max BM25 against the full evaluation."""

import random

import pytest

from lodestack.operators import blockmax
from lodestack.operators import retrieval as R


@pytest.fixture(scope="module")
def collection(spark):
    """4,000 chunks of words of falling frequency; a few long ones, ties and repeated ids' terms."""
    rng = random.Random(2)
    rows = []
    for i in range(4_000):
        n = 1 if i % 50 == 0 else rng.randrange(3, 30)
        words = [f"t{min(int(rng.expovariate(0.15)), 60)}" for _ in range(n)]
        rows += [(w, i, words.count(w), len(words)) for w in set(words)]
    post = spark.createDataFrame(rows, "term string, chunk_id long, tf long, words long").cache()
    sizes = {}
    for _, i, _, w in rows:
        sizes[i] = w
    return post, spark.createDataFrame([("c", i, w) for i, w in sizes.items()], "corpus string, chunk_id long, words long").cache()


QUERIES = [(1, ["t0", "t1", "t40"]), (2, ["t30", "t45"]), (3, ["t0"]), (4, ["none"]), (5, []), (6, ["t2", "t3", "t5", "t8", "t13"]), (7, ["t60", "t0", "t60"]), (8, ["none", "t59"])]


@pytest.mark.parametrize(("width", "made_at", "pool"), [(64, 1.0, 20), (7, 1.0, 5), (64, 0.5, 20), (1000, 1.7, 50)])
def test_same_hits_as_the_full_evaluation(spark, collection, width, made_at, pool):
    """Also where the average length is not that at which the bounds were made."""
    post, chunks = collection
    queries = spark.createDataFrame(QUERIES, "query_id int, terms array<string>")
    n, words = chunks.selectExpr("count(*)", "sum(words)").first()
    held = blockmax.blocks(post, made_at * words / n, width)
    rows = blockmax.bm25(held, n, words, queries, pool, made_at * words / n).collect()
    want = R.bm25(post.drop("words"), chunks, queries, pool).collect()
    assert sorted((r.query_id, r.id, r.score) for r in rows) == sorted((r.query_id, r.id, r.score) for r in want)
    share = {r.query_id: r.postings_read / r.postings_all for r in rows}
    assert set(share) == {1, 2, 3, 6, 7, 8} and max(share.values()) <= 1
    if (width, made_at) == (64, 1.0):
        assert share[1] < 0.7 and share[7] < 0.7 and sum(share.values()) < 5


def test_fewer_hits_than_asked_for_and_empty_tables(spark):
    post = spark.createDataFrame([("a", 5, 1, 3), ("b", 5, 2, 3), ("a", 900, 1, 1)], "term string, chunk_id long, tf long, words long")
    queries = spark.createDataFrame([(1, ["a", "b"])], "query_id int, terms array<string>")
    got = blockmax.bm25(blockmax.blocks(post, 2.0), 2, 4, queries, 10).collect()
    assert [r.id for r in sorted(got, key=lambda r: -r.score)] == [5, 900] and {(r.postings_read, r.postings_all) for r in got} == {(3, 3)}
    none = blockmax.blocks(post.limit(0), 1.0)
    assert blockmax.bm25(none, 0, 0, queries, 10).count() == 0

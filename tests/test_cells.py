"""Nearest neighbours by cells against comparing all with all."""

import random

from pyspark.sql import functions as F

from lodestack.operators import cells
from lodestack.operators import retrieval as R


def clustered(rng, n, dim=8, groups=12):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    return [[c + rng.gauss(0, 0.04) for c in rng.choice(centres)] for _ in range(n)]


def both(spark, rows, pool, step=20):
    v = spark.createDataFrame(rows, "id long, vec array<float>").repartition(5)
    q = v.where(f"id % {step} = 0").select(F.col("id").cast("int").alias("query_id"), "vec")
    got = cells.knn(v, q, pool).collect()
    assert sorted((r.query_id, r.id, r.score) for r in got) == sorted(map(tuple, R.knn(v, q, pool).collect()))
    return got


def test_clusters_are_skipped(spark):
    rows = list(enumerate(clustered(random.Random(1), 1500)))
    got = both(spark, rows, 5)
    assert all(1 <= r.cells_read <= r.cells for r in got)
    assert sum(r.cells_read for r in got) < 0.35 * sum(r.cells for r in got)


def test_ties_zeros_dimensions_and_lengths(spark, monkeypatch):
    """Equal vectors by the hundred, vectors of any norm, zero ones, several dimensions, nulls."""
    monkeypatch.setattr(R, "VECTOR_BLOCK", 16)
    rng = random.Random(2)
    same = [0.5] * 6
    rows = [(i, same if i % 3 == 0 else [rng.uniform(-2, 2) * (1 + i % 7) for _ in range(6 if i % 5 else 4)]) for i in range(400)]
    rows += [(1000 + i, [0.0] * 6) for i in range(0, 40, 5)] + [(2000, None), (2020, []), (2040, [1.0] * 9), (2060, [-x for x in same])]
    both(spark, rows, 5)
    both(spark, rows[:3], 10, 1)


def test_empty_tables(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<float>")
    q = v.select(F.col("id").cast("int").alias("query_id"), "vec")
    assert cells.knn(v.limit(0), q, 3).count() == 0 and cells.knn(v, q.limit(0), 3).count() == 0
    other = spark.createDataFrame([(7, [1.0, 0.0, 0.0]), (8, [0.0, 2.0])], "query_id int, vec array<float>")  # no vector has three
    assert [(r.query_id, r.id) for r in cells.knn(v, other, 3).collect()] == [(8, 1)]

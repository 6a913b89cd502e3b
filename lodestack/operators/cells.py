"""Exact nearest neighbours that skip cells: pivots, angles around them, and a bound.

Every vector belongs to the cell of its nearest pivot, one of about sqrt(n) vectors.  A cell
keeps the greatest angle between its pivot and a member, and its members' least and greatest
norm.  A query at angle a from the pivot can't have a dot product with a member above
|q| * norm * cos(max(0, a - greatest angle)).

1. Each query is answered within its own cell; its pool-th best score there is a threshold.
2. Cells whose bound is below it are skipped; the query meets the members of the others.

The result is that of comparing all with all.  Queries and members meet by an equal join on
the cell, members in blocks and queries in batches, so a cell of very many vectors (equal
ones, say) is many rows.  Only pivots and the cells' bounds go to every task: at most
``PIVOT_BYTES`` of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship
from . import retrieval as R

#: Pivots of all dimensions together hold at most so many bytes.
PIVOT_BYTES = 16 << 20
#: Scores and bounds are compared with so much room: scores are rounded to six digits.
ROOM = 2e-6


class Pivots:
    """Pivots by dimension: their vectors, norms and numbers."""

    def __init__(self, rows: list[tuple[int, list[float]]]):
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in {d for d, _ in rows}:
            mine = [v for d, v in rows if d == dim]
            m = np.array(mine, np.float64).reshape(len(mine), dim)
            self.of[dim] = m, np.sqrt((m * m).sum(axis=1))

    def angles(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(norms, angles to each pivot) of vectors of one dimension; a zero vector has none, so 0."""
        m, size = self.of[v.shape[1]]
        norm = np.sqrt((v * v).sum(axis=1))
        both = norm[:, None] * size[None, :]
        cos = np.divide(v @ m.T, both, out=np.ones_like(both), where=both > 0)
        return norm, np.arccos(np.clip(cos, -1.0, 1.0))


def _by_dim(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, their vectors) of an Arrow column of vectors."""
    size = np.diff(lists.offsets.to_numpy())
    flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(size) - size
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        yield dim, rows, flat[at[rows][:, None] + np.arange(dim)]


def _assign(pivots: Callable[[], Pivots]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pivots()
        for rb in batches:
            cell, angle, norm, dims = (np.zeros(rb.num_rows, t) for t in (np.int64, float, float, np.int64))
            for dim, rows, v in _by_dim(rb.column("vec")):
                dims[rows] = dim
                if dim not in known.of:  # queries may have a dimension that no vector has
                    cell[rows] = -1
                    continue
                norm[rows], every = known.angles(v)
                cell[rows] = every.round(9).argmin(axis=1)
                angle[rows] = every[np.arange(len(rows)), cell[rows]]
            yield pa.RecordBatch.from_arrays([rb.column("id"), rb.column("vec"), *(pa.array(x) for x in (dims, cell, angle, norm))], ["id", "vec", "dim", "cell", "angle", "norm"])

    return run


def _reach(pivots: Callable[[], Pivots], cells: dict[int, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The further cells that a query's bound doesn't exclude; ``cells``: by dimension a row for
    each cell: number, greatest angle, least and greatest norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pivots()
        for rb in batches:
            least, own = rb.column("least_score").to_numpy(zero_copy_only=False), rb.column("cell").to_numpy(zero_copy_only=False)
            for dim, rows, q in _by_dim(rb.column("vec")):
                if dim not in cells:
                    continue
                number, wide, low, high = cells[dim].T
                norm, every = known.angles(q)
                cos = np.cos(np.maximum(0.0, every[:, number.astype(int)] - wide))
                bound = norm[:, None] * np.where(cos >= 0, high, low) * cos
                at, to = np.nonzero((bound >= least[rows][:, None] - ROOM) & (number != own[rows][:, None]))
                picked = rb.take(pa.array(rows[at]))
                yield pa.RecordBatch.from_arrays([picked.column("id"), picked.column("vec"), pa.array(np.full(len(at), dim)), pa.array(number[to].astype(np.int64))], ["id", "vec", "dim", "cell"])

    return run


def knn(vectors: DataFrame, queries: DataFrame, pool: int, digits: int = 6) -> DataFrame:
    """As :func:`retrieval.knn`, with cells_read of cells for each query: query_id, id, score of the
    nearest of ``vectors`` (id, vec) for each of ``queries`` (query_id, vec) by dot product."""
    spark = vectors.sparkSession
    ship(spark)
    own = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).where("vec is not null")
    asked = queries.select(F.col("query_id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).where("vec is not null")
    sizes = {r["dim"]: r["n"] for r in own.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()}
    room = PIVOT_BYTES // max(1, sum(8 * d for d in sizes))
    n_pivots = {d: min(room, int(np.ceil(np.sqrt(n)))) for d, n in sizes.items()}
    nth = F.row_number().over(Window.partitionBy(F.size("vec")).orderBy(F.md5(F.col("id").cast("string")), "id"))
    most = F.coalesce(*(F.when(F.size("vec") == d, n) for d, n in n_pivots.items()), F.lit(0)) if n_pivots else F.lit(0)
    chosen = own.withColumn("nth", nth).where(F.col("nth") <= most).orderBy("nth").select(F.size("vec"), "vec").collect()  # PIVOT_BYTES at most
    shared = spark.sparkContext.broadcast(Pivots([(d, v) for d, v in chosen]))
    pivots = lambda: shared.value

    placed = "id long, vec array<double>, dim long, cell long, angle double, norm double"
    members = own.mapInArrow(_assign(pivots), placed).persist()
    met = asked.mapInArrow(_assign(pivots), placed).select("id", "vec", "dim", "cell")
    bounds = members.groupBy("dim", "cell").agg(F.max("angle").alias("wide"), F.min("norm").alias("low"), F.max("norm").alias("high"), F.count("*").alias("n"))
    held = bounds.collect()  # a row for each pivot at most
    cells = {d: np.array([(r["cell"], r["wide"] + 1e-9, r["low"], r["high"]) for r in held if r["dim"] == d]) for d in sizes}

    # members in blocks: a cell of many is split by a hash of the id
    blocks = members.join(F.broadcast(bounds.select("dim", "cell", "n")), ["dim", "cell"])
    split = F.pmod(F.xxhash64("id", "vec"), F.ceil(F.col("n") / R.VECTOR_BLOCK).cast("long"))
    blocks = blocks.groupBy("dim", "cell", split.alias("block")).agg(F.collect_list(F.struct("id", "vec")).alias("v"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def answer(who: DataFrame) -> DataFrame:
        """query_id, id, score of each query's ``pool`` best in the cells that it meets."""
        n = F.count("*").over(Window.partitionBy("dim", "cell"))
        batch = F.pmod(F.xxhash64("id", "vec"), F.ceil(n / R.VECTOR_BLOCK).cast("long"))
        q = who.select("id", "vec", "dim", "cell", batch.alias("batch")).groupBy("dim", "cell", "batch").agg(F.collect_list(F.struct("id", "vec")).alias("q"))
        pairs = blocks.join(q, ["dim", "cell"]).repartition(parts, "dim", "cell", "block", "batch")
        pairs = pairs.select(F.col("dim").alias("v_dim"), "v", F.col("dim").alias("q_dim"), "q")
        scored = pairs.mapInArrow(R._nearest(pool, digits), "query_id long, id long, score double")
        return R.ranked(scored, ["query_id"]).where(F.col("rank") <= pool).drop("rank")

    first = answer(met).persist()
    least = first.groupBy("query_id").agg(F.when(F.count("*") >= pool, F.min("score")).otherwise(float("-inf")).alias("least_score"))
    open_ = met.join(least, met["id"] == least["query_id"], "left").select("id", "vec", "dim", "cell", F.coalesce("least_score", F.lit(float("-inf"))).alias("least_score"))
    more = open_.select("id", "vec", "cell", "least_score").mapInArrow(_reach(pivots, cells), "id long, vec array<double>, dim long, cell long").persist()
    best = R.ranked(first.union(answer(more)), ["query_id"]).where(F.col("rank") <= pool).drop("rank")
    visits = met.where("cell >= 0").select("id", "dim", "cell").union(more.select("id", "dim", "cell")).groupBy("id", "dim").agg(F.countDistinct("cell").alias("cells_read"))
    total = F.broadcast(bounds.groupBy("dim").agg(F.count("*").alias("cells")))
    visits = visits.join(total, "dim").select(F.col("id").alias("query_id"), "cells_read", "cells")
    return best.join(visits, "query_id").select(F.col("query_id").cast(queries.schema["query_id"].dataType).alias("query_id"), "id", "score", "cells_read", "cells")

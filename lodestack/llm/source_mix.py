"""Mixing sources to target weights along a time-varying curriculum.

A source has a weight schedule, a piecewise-linear function of training time t in [0, 1].
Its integral is the source's weight; targets share the corpus by weight, and none exceeds
``cap`` times its source.  A source's documents queue in a fixed pseudo-random order, round
after round, until its target is filled.  The integral up to t, scaled to the target, is the
source's cumulative demand at t; inverting it at the middle of what a document supplies gives
the document's training position, and documents are range-sorted by position.

Running sums over a source are split: documents fall into ranges of the queue's order, sums
of ranges are accumulated first, then documents within their range.  So no task takes a whole
source or all rows of one doc_id, however many.  All of it is DataFrame code.

A null doc_id queues by its text; rows that repeat a doc_id queue together, by their texts.

Edge cases: a null source is a source of its own, last in order; null and empty texts have
size 0, take nothing and have no position; rows that repeat a doc_id count each; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import RANGE, documents, n_words_of, ranged, row_name, staged, text_of

#: A table of so many sources is broadcast at most; a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000
CAP = 3

Knots = Sequence[tuple[float, float]]


def ramped(weights: Sequence[float], swing: float = 0.5) -> list[list[tuple[float, float]]]:
    """Schedules whose integrals are ``weights``; every other one falls over time, the rest rise."""
    return [[(0.0, w * (1 + s)), (1.0, w * (1 - s))] for i, w in enumerate(weights) for s in [swing if i % 2 == 0 else -swing]]


def _schedule(cycle: Sequence[Knots], nth: Column) -> Column:
    """Segments (t0, t1, w0, slope, lo, hi) of the schedule that source number ``nth`` has;
    lo and hi are the integral at both ends."""
    arrays = []
    for knots in cycle:
        area, segs = 0.0, []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            if t1 <= t0 or min(w0, w1) < 0:
                raise ValueError("knots need rising times and weights of 0 or more")
            more = (t1 - t0) * (w0 + w1) / 2
            segs.append(F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("t0", "t1", "w0", "slope", "lo", "hi"), (t0, t1, w0, (w1 - w0) / (t1 - t0), area, area + more), strict=True))))
            area += more
        if area <= 0:
            raise ValueError("a schedule needs a positive integral")
        arrays.append(F.array(*segs))
    return F.element_at(F.array(*arrays), ((nth - 1) % len(arrays) + 1).cast("int"))


def source_targets(sized: DataFrame, cycle: Sequence[Knots], cap: float = CAP) -> DataFrame:
    """One row for each source of ``sized`` (source, size): its number in order of code points
    (null last), size, weight, segments, target.  Targets share the sum of sizes by weight;
    sources whose share exceeds cap times their size stop there.  These come first in order of
    cap * size / weight, so one pass of running sums finds the level of the rest."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = by.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))  # one row for each source
    named = named.withColumn("segs", _schedule(cycle, F.col("sid"))).withColumn("weight", F.element_at("segs", -1)["hi"])
    full = (F.lit(float(cap)) * F.col("source_size")).alias("full")
    order = Window.orderBy(F.col("full") / F.col("weight"), "sid")
    everything = Window.partitionBy()
    x = named.select("*", full)
    x = x.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    fits = F.col("level") * F.col("weight") <= F.col("full")
    x = x.withColumn("nth", F.row_number().over(order))
    x = x.withColumn("level", F.min(F.when(fits, F.struct("nth", "level"))).over(everything)["level"])  # of the first that fits
    return x.select("source", "sid", "source_size", "weight", "segs", F.least("full", F.coalesce(F.col("level") * F.col("weight"), F.col("full"))).alias("target"))


def _position(segs: Column, area: Column) -> Column:
    """The time at which a schedule's integral reaches ``area``."""
    seg = F.try_element_at(F.filter(segs, lambda s: (s["lo"] <= area) & (s["hi"] > s["lo"])), F.lit(-1))
    rest = area - seg["lo"]
    root = F.sqrt(F.greatest(seg["w0"] * seg["w0"] + 2 * seg["slope"] * rest, F.lit(0.0)))
    return F.least(seg["t1"], seg["t0"] + F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / F.nullif(seg["w0"] + root, F.lit(0.0))))


def plan_mix(docs: DataFrame, cycle: Sequence[Knots], cap: int = CAP, also: Sequence[Column] = ()) -> DataFrame:
    """For every row of ``docs`` (doc_id, text, source): doc_id, tag (a hash of the text), size,
    source_size, target, taken, and slots: for each round that takes words of it, how many and
    the training position; and more columns ``also``."""
    sized = staged(docs.select(*also, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text_of()).alias("tag"), n_words_of(text_of()).alias("size")))
    sources = staged(source_targets(sized, cycle, cap))
    few = sources.count() <= BROADCAST_SOURCES
    hint = F.broadcast if few else lambda d: d
    nth = F.xxhash64(row_name(sized)).alias("__ls_nth")  # tells copies apart
    x = sized.select("*", nth).join(hint(sources.select(F.col("source").alias("__ls_source"), "sid")), F.col("source").eqNullSafe(F.col("__ls_source"))).drop("source", "__ls_source")
    x = x.withColumn("turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.col("tag").cast("string")))))
    order = ["turn", F.col("doc_id").asc_nulls_last(), "tag", "__ls_nth"]
    x = ranged(x, sized.count(), "sid", *order)
    sums = x.groupBy("sid", RANGE).agg(F.sum("size").alias("sum"))
    upto = Window.partitionBy("sid").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", RANGE, F.coalesce(F.sum("sum").over(upto), F.lit(0)).alias("ahead"))
    inner = Window.partitionBy("sid", RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("own", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(sums, ["sid", RANGE]).join(hint(sources.drop("source")), "sid")
    quota = F.floor(F.col("target") + 0.5)
    start = F.col("ahead") + F.col("own")

    def slot(j: int) -> Column:
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - j * F.col("source_size") - F.col("start")))
        area = (j * F.col("source_size") + F.col("start") + words / 2) / F.nullif(F.col("quota"), F.lit(0)) * F.col("weight")
        return F.struct(F.lit(j).alias("round"), words.cast("long").alias("words"), _position(F.col("segs"), area).alias("position"))

    rounds = range(int(-(-cap // 1)))
    x = x.withColumn("quota", quota).withColumn("start", start)
    x = x.withColumn("slots", F.when(F.col("size") > 0, F.filter(F.array(*(slot(j) for j in rounds)), lambda s: s["words"] > 0)).otherwise(F.expr("cast(array() as array<struct<round:int,words:bigint,position:double>>)")))
    taken = F.aggregate("slots", F.lit(0).cast("long"), lambda a, s: a + s["words"])
    return x.select(*sized.columns[: len(also)], "doc_id", "tag", "size", "source_size", "target", taken.alias("taken"), "slots")


def mixed(docs: DataFrame, cycle: Sequence[Knots], cap: int = CAP) -> DataFrame:
    """The rows of ``docs`` in training order, once for each round that takes the better part of
    their words (rounds take whole documents but for the last one of each source)."""
    cols = [c for c in docs.columns if not c.startswith("__ls_")]
    docs = docs.select(*cols) if len(cols) < len(docs.columns) else docs
    docs = docs if row_name(docs) is not None else staged(docs)  # repeated rows have plans of their own
    plan = plan_mix(docs, cycle, cap, [row_name(docs).alias("__ls_row")])
    slots = plan.select("__ls_row", F.col("doc_id").alias("__ls_id"), F.col("tag").alias("__ls_tag"), F.explode(F.filter("slots", lambda s: 2 * s["words"] >= F.col("size"))).alias("__ls_slot"))
    joined = docs.select(*cols, row_name(docs).alias("__ls_row")).join(slots, "__ls_row")
    return joined.orderBy(F.col("__ls_slot.position"), "__ls_id", "__ls_tag").select(*cols)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 1, 2, 3 by source in order; ``position`` is that of the first words taken."""
    plan = plan_mix(documents(spark, sf_dir), ramped((1, 2, 3)))
    first = F.round(F.get("slots", F.lit(0))["position"], 6)
    return plan.select("doc_id", "size", "source_size", "target", "taken", first.alias("position")).orderBy("position", "doc_id")


#: The same in SQL: levels, queue and inverse of the two schedules' integrals.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source
), w AS (
  SELECT *, ((sid - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS full_size,
         CASE WHEN ((sid - 1) % 3) % 2 = 0 THEN 0.5 ELSE -0.5 END::DOUBLE AS swing FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(full_size) OVER (ORDER BY full_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY full_size / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv,
         row_number() OVER (ORDER BY full_size / weight, sid) AS nth FROM w
), t AS (
  SELECT source, source_size, weight, swing,
         least(full_size, coalesce((arg_min(lv, nth) FILTER (lv * weight <= full_size) OVER ()) * weight, full_size))::DOUBLE AS target FROM l
), q AS (
  SELECT doc_id, size, source_size, weight, swing, target, floor(target + 0.5)::BIGINT AS quota,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), r AS (
  SELECT *, greatest(0, least(size, quota - start)) AS k0, greatest(0, least(size, quota - source_size - start)) AS k1, greatest(0, least(size, quota - 2 * source_size - start)) AS k2 FROM q
), p AS (
  SELECT *, (start + k0 / 2) / quota * weight AS area, weight * (1 + swing) AS w0, -2 * weight * swing AS slope FROM r
)
SELECT doc_id, size, source_size, target, (k0 + k1 + k2)::BIGINT AS taken,
       CASE WHEN k0 > 0 THEN round(CASE WHEN area <= 0 THEN 0.0 ELSE least(1.0, 2 * area / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * area, 0)))) END, 6) END AS position
FROM p
"""

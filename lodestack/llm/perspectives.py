"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered once with that participant
as the assistant and all others as named users; the loss mask covers the assistant's words.
Rendering is kept as segments, one row for each turn and perspective, with their place in the
rendered dialogue, so a conversation of any length stays spread over tasks: places come from
running sums over ranges of turns, then within a range, and copies of a turn travel as one
row until they are placed.  Turns of one number and role whose texts begin with the same
``PREFIX`` characters share a range, however many they are; nothing else does.  ``render`` joins the segments of
conversations known to be short.

Names and texts can't forge the format's marks: in a text ``<|`` becomes ``< |``, in a name
``|>`` becomes ``| >``, too.

Edge cases: a null role is a participant named ``unknown``, a null or empty text an empty
message; null turns come last; turns with the same number are ordered by role and text;
repeated rows are repeated turns; a null conv_id is a conversation of its own; an empty table
gives an empty result; columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import RANGE, hot_join, ranged, text_of

#: Fixed values of the chat format.
ASSISTANT_HEAD, USER_HEAD, USER_TAIL, MESSAGE_END = "<|assistant|>\n", "<|user name=", "|>\n", "<|end|>\n"
#: Marks of the format that stand in a name or text are spaced out, so that they are none.
MARKS = ("<|", "|>")
#: Characters of a text by which ranges are cut, and copies of a turn that one row stands for at last.
PREFIX, COPIES = 64, 1 << 16


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, role, text, speaks (as assistant or user), segment, start and
    end (characters of the rendered dialogue), mask_start and mask_end (the trained part, null
    for users) for every turn of ``turns`` and participant of its conversation."""
    plain = lambda c, marks: functools.reduce(lambda x, m: F.replace(x, F.lit(m), F.lit(" ".join(m))), marks, c)
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), text_of().alias("text"))
    once = t.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    once = once.withColumn("conv", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null")))
    last = F.col("turn").asc_nulls_last()
    once = ranged(once, t.count(), "conv", last, "role", F.substring("text", 1, PREFIX))
    who = once.groupBy("conv").agg(F.collect_set("role").alias("who"), F.count("*").alias("turns"))  # participants; rows come out for each of them anyway
    total, most = once.agg(F.count("*"), F.max("copies")).first()
    x = hot_join(once, who, ["conv"], "turns", total).withColumn("perspective", F.explode("who")).drop("who")
    mine = F.col("role") == F.col("perspective")
    head = F.when(mine, F.lit(ASSISTANT_HEAD)).otherwise(F.concat(F.lit(USER_HEAD), plain(F.col("role"), MARKS), F.lit(USER_TAIL)))
    segment = F.concat(head, plain(F.col("text"), MARKS[:1]), F.lit(MESSAGE_END))  # made again at the end, so that it isn't shuffled
    x = x.withColumns({"head": F.char_length(head), "mine": mine, "length": F.char_length(segment).cast("long")}).withColumn("all", F.col("length") * F.col("copies"))
    keys = ["conv", "perspective", RANGE]
    sums = x.groupBy(*keys).agg(F.sum("all").alias("sum"))
    upto = Window.partitionBy(*keys[:2]).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("sum").over(upto), F.lit(0)).alias("ahead"))
    inner = Window.partitionBy(*keys).orderBy(last, "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("own", F.coalesce(F.sum("all").over(inner), F.lit(0))).join(sums, keys)
    # copies get their places: some at a time, so that those of a common turn are spread
    x = x.withColumn("lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))))
    x = x.repartition("conv", "perspective", "turn", "role", "lot") if (most or 0) > COPIES else x
    x = x.withColumn("nth", F.explode(F.sequence(F.col("lot") * COPIES, F.least(F.col("copies"), (F.col("lot") + 1) * COPIES) - 1)))
    start = F.col("ahead") + F.col("own") + F.col("nth") * F.col("length")
    text_at = start + F.col("head")
    return x.select(
        "conv_id", "perspective", "turn", "role", "text", F.when(F.col("mine"), "assistant").otherwise("user").alias("speaks"), segment.alias("segment"), start.alias("start"), (start + F.col("length")).alias("end"),
        F.when(F.col("mine"), text_at).alias("mask_start"), F.when(F.col("mine"), start + F.col("length")).alias("mask_end"),
    )


def render(segments: DataFrame) -> DataFrame:
    """conv_id, perspective, dialogue and mask (array of (start, end)) from :func:`rotate`'s rows.
    A conversation becomes one value, so this is for conversations known to be short."""
    rows = F.array_sort(F.collect_list(F.struct("start", "end", "segment", "mask_start", "mask_end")))
    x = segments.groupBy("conv_id", "perspective").agg(rows.alias("s"))
    mask = F.transform(F.filter("s", lambda r: r["mask_start"].isNotNull()), lambda r: F.struct(r["mask_start"].alias("start"), r["mask_end"].alias("end")))
    return x.select("conv_id", "perspective", F.array_join(F.transform("s", lambda r: r["segment"]), "").alias("dialogue"), mask.alias("mask"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return rows.select("conv_id", "perspective", "turn", "speaks", "start", "end", "mask_start", "mask_end", F.sha2("segment", 256).alias("segment_sha256"))


OP5_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
w AS (SELECT DISTINCT conv_id, role AS perspective FROM t),
x AS (
  SELECT t.*, perspective, role = perspective AS mine,
         CASE WHEN role = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || replace(replace(role, '<|', '< |'), '|>', '| >') || '|>' || chr(10) END AS head
  FROM t JOIN w ON t.conv_id IS NOT DISTINCT FROM w.conv_id
), s AS (SELECT *, head || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS segment FROM x),
p AS (SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s)
SELECT conv_id, perspective, turn, CASE WHEN mine THEN 'assistant' ELSE 'user' END AS speaks, start, start + length(segment) AS "end",
       CASE WHEN mine THEN start + length(head) END AS mask_start, CASE WHEN mine THEN start + length(segment) END AS mask_end, sha256(segment) AS segment_sha256
FROM p
"""

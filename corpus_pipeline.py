"""The corpus pipeline: five stages in order, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``.  The mix writes rows in training order, which the last stage returns as
``position``: read by that column they come as the curriculum gives them.

Edge cases: null and empty texts are scored like others, are never near duplicates, have
nothing to cut, take no part in the mix and so end there; a null doc_id is the largest, and
its text is a document like others; of rows that repeat doc_id and text one stays; a text cut
to nothing ends in the mix; columns beyond those of ``documents`` pass through, whatever
they are called (but for ``__ls_*``); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestack.llm import bpe_transducer, fm_quality, near_join, source_mix, suffix_repeats
from lodestack.llm._common import documents, drop_scratch, file_order, scratch, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, trained on the folder's labels, rejects go."""
    machine = fm_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return fm_quality.score(docs, machine).where("predicted = 1").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents chained by a similarity of 0.8 or more the one with the least doc_id stays."""
    return near_join.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in 50-byte windows that an earlier document has are cut from the text."""
    return suffix_repeats.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix of sources (weights 1, 2, 3) takes them."""
    return source_mix.mixed(docs, source_mix.ramped((1, 2, 3)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """position in training order, doc_id and token ids of every row."""
    placed = docs.select(file_order(docs).alias("position"), "doc_id", "text")
    return bpe_transducer.encode(placed, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("position",))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding", encode),
]

#: The stages train a model and sort suffixes, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, others = documents(spark, sf_dir), scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
        drop_scratch(spark, others | {docs._ls_path})  # what only earlier stages read
    return STAGES[-1][1](spark, docs, sf_dir)

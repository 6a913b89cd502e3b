"""The backlog of texts without a vector, embedded in micro-batches with a commit for each.

The backlog is a folder of Parquet files (chunk_id, text).  A file stream takes some files at a
time; what a batch brought is written before its commit, so a stop keeps all finished
batches, and the next run goes on with the first that isn't.  A batch in which the service
could not be reached isn't committed: it ends the run, and is done again by the next one over
its own partition.  Texts that the service refuses are done; they are kept with their state.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..sources.embedding import UNREACHED
from ..sources.files import vectors_of

BACKLOG = "chunk_id long, text string"
DONE = "chunk_id long, sig string, vec array<float>, state string, batch int"


class _Ended(Exception):
    pass


def write_backlog(pending: DataFrame, path: str, files: int) -> None:
    """``pending`` (chunk_id, text) as about ``files`` files, added to what is there."""
    pending.select("chunk_id", "text").repartition(files).write.mode("append").parquet(path)


def embed_backlog(spark: SparkSession, backlog: str, out: str, checkpoint: str, provider: Callable[[pd.Series], Any], sig: str, files_per_batch: int = 8, should_stop: Callable[[], bool] = lambda: False) -> dict[str, Any]:
    """Embed what is new in ``backlog``: counts of this run by state, its batches, and how it ended
    (``done``, ``stopped`` or ``interrupted``)."""
    ship(spark)
    report: dict[str, Any] = {"embedded": 0, "refused": 0, "unreached": 0, "batches": 0, "ended": "done"}

    def take(rows: DataFrame, batch: int) -> None:
        if should_stop():
            report["ended"] = "stopped"
            raise _Ended
        done = rows.select("chunk_id", F.lit(sig).alias("sig"), vectors_of(F.coalesce("text", F.lit("")), provider).alias("x"))
        done = done.select("chunk_id", "sig", "x.vec", "x.state", F.lit(batch).alias("batch"))
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)
        counts = {r["state"]: r["n"] for r in results(spark, out).where(F.col("batch") == batch).groupBy("state").agg(F.count("*").alias("n")).collect()}
        for state, n in counts.items():
            report[state] += n
        if counts.get(UNREACHED):
            report["ended"] = "interrupted"
            raise _Ended
        report["batches"] += 1

    stream = spark.readStream.schema(BACKLOG).option("maxFilesPerTrigger", files_per_batch).parquet(backlog)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if report["ended"] == "done":
            raise
    return report


def results(spark: SparkSession, out: str) -> DataFrame:
    """Every text that was tried: chunk_id, sig, vec (null where it was refused), state, batch."""
    return spark.read.schema(DONE).parquet(out)

"""What the jobs share: config files, the command line, logging, counting what is written."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
Settings = Mapping[str, Any]


def read_config(spark: SparkSession, path: str, defaults: Settings) -> dict[str, Any]:
    """``defaults`` with a JSON object's values over them, from any path that Spark reads."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0])
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise ValueError(f"{path}: unknown settings {', '.join(unknown)}")
    return {**defaults, **given}


def write_counted(df: DataFrame, writer: Callable[[DataFrame], DataFrameWriter], path: str) -> int:
    """Write ``df`` and say how many rows that were; they are counted on their way."""
    seen = Observation(f"written-{uuid.uuid4().hex}")
    writer(df.observe(seen, F.count(F.lit(1)).alias("rows"))).parquet(path)
    return seen.get["rows"]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def main(run: Callable[..., dict[str, Any]], defaults: Settings, doc: str, argv: list[str] | None = None) -> int:
    """The command line: a config file and any of its settings over it."""
    p = argparse.ArgumentParser(description=doc)
    p.add_argument("--config", help="JSON file with settings")
    for name, value in defaults.items():
        p.add_argument(f"--{name.replace('_', '-')}", dest=name, type=type(value) if isinstance(value, int) else str, nargs="*" if isinstance(value, list) else None)
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    spark = SparkSession.builder.appName(run.__module__).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        settings = read_config(spark, args.config, defaults) if args.config else dict(defaults)
        settings |= {k: v for k in defaults if (v := getattr(args, k)) is not None}
        missing = [k for k, v in settings.items() if v == ""]
        if missing:
            p.error(f"no value for {', '.join(missing)}")
        print(json.dumps(run(spark, settings)))
    finally:
        spark.stop()
    return 0

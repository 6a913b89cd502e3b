"""What the operators share: the shared scratch folder, shipping the package, row keys."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id, which counts as larger than every other.
LAST_ID = (1 << 63) - 1

_SHIPPED: set[str] = set()
#: Bytes of one Arrow batch between the JVM and Python; texts can be very long.
BATCH_BYTES = 2 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Has Spark delete a query's shuffle files when it ends.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, so that functions
    pickled by reference import there however the driver's path was set."""
    sc = spark.sparkContext
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(prefix="lodestack-"), "lodestack_pkg.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(out)  # executors fetch it from the driver
    _SHIPPED.add(sc.applicationId)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.  Where the
    setting is absent, as in tests on one machine, a temporary folder stands in for it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "lodestack-scratch")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lodestack-{uuid.uuid4().hex}"


#: Scratch tables that are still there, by application.
_MADE: dict[str, set[str]] = {}


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back: cuts lineage, survives lost
    executors, and lets several branches read what was computed once.  Shuffles that led to it
    are deleted at once, where else they would lie beside later ones.  What is written goes
    by :func:`drop` or :func:`drop_scratch`, or else when the driver ends."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    note(spark, path)
    before = spark.conf.get(CLEANUP_SETTING, "false")
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP_SETTING, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._ls_path = path  # type: ignore[attr-defined]
    return out


#: Rows of a range, about, and the column that holds a row's range.
RANGE_ROWS, RANGE = 1 << 17, "__ls_range"


def ranged(rows: DataFrame, total: int, *keys: Column | str) -> DataFrame:
    """``rows``, about ``total`` of them, staged with the number of the range of ``keys`` that each
    falls into; numbers ascend with the keys.  Running sums are then sums of ranges, and a sum
    within each: no key's rows gather in one task unless the keys can't tell them apart."""
    n = max(shuffle_partitions(rows.sparkSession), -(-total // RANGE_ROWS))
    return staged(rows.repartitionByRange(n, *keys).withColumn(RANGE, F.spark_partition_id()))


def note(spark: SparkSession, path: str) -> None:
    """Have ``path`` deleted with the other scratch tables."""
    if not _MADE:
        atexit.register(_at_exit)
    _MADE.setdefault(spark.sparkContext.applicationId, set()).add(path)


def _delete(path: str) -> None:
    jvm, sc = SparkContext._jvm, SparkContext._active_spark_context
    conf = sc._jsc.hadoopConfiguration() if sc else jvm.org.apache.hadoop.conf.Configuration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def _at_exit() -> None:
    for path in (p for made in _MADE.values() for p in made):
        with contextlib.suppress(Exception):  # the JVM may be gone already
            _delete(path)


def drop(*tables: DataFrame) -> None:
    """Delete what :func:`staged` wrote for tables that nothing reads any more."""
    for df in tables:
        _delete(df._ls_path)
        _MADE[df.sparkSession.sparkContext.applicationId].discard(df._ls_path)


def scratch(spark: SparkSession) -> set[str]:
    """The scratch tables that are there now."""
    return set(_MADE.get(spark.sparkContext.applicationId, ()))


def drop_scratch(spark: SparkSession, but: set[str] | frozenset[str] = frozenset()) -> None:
    """Delete this application's scratch tables other than ``but``."""
    for path in scratch(spark) - but:
        _delete(path)
        _MADE[spark.sparkContext.applicationId].discard(path)


def file_order(df: DataFrame) -> Column:
    """A number that ascends along the rows of a table as they were written: a file's number in
    its name and the row's place in it.  Rows that come from no file are numbered as they lie."""
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    try:
        df.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return F.monotonically_increasing_id()
    return F.shiftleft(part, 40) + F.col("_metadata.row_index")


def row_name(df: DataFrame) -> Column | None:
    """What tells a row of a stored table from all others, repeated ones too, whenever it is read:
    its file and its place there.  None if ``df`` isn't just a read of files."""
    if df._jdf.queryExecution().analyzed().children().nonEmpty():
        return None
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return None
    return F.struct("_metadata.file_path", "_metadata.row_index")


#: Groups of at least so many rows, and at most that many groups, count as hot; tables of at
#: most so many rows are broadcast whole.
HOT_ROWS, HOT_GROUPS, SMALL_ROWS = 256, 50_000, 100_000


def hot_join(rows: DataFrame, table: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """``rows`` joined to ``table``, which has one row for each key and in column ``size`` how
    many of the ``total`` rows have it.  Keys of very many rows are joined by a broadcast of
    HOT_GROUPS rows of the table at most, so they don't gather in one task; the others shuffle."""
    if total <= SMALL_ROWS:  # the table has no more rows than that
        return rows.join(F.broadcast(table.drop(size)), on)
    most = max(HOT_ROWS, total // HOT_GROUPS)
    hot = F.broadcast(table.where(F.col(size) > most).drop(size))
    rest = rows.join(F.broadcast(table.where(F.col(size) > most).select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(table.where(F.col(size) <= most).drop(size), on))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_key(col: str = "doc_id") -> Column:
    """doc_id as a sortable key: null comes last."""
    return F.coalesce(F.col(col).cast("long"), F.lit(LAST_ID))


def text_of(col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))


def n_words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

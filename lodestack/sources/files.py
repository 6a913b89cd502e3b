"""Folders of text files as tables, and the index as Parquet by corpus."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from fnmatch import translate
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import ship
from .config import Corpus
from .embedding import EMBEDDED, REFUSED


def include_regex(glob: str) -> str:
    """A path glob as a regex: ``**/`` spans folders, ``*`` and ``?`` stay in one."""
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(parts.get(p) or re.escape(p) for p in re.split(r"(\*\*/|\*\*|\*|\?)", glob) if p) + "$"


def exclude_regexes(glob: str) -> list[str]:
    """fnmatch patterns, where ``*`` crosses folders; a leading ``**/`` is also tried without."""
    return [translate(g).replace("\\Z", "$").replace("\\z", "$") for g in {glob, glob.removeprefix("**/")}]


@F.pandas_udf(StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """UTF-8 with replacement of bad bytes, line ends as \\n."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n"))


def _wanted(raw: DataFrame, corpus: Corpus, max_bytes: int, exclude: tuple[str, ...]) -> DataFrame:
    """Files of a corpus with ``plain``, the path without a scheme, and ``rel``, that below the root."""
    root = "/" + corpus.root.split("://")[-1].strip("/") + "/"
    plain = F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    rel = F.when(F.startswith(plain, F.lit(root)), F.substring(plain, F.lit(len(root) + 1), F.char_length(plain))).otherwise(F.element_at(F.split(plain, "/"), -1))
    x = raw.where(F.col("length") <= max_bytes).withColumns({"plain": plain, "rel": rel})
    wanted = F.lit(False)
    for g in corpus.include:
        wanted |= F.col("rel").rlike(include_regex(g))
    for g in (*corpus.exclude, *exclude):
        for r in exclude_regexes(g):
            wanted &= ~F.col("rel").rlike("^" + r) & ~F.col("plain").rlike("^" + r)
    return x.where(wanted)


def _binary(spark: SparkSession, where: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(where)


def listing(spark: SparkSession, corpus: Corpus, max_bytes: int = 2_000_000, exclude: tuple[str, ...] = ()) -> DataFrame:
    """corpus, rel, path, uri, mtime, size of a corpus's files, without opening any."""
    x = _wanted(_binary(spark, corpus.root).drop("content"), corpus, max_bytes, exclude)
    return x.select(F.lit(corpus.name).alias("corpus"), "rel", F.col("plain").alias("path"), F.col("path").alias("uri"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def scan(spark: SparkSession, corpus: Corpus, max_bytes: int = 2_000_000, exclude: tuple[str, ...] = (), uris: list[str] | None = None) -> DataFrame:
    """corpus, rel, path, text, sha256, mtime, size of a corpus's files (of ``uris`` alone, where
    they are given).  Size and path filters reach the file listing; contents are read only for
    what they leave."""
    ship(spark)
    raw = _binary(spark, corpus.root if uris is None else [re.sub(r"([\\*?\[\]{}])", r"\\\1", u) for u in uris])
    x = _wanted(raw, corpus, max_bytes, exclude)
    return x.select(F.lit(corpus.name).alias("corpus"), "rel", F.col("plain").alias("path"), decode_text("content").alias("text"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


#: Contents in one Arrow batch, and in one task, about.
OPEN_BYTES, TASK_BYTES = 8 << 20, 128 << 20


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        took, held, size = [], [], 0
        for i, path in enumerate(rb.column("path").to_pylist()):
            try:
                with open(path, "rb") as f:
                    held.append(f.read())
            except FileNotFoundError:  # it has gone since it was listed
                continue
            took.append(i)
            size += len(held[-1])
            if size >= OPEN_BYTES:
                yield _with_content(rb, took, held)
                took, held, size = [], [], 0
        yield _with_content(rb, took, held)


def _with_content(rb: pa.RecordBatch, took: list[int], held: list[bytes]) -> pa.RecordBatch:
    rows = rb.take(pa.array(took, pa.int64()))
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(held, pa.binary())], [*rows.schema.names, "content"])


def opened(listed: DataFrame) -> DataFrame:
    """What :func:`scan` gives, of just the rows of ``listed`` (see :func:`listing`), however many:
    each file is opened by the task that holds its row, below a folder that all executors mount.
    Time and size stay those listed, so a file that changed since is looked at again next time."""
    spark = listed.sparkSession
    ship(spark)
    rows = listed.select("corpus", "rel", "path", "mtime", "size")
    total = rows.agg(F.sum("size")).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    raw = rows.repartition(n, "corpus", "rel").mapInArrow(_open, "corpus string, rel string, path string, mtime timestamp, size long, content binary")
    return raw.select("corpus", "rel", "path", decode_text("content").alias("text"), F.sha2("content", 256).alias("sha256"), "mtime", "size")


def write_index(rows: DataFrame, path: str) -> None:
    """Rows by corpus; only the corpora present in ``rows`` are replaced."""
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("corpus").parquet(path)


def hashed_embedding(text: pd.Series, dim: int = 32) -> pd.Series:
    """A stand-in for an embedding service: a normalised bag of words by CRC32."""
    import zlib

    def one(t: str | None) -> list[float]:
        v = [0.0] * dim
        for w in (t or "").lower().split():
            v[zlib.crc32(w.encode()) % dim] += 1.0
        norm = sum(x * x for x in v) ** 0.5 or 1.0
        return [x / norm for x in v]

    return text.map(one)


def embedding_text(prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.concat_ws("/", "corpus", "rel"), F.lit("\n"), "heading", F.lit("\n\n"), "body")


def vectors_of(text: Column, provider: Callable[[pd.Series], Any]) -> Column:
    """(vec, state) that ``provider`` gives for texts that are not null, on Arrow batches: it maps
    a Series to vectors, or to a frame of vec and state."""

    def run(t: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"vec": pd.Series([None] * len(t), index=t.index, dtype=object), "state": pd.Series([None] * len(t), index=t.index, dtype=object)})
        asked = t[t.notna()]
        if len(asked):
            got = provider(asked)
            if not isinstance(got, pd.DataFrame):
                got = pd.DataFrame({"vec": list(got)}, index=asked.index)
                got["state"] = [EMBEDDED if v is not None else REFUSED for v in got["vec"]]
            out.loc[asked.index, ["vec", "state"]] = got[["vec", "state"]]
        return out

    return F.pandas_udf(run, "vec array<float>, state string")(text)


def embed(chunks: DataFrame, sig: str, provider: Callable[[pd.Series], pd.Series] = hashed_embedding, prefix: str = "") -> DataFrame:
    """(chunk_id, sig, vec) for chunks (chunk_id, corpus, rel, heading, body); ``provider`` maps a
    Series of texts to vectors, null where it fails."""
    ship(chunks.sparkSession)
    return chunks.select("chunk_id", F.lit(sig).alias("sig"), vectors_of(embedding_text(prefix), provider)["vec"].alias("vec")).where("vec is not null")

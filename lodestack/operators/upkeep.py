"""Index upkeep and catalogue: comparing snapshots, carrying vectors over, purging, statistics."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, full: bool = False) -> DataFrame:
    """(corpus, rel, status) over files (corpus, rel, sha256, mtime, size): new, removed,
    unchanged (same time and size, unless ``full``), touched (same content), changed."""
    o = old.select("corpus", "rel", *(F.col(c).alias(f"old_{c}") for c in ("sha256", "mtime", "size")))
    x = new.join(o, ["corpus", "rel"], "full_outer")
    same = (F.col("mtime") == F.col("old_mtime")) & (F.col("size") == F.col("old_size")) & F.lit(not full)
    status = F.when(F.col("old_sha256").isNull(), "new").when(F.col("sha256").isNull(), "removed").when(same, "unchanged").when(F.col("sha256") == F.col("old_sha256"), "touched").otherwise("changed")
    return x.select("corpus", "rel", status.alias("status"))


def carry_over(chunks: DataFrame, old_chunks: DataFrame, vectors: DataFrame, sig: str) -> DataFrame:
    """(chunk_id, sig, vec) of new chunks whose file had a chunk of the same hash with a vector."""
    had = old_chunks.select(F.col("chunk_id").alias("was"), "corpus", "rel", "hash").join(vectors.where(F.col("sig") == sig), F.col("was") == F.col("chunk_id")).groupBy("corpus", "rel", "hash").agg(F.min_by("vec", "was").alias("vec"))
    return chunks.select("chunk_id", "corpus", "rel", "hash").join(had, ["corpus", "rel", "hash"]).select("chunk_id", F.lit(sig).alias("sig"), "vec")


def pending(chunks: DataFrame, vectors: DataFrame, sig: str) -> DataFrame:
    """Chunks without a vector of the signature."""
    return chunks.join(vectors.where(F.col("sig") == sig).select("chunk_id"), "chunk_id", "left_anti")


def purge(rows: DataFrame, present: DataFrame, on: tuple[str, ...] = ("corpus", "rel")) -> DataFrame:
    """Rows whose file is still present."""
    return rows.join(present.select(*on).distinct(), list(on), "left_semi")


def replace_files(rows: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """``rows`` with those of ``changed`` files (corpus, rel) replaced by ``fresh``."""
    return rows.join(changed.select("corpus", "rel").distinct(), ["corpus", "rel"], "left_anti").unionByName(fresh)


def corpus_stats(files: DataFrame, chunks: DataFrame, vectors: DataFrame, sig: str) -> DataFrame:
    """corpus, files, chunks, words, embedded."""
    f = files.groupBy("corpus").agg(F.count("*").alias("files"))
    done = chunks.join(vectors.where(F.col("sig") == sig).select("chunk_id", F.lit(1).alias("has")), "chunk_id", "left")
    c = done.groupBy("corpus").agg(F.count("*").alias("chunks"), F.sum("words").alias("words"), F.count("has").alias("embedded"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return f.join(c, "corpus", "full_outer").select("corpus", *(zero(n) for n in ("files", "chunks", "words", "embedded")))


def status(stats: DataFrame) -> DataFrame:
    """Totals of :func:`corpus_stats` and the share of chunks that are embedded."""
    t = stats.agg(*(F.sum(c).alias(c) for c in ("files", "chunks", "words", "embedded")))
    return t.withColumn("embedded_ratio", F.when(F.col("chunks") > 0, F.round(F.col("embedded") / F.col("chunks"), 3)).otherwise(0.0))


def posting_deltas(old: DataFrame, new: DataFrame, postings: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Signed postings between two states of chunks (chunk_id, hash, ...): sign -1 for what goes and
    1 for what comes.  Chunks whose hash is the same in both are not looked into; ``postings`` is
    called on the others alone."""
    key = ["chunk_id", "hash"]
    gone = postings(old.join(new.select(*key), key, "left_anti")).withColumn("sign", F.lit(-1))
    come = postings(new.join(old.select(*key), key, "left_anti")).withColumn("sign", F.lit(1))
    return gone.union(come)


def with_deltas(post: DataFrame, deltas: Sequence[DataFrame]) -> DataFrame:
    """``post`` (term, chunk_id, tf, ...) with signed deltas in any order, merged by summing signs."""
    cols = post.columns
    rows = reduce(DataFrame.unionByName, deltas, post.withColumn("sign", F.lit(1)))
    return rows.groupBy(*cols).agg(F.sum("sign").alias("sign")).where("sign > 0").select(*cols)


def freq_with_deltas(freq: DataFrame, deltas: Sequence[DataFrame]) -> DataFrame:
    """Document frequencies (term, df) brought up to date by the same deltas, without the postings."""
    rows = reduce(DataFrame.unionByName, (d.select("term", F.col("sign").cast("long").alias("df")) for d in deltas), freq)
    return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


#: What is compared of a file.
COMPARED = ("rel", "sha256", "mtime", "size")


def folder_digests(files: DataFrame) -> DataFrame:
    """A digest tree over files (corpus, rel, sha256, mtime, size): for each folder (a path that ends
    with /, the corpus itself the empty one) its depth, the digest of the files right in it (own)
    and of all below it (whole).  Digests are a count and two sums of 64-bit hashes, which don't
    depend on an order, so folding up the folders is adding."""
    last = F.regexp_extract("rel", r"^(.*/)?", 0)
    number = lambda seed: F.xxhash64(*COMPARED, F.lit(seed)).cast("decimal(20,0)")
    own = files.select("corpus", last.alias("folder"), number(1).alias("a"), number(2).alias("b"))
    sums = [F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")]
    own = own.groupBy("corpus", "folder").agg(*sums)
    steps = F.split(F.regexp_replace("folder", "/$", ""), "/")
    above = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.array_join(F.slice(steps, F.lit(1), i), "/"), F.lit("/")))))
    up = own.select("corpus", "n", "a", "b", F.col("folder").alias("of"), F.posexplode(above).alias("depth", "folder"))
    mine = F.col("of") == F.col("folder")
    total = lambda c, only: F.sum(F.when(mine, F.col(c)) if only else F.col(c)).alias(c)
    return up.groupBy("corpus", "folder", "depth").agg(F.struct(*(total(c, True) for c in "nab")).alias("own"), F.struct(*(total(c, False) for c in "nab")).alias("whole"))


def tree_diff(old: DataFrame, new: DataFrame, old_tree: DataFrame, new_tree: DataFrame) -> DataFrame:
    """As :func:`snapshot_diff`, by digest trees of both states: from the top down a folder is looked
    into only where its digest differs, and only files right in a folder whose own digest differs
    are compared.  (corpus, rel, status, compared).  One join for each level of folders."""
    on = ["corpus", "folder"]
    side = lambda t, x: t.select(*on, F.col("depth").alias(f"{x}_depth"), F.col("own").alias(f"{x}_own"), F.col("whole").alias(f"{x}_whole"))
    both = side(old_tree, "o").join(side(new_tree, "n"), on, "full_outer")
    same = lambda what: F.col(f"o_{what}").eqNullSafe(F.col(f"n_{what}"))
    both = both.select(*on, F.coalesce("o_depth", "n_depth").alias("depth"), (~same("own")).alias("open"), (~same("whole")).alias("deeper"))
    deepest = both.agg(F.max("depth")).first()[0]
    parent = F.regexp_replace("folder", "[^/]+/$", "")
    level = both.where("depth = 0 and deeper")
    opened = level.where("open").select(*on)
    for d in range(1, (deepest or 0) + 1):
        level = both.where(F.col("depth") == d).join(level.select("corpus", F.col("folder").alias("up")), (F.col("up") == parent) & (F.col("depth") == d) & both["corpus"].eqNullSafe(level["corpus"]), "left_semi").where("deeper")
        opened = opened.union(level.where("open").select(*on))
    opened = opened.persist()
    inside = lambda files, how: files.withColumn("folder", F.regexp_extract("rel", r"^(.*/)?", 0)).join(opened, on, how).drop("folder")
    changed = snapshot_diff(inside(old, "left_semi"), inside(new, "left_semi")).withColumn("compared", F.lit(True))
    return changed.union(inside(new, "left_anti").select("corpus", "rel", F.lit("unchanged"), F.lit(False)))


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _lower(s: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in s)


def _ends(spec: str) -> Column:
    return _ascii_lower(F.col("rel")).like("%" + _lower(spec))


def with_tail(files: DataFrame) -> DataFrame:
    """``files`` and ``tail``, the name in lower case from its end: sorted by it, names that end alike
    lie together."""
    return files.withColumn("tail", F.reverse(_ascii_lower(F.col("rel"))))


def find_by_tail(files: DataFrame, spec: str) -> DataFrame:
    """As :func:`find_file`, over :func:`with_tail`: all conditions are comparisons and prefixes that
    a scan can use; of a spec with wildcards that is what follows the last one."""
    drive = len(spec) > 2 and spec[1] == ":" and spec[2] in "/\\"
    if ":" in spec and not drive:
        corpus, _, rel = spec.partition(":")
        return files.where((F.col("corpus") == corpus) & (F.col("rel") == rel)).drop("tail")
    fixed = re.split(r"[%_\\]", spec)[-1]
    start = _lower(fixed)[::-1]
    # a scan for each step, as one condition over all three would not reach it
    ends = F.col("tail").startswith(start) & _ends(spec) if start else _ends(spec)
    steps = (F.col("path") == spec, F.col("rel") == spec, ends)
    hits = reduce(DataFrame.union, (files.where(c).withColumn("level", F.lit(i)) for i, c in enumerate(steps)))
    best = hits.agg(F.min("level").alias("best"))
    return hits.join(F.broadcast(best), F.col("level") == F.col("best")).drop("level", "best", "tail")  # best is one row


def recent(files: DataFrame, chunks: DataFrame, now: Column, days: int = 7, limit: int = 20) -> DataFrame:
    """Files changed within ``days`` before ``now``, newest first, with their chunk counts."""
    new = files.where(F.col("mtime") >= now - F.make_dt_interval(F.lit(days))).orderBy(F.col("mtime").desc(), "corpus", "rel").limit(limit)
    n = chunks.join(F.broadcast(new.select("corpus", "rel")), ["corpus", "rel"]).groupBy("corpus", "rel").agg(F.count("*").alias("chunks"))  # limit rows
    return new.join(n, ["corpus", "rel"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def find_file(files: DataFrame, spec: str) -> DataFrame:
    """Files that ``spec`` names: corpus:rel (and nothing else, if it has that form), else the
    path, else rel, else rel's end (% and _ are wild, ASCII case is ignored)."""
    drive = len(spec) > 2 and spec[1] == ":" and spec[2] in "/\\"
    if ":" in spec and not drive:
        return files.where(F.concat_ws(":", "corpus", "rel") == spec)
    level = F.when(F.col("path") == spec, 1).when(F.col("rel") == spec, 2).when(_ends(spec), 3)
    hits = files.withColumn("level", level).where("level is not null")
    best = hits.agg(F.min("level").alias("best"))
    return hits.join(F.broadcast(best), F.col("level") == F.col("best")).drop("level", "best")  # best is one row

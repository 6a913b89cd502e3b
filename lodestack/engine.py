"""The engine over folders: incremental indexing, search, sections, recent files, status.

An index is a folder of generations and ``manifest.json``.  Files belong to a part
by a hash of their name; each of the tables ``files``, ``chunks``, ``vectors`` and those
of the lexical backend (``postings`` and ``terms``, sorted by term) has a folder for each part,
and the manifest says in which generation that of each part lies.  A run lists the files, opens
those whose time or size is new, and writes only the parts that they change, some parts at a
time; each time the manifest is swapped, so readers never wait and a run that stops half-way
keeps what it finished.  The folder and the corpora must be ones that the driver and the
executors mount; Spark is given them with their scheme, whatever its default file system is.
"""

from __future__ import annotations

import json
import os
import shutil
import socket
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager, suppress
from dataclasses import replace
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as T
from .operators import chunker, sections, upkeep
from .operators import retrieval as R
from .operators.lexical import BACKENDS as LEXICAL
from .sources import config as C
from .sources import files as S
from .sources.embedding import REFUSED, UNREACHED, Probe, Service

FILES = "corpus string, rel string, path string, sha256 string, mtime timestamp, size long"
VECTORS = "chunk_id long, sig string, vec array<float>"
POSTINGS = "term string, chunk_id long, corpus string, words int, tf long, at array<int>"
TERMS = "corpus string, term string, df long"
CHUNKS = chunker.CHUNK_SCHEMA + ", chunk_id long"
SCHEMAS = {"files": FILES, "chunks": CHUNKS, "postings": POSTINGS, "terms": TERMS, "vectors": VECTORS}
STALE_LOCK = 900
#: Parts of a new index: one for so many files, within bounds; ``index_parts`` of the config overrides.
FILES_A_PART, FEWEST, MOST = 500, 4, 4096
#: A chunk's id is its part and, in so many bits, its place there.
PLACE_BITS = 40
#: Up to so many candidates of the lanes are named in the scans of chunks and files.
NAMED = 5_000
#: Parts that are written together; between such groups a run may be stopped.
GROUP = 16
#: So many changed files are opened by name; more are opened by the tasks that hold their rows.
BY_NAME = 2_000


def _alive(pid: int) -> bool:
    if pid <= 0:  # would name a group of processes
        return False
    try:
        os.kill(pid, 0)
    except (ProcessLookupError, OverflowError):
        return False
    except PermissionError:
        return True
    return True


class Lock:
    """A held lock; ``renew`` keeps a long run's from growing old."""

    def __init__(self, path: Path, now: Callable[[], float]):
        self.path, self.now, self.token = path, now, os.urandom(8).hex()

    def text(self) -> str:
        return json.dumps({"pid": os.getpid(), "host": socket.gethostname(), "at": self.now(), "token": self.token})

    def mine(self) -> bool:
        try:
            return json.loads(self.path.read_text()).get("token") == self.token
        except (OSError, ValueError, AttributeError):
            return False

    def renew(self) -> bool:
        """False if another process has taken the lock meanwhile: then nothing more may be written."""
        if not self.mine():
            return False
        new = self.path.with_name(f"writer.lock.{self.token}")
        new.write_text(self.text())
        os.replace(new, self.path)
        return True


@contextmanager
def writer_lock(folder: Path, now: Callable[[], float] = time.time) -> Iterator[Lock | None]:
    """A lock if this process may write, else None: one holder at a time; a holder that is dead
    or has not renewed for ``STALE_LOCK`` seconds is put aside, if it is still the one looked at."""
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / "writer.lock"
    lock, held = Lock(path, now), False
    for _ in range(2):
        try:
            fd = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            seen = None
            try:
                seen = path.read_text()
                other = json.loads(seen)
                here = other.get("host", socket.gethostname()) == socket.gethostname()  # elsewhere a pid says nothing
                stale = (here and not _alive(int(other["pid"]))) or now() - float(other["at"]) > STALE_LOCK
            except FileNotFoundError:
                continue
            except (ValueError, KeyError, TypeError):  # half-written: judged by its age
                with suppress(FileNotFoundError):
                    stale = now() - path.stat().st_mtime > STALE_LOCK
            if not stale:
                break
            aside = folder / f"writer.lock.{lock.token}"
            with suppress(FileNotFoundError):
                os.rename(path, aside)
                if aside.read_text() != seen:  # another process took over in between: back, unless a third holds it
                    with suppress(FileExistsError):
                        os.link(aside, path)
                    aside.unlink()
                    break
                aside.unlink()
            continue
        with os.fdopen(fd, "w") as f:
            f.write(lock.text())
        held = True
        break
    try:
        yield lock if held else None
    finally:
        if held and lock.mine():
            path.unlink(missing_ok=True)


class Stopped(Exception):
    """A group of parts was given up while it was written."""


@contextmanager
def watched(spark: SparkSession, should_stop: Callable[[], bool], every: float) -> Iterator[None]:
    """Jobs that this thread starts in here carry a tag; ``should_stop`` is asked every ``every``
    seconds, and once it says so the tag's jobs are cancelled and :class:`Stopped` is raised."""
    sc, tag = spark.sparkContext, f"lodestack-{os.urandom(8).hex()}"
    done, hit = threading.Event(), threading.Event()

    def watch() -> None:
        while not done.wait(every):
            if should_stop():
                hit.set()
                break
        while hit.is_set() and not done.is_set():  # and jobs that are started meanwhile
            sc.cancelJobsWithTag(tag)
            done.wait(0.2)

    thread = threading.Thread(target=watch, daemon=True)
    sc.addJobTag(tag)
    thread.start()
    try:
        yield
    except Exception:
        if hit.is_set():
            raise Stopped from None
        raise
    finally:
        done.set()
        thread.join()
        sc.removeJobTag(tag)


class Engine:
    """``provider`` maps a Series of texts to vectors; without one there is no vector lane."""

    def __init__(self, spark: SparkSession, config: dict, index: str, provider: Callable[[pd.Series], pd.Series] | None = None, sig: str = "default"):
        self.spark, self.config, self.folder = spark, C.merged(C.DEFAULTS, config), Path(index)
        self.provider, self.sig = provider, sig
        self.probe = Probe(provider) if isinstance(provider, Service) else None
        self.corpora = C.corpora(self.config)
        self.parts = int(self.manifest().get("parts") or self.config.get("index_parts") or 0)
        self.backend = LEXICAL[self.config.get("lexical_backend") or "bm25"]
        self._cached: tuple[tuple, DataFrame] | None = None
        self._lock: Lock | None = None

    # tables

    def manifest(self) -> dict:
        try:
            return json.loads((self.folder / "manifest.json").read_text("utf-8"))
        except FileNotFoundError:
            return {}

    def table(self, name: str, parts: set[int] | None = None) -> DataFrame:
        """A table of the current generation, of all parts or of some."""
        at = self.manifest().get("tables", {}).get(name, {})
        paths = [_uri(self.folder / gen / name / f"part={p}") for p, gen in sorted(at.items()) if parts is None or int(p) in parts]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self._empty(SCHEMAS[name])

    def _empty(self, schema: str) -> DataFrame:
        """No rows, which the optimizer knows: what is joined with them goes from the plan."""
        return self.spark.range(1).where(F.lit(False)).select(*(F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in schema.split(", "))))

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("corpus", "rel"), F.lit(self.parts)).cast("int").alias("part")

    def _sizes(self, corpora: Sequence[str] = ()) -> tuple[int, int, int]:
        """(chunks, words) of all corpora or of some, and embedded chunks of all."""
        parts = self.manifest().get("sizes", {}).values()
        of = [v for p in parts for c, v in p["corpora"].items() if not corpora or c in corpora]
        return sum(n for n, _ in of), sum(w for _, w in of), sum(p["embedded"] for p in parts if p["sig"] == self.sig)

    def available(self, names: Sequence[str] = ()) -> list[C.Corpus]:
        return [c for c in self.corpora if c.enabled and Path(c.root).exists() and (not names or c.name in names)]

    # indexing

    def index(self, full: bool = False, corpora: Sequence[str] = (), if_older_than: float | None = None, should_stop: Callable[[], bool] = lambda: False, progress: Callable[[str], None] = lambda _: None, embed: bool = True, stop_within: float | None = None) -> dict:
        """Bring the index up to date and report counts.  Files of corpora that are disabled or
        whose folder is missing stay; those of corpora no longer configured go, unless a subset
        was asked for.  ``should_stop`` is asked between groups of parts and, if ``stop_within``
        is given, every so many seconds while a group is written, whose jobs are then cancelled;
        the next run does what a stopped run left."""
        began = time.time()
        age = began - self.manifest().get("indexed_at", 0)
        if if_older_than is not None and age < if_older_than:
            return {"skipped": "fresh", "age": age}
        with writer_lock(self.folder) as lock:
            if lock is None:
                return {"skipped": "another process is writing"}
            self._lock = lock
            stop = lambda: should_stop() or not lock.renew()
            within = (stop, stop_within) if stop_within else (lambda: not lock.renew(), STALE_LOCK / 4)
            try:
                return self._index(full, corpora, stop, within, progress, embed, began)
            finally:
                self._lock = None

    def _listed(self, gen: Path, took: list[C.Corpus]) -> DataFrame:
        """Files as they are now, written once: all later steps see these."""
        lists = [S.listing(self.spark, _rooted(c), self.config["max_file_bytes"], tuple(self.config["exclude"])) for c in took]
        empty = self._empty("corpus string, rel string, path string, uri string, mtime timestamp, size long")
        reduce(DataFrame.unionByName, lists, empty).write.parquet(_uri(gen / "listing"))
        return self.spark.read.parquet(_uri(gen / "listing"))

    def _opened(self, gen: Path, took: list[C.Corpus], suspects: DataFrame) -> DataFrame:
        """Contents of ``suspects`` with the hash of just these contents, written once."""
        rows = suspects.select("corpus", "uri").limit(BY_NAME + 1).collect()
        empty = self._empty(FILES + ", text string")
        if not rows:
            return empty
        args = self.config["max_file_bytes"], tuple(self.config["exclude"])
        by_name = {c.name: [r.uri for r in rows if r.corpus == c.name] for c in took}
        try:
            few = len(rows) <= BY_NAME
            found = reduce(DataFrame.unionByName, [S.scan(self.spark, _rooted(c), *args, by_name[c.name]) for c in took if by_name[c.name]], empty) if few else S.opened(suspects)
        except AnalysisException:  # a file has gone since it was listed
            found = S.opened(suspects)
        found.join(suspects.select("corpus", "rel"), ["corpus", "rel"], "left_semi").write.parquet(_uri(gen / "opened"))
        return self.spark.read.parquet(_uri(gen / "opened"))

    def _index(self, full: bool, corpora: Sequence[str], should_stop: Callable[[], bool], within: tuple[Callable[[], bool], float], progress: Callable[[str], None], embed: bool, began: float) -> dict:
        took = self.available(corpora)
        gen = self.folder / f"gen-{time.time_ns()}"
        before = self.manifest()
        in_scope = F.col("corpus").isin([c.name for c in took])
        known = F.lit(True) if corpora else F.col("corpus").isin([c.name for c in self.corpora])
        old = self.table("files")
        now = self._listed(gen, took)
        self.parts = int(before.get("parts") or self.config.get("index_parts") or min(MOST, max(FEWEST, now.count() // FILES_A_PART)))
        first = upkeep.snapshot_diff(old.where(in_scope), now.withColumn("sha256", F.lit("")), full)
        opened = self._opened(gen, took, now.join(first.where("status in ('new', 'touched', 'changed')"), ["corpus", "rel"], "left_semi"))
        same = first.where("status = 'unchanged'").select("corpus", "rel")
        seen = old.join(same, ["corpus", "rel"], "left_semi").select(*_names(FILES)).union(opened.select(*_names(FILES)))
        status = upkeep.snapshot_diff(old.where(in_scope), seen, full)
        gone = old.where(~known).select("corpus", "rel", F.lit("purged").alias("status"))
        status.union(gone).withColumn("part", self._part()).write.parquet(_uri(gen / "diff"))
        diff = self.spark.read.parquet(_uri(gen / "diff"))
        if full:
            diff = diff.withColumn("status", F.when(F.col("status").isin("unchanged", "touched"), "changed").otherwise(F.col("status")))
        counts: dict[str, int] = {}
        dirty = set()
        for r in diff.groupBy("part", "status").count().collect():  # parts times states
            counts[r["status"]] = counts.get(r["status"], 0) + r["count"]
            if r["status"] != "unchanged":
                dirty.add(r["part"])
        sizes = before.get("sizes", {})
        behind = {int(p) for p, v in sizes.items() if v["backend"] != self.backend.name} - dirty
        up, said = self.probe(anew=True) if self.probe and embed else (True, "")
        embeds = bool(self.provider) and embed and up
        if embeds:
            behind |= {int(p) for p, v in sizes.items() if v["sig"] != self.sig or v["embedded"] < sum(n for n, _ in v["corpora"].values())} - dirty
        made = {"new": 0, "refused": 0, "unreached": 0}
        stopped = False
        groups = [(g, True) for g in _groups(dirty)] + [(g, False) for g in _groups(behind)]
        for i, (group, changed) in enumerate(groups):
            if should_stop():
                stopped = True
                break
            own = gen.with_name(f"{gen.name}-{i}")
            try:
                with watched(self.spark, *within):
                    self._write(own, set(group), changed, diff, opened, embeds, made)
            except Stopped:
                shutil.rmtree(own, ignore_errors=True)
                stopped = True
                break
            progress(f"group {i + 1} of {len(groups)}")
        m = self.manifest()
        total, _, embedded = self._sizes()
        report = {
            "files_seen": sum(n for s, n in counts.items() if s not in ("removed", "purged")), "files_indexed": counts.get("new", 0) + counts.get("changed", 0), "files_unchanged": counts.get("unchanged", 0) + counts.get("touched", 0), "files_removed": counts.get("removed", 0) + counts.get("purged", 0),
            "chunks": total, "embeddings_reused": embedded - made["new"], "embeddings_new": made["new"], "embeddings_pending": total - embedded, "embeddings_rejected": made["refused"], "embedding_mode": "disabled" if not self.provider else "skipped" if not embed else "unavailable" if not up else "interrupted" if made["unreached"] else "provider", "embedding_reason": said, "seconds": round(time.time() - began, 2),
        }
        shutil.rmtree(gen, ignore_errors=True)
        if stopped:
            return {"stopped": True} if not i else {"stopped": True, "groups_done": i, **report}
        self._swap({**m, "indexed_at": time.time(), "generation": m.get("generation") or gen.name, "parts": self.parts, "report": report})
        return report

    def _write(self, gen: Path, group: set[int], changed: bool, diff: DataFrame, opened: DataFrame, embeds: bool, made: dict) -> None:
        """A generation of the tables of some parts, then the manifest that names it."""
        here = diff.where(F.col("part").isin(list(group)))
        stale = here.where("status <> 'unchanged' and status <> 'touched'").select("corpus", "rel")
        old_chunks, old_vectors = self.table("chunks", group), self.table("vectors", group)

        def write(df: DataFrame, name: str, *order: str) -> DataFrame:
            df.repartition("part").sortWithinPartitions("part", *order).write.option("parquet.block.size", 8 << 20).partitionBy("part").parquet(_uri(gen / name))
            return self.spark.read.schema(df.schema).parquet(_uri(gen / name))

        if changed:
            size = self.config["chunk"]
            fresh = chunker.chunk_files(opened.join(here.where("status in ('new', 'changed')"), ["corpus", "rel"], "left_semi"), size["min_words"], size["target_words"], size["max_words"])
            kept = old_chunks.join(stale, ["corpus", "rel"], "left_anti").select(*_names(chunker.CHUNK_SCHEMA))
            every = kept.union(fresh.select(*_names(chunker.CHUNK_SCHEMA))).withColumn("part", self._part())
            # numbered in their part by file and place, so that an id says where its chunk lies
            nth = F.row_number().over(Window.partitionBy("part").orderBy("corpus", "rel", "ordinal"))
            chunks = write(every.withColumn("chunk_id", F.shiftleft(F.col("part").cast("long"), PLACE_BITS) + nth), "chunks", "chunk_id")
            gone = here.where("status <> 'unchanged'").select("corpus", "rel")
            still = opened.join(here.where("status in ('new', 'changed', 'touched')"), ["corpus", "rel"], "left_semi").select(*_names(FILES))
            write(self.table("files", group).join(gone, ["corpus", "rel"], "left_anti").select(*_names(FILES)).union(still).withColumn("part", self._part()), "files", "corpus", "rel")
        else:
            chunks = old_chunks.withColumn("part", self._part())
        known = self.manifest().get("sizes", {})
        lexical = changed or any(known[str(p)]["backend"] != self.backend.name for p in group if str(p) in known)
        if lexical:  # a run for vectors alone leaves them as they are
            post = write(self.backend.postings(chunks).select("part", *_names(POSTINGS)), "postings", "term")
            write(post.groupBy("part", "corpus", "term").agg(F.count("*").alias("df")), "terms", "term")
        carried = upkeep.carry_over(chunks, old_chunks, old_vectors, self.sig).select(*_names(VECTORS))
        vectors = chunks.join(carried.drop("sig"), "chunk_id", "left").withColumn("fresh", F.col("vec").isNull())
        seen = Observation()
        if embeds:
            S.ship(self.spark)
            vectors = vectors.withColumn("made", S.vectors_of(F.when(F.col("fresh"), S.embedding_text()), self.provider)).withColumn("vec", F.coalesce("vec", "made.vec"))
            vectors = vectors.observe(seen, *(F.count_if(F.col("made.state") == x).alias(x) for x in (REFUSED, UNREACHED)))
        vectors = write(vectors.where("vec is not null").select("part", "chunk_id", F.lit(self.sig).alias("sig"), "vec", "fresh"), "vectors", "chunk_id")
        for x in (REFUSED, UNREACHED) if embeds else ():
            made[x] += seen.get[x]
        embedded = {}
        for r in vectors.groupBy("part").agg(F.count("*").alias("n"), F.count_if("fresh").alias("fresh")).collect():
            embedded[r["part"]] = r["n"]
            made["new"] += r["fresh"]
        tokens = {int(p): v["tokens"] for p, v in known.items()}
        if lexical and self.backend.counts_tokens:
            tokens = {r["part"]: r["n"] for r in post.groupBy("part").agg(F.sum("tf").alias("n")).collect()}
        sizes: dict[str, dict] = {}
        for r in chunks.groupBy("part", "corpus").agg(F.count("*").alias("n"), F.sum("words").alias("words")).collect():  # corpora of some parts
            v = sizes.setdefault(str(r["part"]), {"corpora": {}, "embedded": embedded.get(r["part"], 0), "sig": self.sig, "backend": self.backend.name, "tokens": tokens.get(r["part"], 0)})
            v["corpora"][r["corpus"]] = [r["n"], int(r["words"] or 0)]
        m = self.manifest()
        tables = m.get("tables", {})
        for name in ("vectors", *(("postings", "terms") if lexical else ()), *(("chunks", "files") if changed else ())):
            at = {p: g for p, g in tables.get(name, {}).items() if int(p) not in group}
            tables[name] = at | {x.name.partition("=")[2]: gen.name for x in (gen / name).glob("part=*")}
        all_sizes = {p: v for p, v in m.get("sizes", {}).items() if int(p) not in group} | sizes
        self._swap({**m, "generation": gen.name, "parts": self.parts, "tables": tables, "sizes": all_sizes})

    def _swap(self, manifest: dict) -> None:
        """Make ``manifest`` the current one; of older generations those that it or the one before
        it names stay, as readers may still be at work on them."""
        before = self.manifest()
        new = self.folder / f"manifest.{os.getpid()}"
        new.write_text(json.dumps(manifest), "utf-8")
        if self._lock and not self._lock.mine():  # a group took so long that another process writes now
            new.unlink()
            raise RuntimeError("the writer's lock was lost; what this run wrote last is left out")
        os.replace(new, self.folder / "manifest.json")
        used = {g for m in (before, manifest) for at in m.get("tables", {}).values() for g in at.values()}
        running = manifest.get("generation", "").rsplit("-", 1)[0]
        for x in self.folder.glob("gen-*"):
            if x.name not in used and not x.name.startswith(running):
                shutil.rmtree(x, ignore_errors=True)

    # questions

    def _vectors(self) -> DataFrame:
        """(id, vec) of the current signature, kept in memory and on disk until the index changes."""
        key = (self.manifest().get("generation"), self.sig)
        if self._cached is None or self._cached[0] != key:
            if self._cached:
                self._cached[1].unpersist()
            rows = self.table("vectors").where(F.col("sig") == self.sig).select(F.col("chunk_id").alias("id"), "vec")
            self._cached = key, rows.persist(StorageLevel.MEMORY_AND_DISK) if self.config["search"].get("cache_vectors", True) else rows
        return self._cached[1]

    def hits(self, queries: Sequence[str], corpora: Sequence[str] = (), k: int = 6, mode: str = "auto", vectors: Sequence[Sequence[float]] | None = None) -> DataFrame:
        """Hits of many queries in one job (query_id: place in ``queries``), from the stored
        postings: of these and the terms only those of the queries' terms are read."""
        opts = self.config["search"]
        k = k or opts["k"]
        wanted = F.col("term").isin(sorted({t for q in queries for t in self.backend.terms(q)}))
        covered = self.spark.createDataFrame([(i, T.stemmed_terms(q)) for i, q in enumerate(queries)], "query_id int, terms array<string>")
        n, words, _ = self._sizes(corpora)
        every, tokens = self._sizes()[0], sum(v["tokens"] for v in self.manifest().get("sizes", {}).values())
        pool = R.pool_of(k)
        lexical = self.backend.rank(self.table("postings").where(wanted), self.table("terms").where(wanted), n, words, tokens, every, list(enumerate(queries)), pool, corpora)
        near = None
        if vectors is not None and mode != "lexical":
            qv = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "query_id int, vec array<float>")
            vec = self._vectors()
            if corpora:
                mine = self.table("chunks").where(F.col("corpus").isin(*corpora)).select(F.col("chunk_id").alias("id"))
                vec = vec.join(mine, "id", "left_semi")
            near = R.knn(vec, qv, max(20, k))
        found = R.candidates(lexical, near)
        chunks, stamps = self.table("chunks"), self.table("files")
        if len(queries) * 2 * pool <= NAMED:
            # the candidates' ids say in which parts they lie: nothing else is read of chunks and files
            rows = found.collect()  # at most two pools for each query
            found = self.spark.createDataFrame(rows, found.schema)
            ids = sorted({r["id"] for r in rows})
            parts = {i >> PLACE_BITS for i in ids}
            chunks, stamps = self.table("chunks", parts).where(F.col("chunk_id").isin(ids)), self.table("files", parts)
        hits = R.fused(found, chunks, covered, k, opts["per_file"], near is not None, opts["rrf_k"], ("corpus", "rel", "path", "title"), len(queries))
        stamps = stamps.select("corpus", "rel", "mtime")
        return hits.join(stamps, ["corpus", "rel"], "left").withColumn("modified", F.date_format("mtime", "yyyy-MM-dd")).drop("mtime")

    def search(self, query: str, corpora: Sequence[str] = (), k: int = 6, mode: str = "auto") -> dict:
        began = time.time()
        note, qv = None, None
        total, _, done = self._sizes()
        if mode != "lexical" and self.provider:
            if not done:
                note = "the index has no embeddings yet"
            else:
                try:
                    v, why = self.provider.question(query) if self.probe else (self.provider(pd.Series([query]))[0], "")
                    if v is None:
                        raise ValueError(why or "no vector came")
                    qv = [v]
                    note = f"embeddings cover {done}/{total} chunks" if done < total else None
                except Exception as e:  # noqa: BLE001 - a provider may fail in any way; the lexical lane answers
                    note = f"the query could not be embedded: {e}"
        if mode == "hybrid" and qv is None:
            note = "; ".join(filter(None, [note, "hybrid was asked for, the answer is lexical"]))
        embedded = time.time()
        shown = self.hits([query], corpora, k, mode, qv).withColumn("snippet", T.snippet(F.col("body"), T.query_terms(query))).drop("body", "query_id")
        rows = [r.asDict() for r in shown.orderBy("place").collect()]  # k rows at most
        top = {c: rows[0][c] if rows else 0.0 for c in ("lexical_coverage", "vec_weight")}
        took = {"embed": round(embedded - began, 3), "search": round(time.time() - embedded, 3), "total": round(time.time() - began, 3)}
        return {"query": query, "mode": "lexical" if qv is None else "hybrid", "lexical_backend": self.backend.name, "note": note, "corpora": list(corpora) or "all", "k": k, **top, "hits": rows, "timings": took}

    def get(self, spec: str, heading: str | None = None, max_chars: int = 20_000) -> dict:
        """A section of the file as it is now; only files below an enabled corpus are read."""
        rows = upkeep.find_file(self.table("files"), spec).orderBy("corpus", "rel").limit(20).collect()
        if len(rows) != 1:
            refs = [f"{r.corpus}:{r.rel}" for r in rows]
            return {"error": f"{spec!r} names more than one file", "candidates": refs} if refs else {"error": f"no file is called {spec!r}"}
        (r,) = rows
        real = Path(r.path).resolve()
        roots = [Path(c.root).resolve() for c in self.corpora if c.enabled and c.name == r.corpus]
        if not any(real == x or x in real.parents for x in roots):
            return {"error": f"{spec!r} is outside the enabled corpora"}
        try:
            text = real.read_bytes().decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
        except OSError as e:
            return {"error": f"{spec!r} can't be read: {e.strerror}"}
        meta, parts = sections.sections(text)
        return {"ref": f"{r.corpus}:{r.rel}", "path": r.path, "title": sections.title(meta, parts, r.rel), **sections.section_text(text, heading, max_chars)}

    def recent(self, corpus: str | None = None, days: float = 7, limit: int = 20, now: float | None = None) -> list[dict]:
        files = self.table("files")
        since = datetime.fromtimestamp((time.time() if now is None else now) - days * 86_400, timezone.utc)
        rows = upkeep.recent(files.where(F.col("corpus") == corpus) if corpus else files, self.table("chunks"), F.lit(since), 0, limit)
        shown = rows.orderBy(F.col("mtime").desc(), "corpus", "rel").select("corpus", F.concat_ws(":", "corpus", "rel").alias("ref"), "path", F.date_format("mtime", "yyyy-MM-dd HH:mm").alias("modified"), "chunks", "size")
        return [r.asDict() for r in shown.collect()]

    def status(self, probe: bool = True) -> dict:
        m = self.manifest()
        up, said = self.probe() if self.probe and probe else (None, "")
        of = {"embedder_available": up, "embedder_url": self.provider.url, "embedder_model": self.provider.model} if self.probe else {}
        stats = upkeep.corpus_stats(self.table("files"), self.table("chunks"), self.table("vectors"), self.sig)
        per = {r.corpus: r.asDict() for r in stats.collect()}  # a row for each corpus
        total = {c: sum(r[c] or 0 for r in per.values()) for c in ("files", "chunks", "words", "embedded")}
        share = round(total["embedded"] / total["chunks"], 3) if total["chunks"] else 0.0
        named = [{"name": c.name, "root": c.root, "description": c.description, "enabled": c.enabled, "available": c.enabled and Path(c.root).exists(), **per.get(c.name, {})} for c in self.corpora]
        age = round(time.time() - m["indexed_at"], 1) if m else None
        return {"index": str(self.folder), "generation": m.get("generation"), "age_seconds": age, "corpora": named, **total, "embedded_ratio": share, "embedder": bool(self.provider), **of, "embedder_note": said, "lexical_backend": self.backend.name, "config_hint": self.config.get("_paths", {}).get("user", "the configuration"), "last_report": m.get("report")}


def _uri(path: Path) -> str:
    return f"file://{os.path.abspath(path)}"


def _rooted(corpus: C.Corpus) -> C.Corpus:
    return replace(corpus, root=_uri(Path(corpus.root)))


def _groups(parts: set[int]) -> list[list[int]]:
    every = sorted(parts)
    return [every[i : i + GROUP] for i in range(0, len(every), GROUP)]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]

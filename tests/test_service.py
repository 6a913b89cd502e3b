"""Indexing a folder again and again, the writer lock, JSON-RPC and the command line."""

import io
import json
import os

import pytest

from lodestack import service
from lodestack.engine import STALE_LOCK, Engine, writer_lock
from lodestack.sources.files import hashed_embedding

NOTE = "# Kiln log\nHow the kiln is fired.\n\n## Faults\nCool the glaze slowly.\n"


@pytest.fixture
def engine(spark, tmp_path):
    root = tmp_path / "kb"
    root.mkdir()
    (root / "alpha.md").write_text(NOTE)
    (root / "beta.txt").write_text("second text on clay")
    return Engine(spark, {"corpora": [{"name": "kb", "root": str(root)}]}, str(tmp_path / "index"), hashed_embedding)


def test_index_is_incremental_and_questions_are_answered(engine, tmp_path):
    root = tmp_path / "kb"
    first = engine.index()
    assert (first["files_indexed"], first["chunks"], first["embeddings_new"], first["embeddings_pending"]) == (2, 2, 2, 0)
    again = engine.index()
    assert (again["files_indexed"], again["files_unchanged"], again["embeddings_reused"], again["embeddings_new"]) == (0, 2, 2, 0)
    assert engine.index(if_older_than=3600)["skipped"] == "fresh"
    found = engine.search("glaze slowly")
    assert found["mode"] == "hybrid" and found["hits"][0]["ref"] == "kb:alpha.md" and "glaze" in found["hits"][0]["snippet"]
    assert engine.search("clay", mode="lexical")["hits"][0]["title"] == "beta"
    assert engine.get("alpha.md", "faults")["text"] == "## Faults\nCool the glaze slowly."
    assert "error" in engine.get("nowhere.md")
    assert {r["ref"] for r in engine.recent(days=1)} == {"kb:alpha.md", "kb:beta.txt"} and engine.recent(days=1, now=4e9) == []
    (root / "beta.txt").unlink()
    (root / "alpha.md").write_text(NOTE.replace("glaze", "slip"))
    third = engine.index()
    assert (third["files_indexed"], third["files_removed"], third["chunks"]) == (1, 1, 1)
    assert engine.status()["files"] == 1 and engine.search("glaze", mode="lexical")["hits"] == []
    generation = engine.manifest()["generation"]
    assert engine.index(full=True, should_stop=lambda: True) == {"stopped": True} and engine.manifest()["generation"] == generation


def test_links_out_of_a_corpus_are_not_read(engine, tmp_path):
    engine.index()
    (tmp_path / "kb-other").mkdir()
    (tmp_path / "kb-other/x.txt").write_text("secret")
    (tmp_path / "kb/beta.txt").unlink()
    os.symlink(tmp_path / "kb-other/x.txt", tmp_path / "kb/beta.txt")
    assert "outside" in engine.get("kb:beta.txt")["error"]


def test_writer_lock(tmp_path):
    with writer_lock(tmp_path) as one, writer_lock(tmp_path) as two:
        assert one and not two
    assert not (tmp_path / "writer.lock").exists()
    (tmp_path / "writer.lock").write_text(json.dumps({"pid": 2**22 + 1, "at": 0}))
    with writer_lock(tmp_path) as dead:
        assert dead
    (tmp_path / "writer.lock").write_text(json.dumps({"pid": os.getpid(), "at": 100.0}))
    with writer_lock(tmp_path, lambda: 101.0) as young:
        assert not young
    with writer_lock(tmp_path, lambda: 101.0 + STALE_LOCK) as old:
        assert old


def test_rpc(engine):
    engine.index()
    lines = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {"protocolVersion": "2024-11-05"}},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        [{"jsonrpc": "2.0", "id": 2, "method": "tools/list"}, {"jsonrpc": "2.0", "id": 3, "method": "nothing"}],
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "glaze", "mode": "lexical"}}},
        {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "glaze", "corpora": ["none"]}}},
        {"jsonrpc": "2.0", "id": 6, "method": "tools/call", "params": {"name": "status"}},
    ]
    sink = io.StringIO()
    service.Service(engine).serve([*(json.dumps(x) for x in lines), "{bad", ""], sink)
    a = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert a[0]["result"]["protocolVersion"] == "2024-11-05" and len(a) == 6
    assert len(a[1][0]["result"]["tools"]) == 5 and a[1][1]["error"]["code"] == -32601
    assert "kb:alpha.md" in a[2]["result"]["content"][0]["text"] and not a[2]["result"]["isError"]
    assert a[3]["result"]["isError"] and "2 chunks" not in a[3]["result"]["content"][0]["text"]
    assert "embedded: 2 of 2" in a[4]["result"]["content"][0]["text"] and a[5]["error"]["code"] == -32700


def test_command_line(spark, engine, tmp_path):
    conf = tmp_path / "c.json"
    conf.write_text(json.dumps({"corpora": {"kb": {"path": str(tmp_path / "kb")}}}))

    def run(*argv):
        sink = io.StringIO()
        code = service.main(["--config", str(conf), "--index", str(tmp_path / "cli"), *argv], spark, (), sink)
        return code, sink.getvalue()

    assert json.loads(run("index")[1])["files_indexed"] == 2
    assert "kb:beta.txt" in run("search", "clay")[1] and run("get", "none")[0] == 1
    assert "kb" in json.loads(run("config")[1])["corpora"]


def test_unchanged_files_are_not_opened_and_only_changed_parts_are_written(engine, tmp_path, monkeypatch):
    from lodestack import engine as module

    engine.index()
    before = engine.manifest()["tables"]["chunks"]
    opened = []
    scan = module.S.scan
    monkeypatch.setattr(module.S, "scan", lambda *a: opened.append(a) or scan(*a))
    assert engine.index()["files_unchanged"] == 2 and not opened
    (tmp_path / "kb/beta.txt").write_text("third text on [glaze] and clay")
    report = engine.index()
    assert len(opened) == 1 and [u.rsplit("/", 1)[1] for u in opened[0][4]] == ["beta.txt"]
    assert (report["files_indexed"], report["embeddings_new"], report["embeddings_reused"]) == (1, 1, 1)
    after = engine.manifest()["tables"]["chunks"]
    assert sum(after[p] != g for p, g in before.items()) == 1 and len(before) == 2
    os.utime(tmp_path / "kb/beta.txt", (1e9, 1e9))
    assert engine.index()["files_indexed"] == 0 and engine.recent(days=1)[0]["ref"] == "kb:alpha.md"


def test_a_stopped_run_keeps_finished_groups(engine, tmp_path, monkeypatch):
    monkeypatch.setattr("lodestack.engine.GROUP", 1)
    asked = []
    got = engine.index(should_stop=lambda: len(asked) == 1 or asked.append(1))
    assert got["stopped"] and got["groups_done"] == 1 and got["chunks"] == 1
    assert "indexed_at" not in engine.manifest()
    assert engine.index()["files_indexed"] == 1 and engine.status()["chunks"] == 2


def test_a_run_stops_within_a_group(engine, tmp_path):
    """The jobs of the group that is being written are cancelled; the next run completes it."""
    import time

    from lodestack.engine import Engine

    def slow(texts):
        time.sleep(60)
        return hashed_embedding(texts)

    began, asked = time.time(), []
    lazy = Engine(engine.spark, engine.config, str(tmp_path / "index"), slow)
    got = lazy.index(should_stop=lambda: bool(asked) and time.time() - began > 6 or bool(asked.append(1)), stop_within=0.5)
    assert got == {"stopped": True} and time.time() - began < 50
    assert not engine.manifest() and not list((tmp_path / "index").glob("gen-*")) and not (tmp_path / "index/writer.lock").exists()
    assert engine.index()["files_indexed"] == 2 and engine.status()["embedded"] == 2


def test_a_lock_is_renewed_while_a_group_is_written(spark):
    import time

    from lodestack.engine import Stopped, watched

    asked = []
    with watched(spark, lambda: bool(asked.append(1)), 0.05):
        time.sleep(0.5)
    assert len(asked) > 2
    with pytest.raises(ValueError), watched(spark, lambda: False, 60):
        raise ValueError
    with pytest.raises(Stopped), watched(spark, lambda: True, 0.05):
        spark.range(4).selectExpr("java_method('java.lang.Thread', 'sleep', 20000L)").collect()
        time.sleep(0.5)
        spark.range(4).collect()
    assert spark.range(4).count() == 4


def test_many_changed_files_are_opened_by_tasks(engine, tmp_path, monkeypatch):
    """Only these are opened, and what is stored is what opening by name stores."""
    from lodestack import engine as module

    rows = lambda t: sorted(tuple(r) for r in engine.table(t).collect())
    (tmp_path / "kb/odd.txt").write_bytes(b"bad \xff byte\r\nand line")
    engine.index()
    want = rows("files"), rows("chunks")
    monkeypatch.setattr(module, "BY_NAME", 0)
    monkeypatch.setattr(module.S, "scan", lambda *a: pytest.fail("read by name"))
    monkeypatch.setattr(module.S, "OPEN_BYTES", 1)
    assert engine.index()["files_unchanged"] == 3
    engine.index(full=True)
    assert (rows("files"), rows("chunks")) == want
    listed = engine._listed(tmp_path / "index" / "look", engine.available())
    (tmp_path / "kb/odd.txt").unlink()
    assert {r.rel for r in module.S.opened(listed).collect()} == {"alpha.md", "beta.txt"}


def test_folders_keep_their_scheme(engine):
    """Where Spark's default file system is another one."""
    conf = engine.spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "hdfs://nowhere.invalid:1")
    try:
        assert engine.index()["files_indexed"] == 2
        assert engine.search("clay", mode="lexical")["hits"][0]["path"].startswith("/")
    finally:
        conf.set("fs.defaultFS", before)


def test_backend_switch_rebuilds_the_lexical_tables(engine, spark, tmp_path):
    engine.index(embed=False)
    assert engine.status()["embedded"] == 0 and engine.search("clay")["note"] == "the index has no embeddings yet"
    other = Engine(spark, {**engine.config, "lexical_backend": "fields"}, str(tmp_path / "index"))
    assert other.index()["files_indexed"] == 0
    found = other.search("cooling the glazes")
    assert found["lexical_backend"] == "fields" and found["hits"][0]["ref"] == "kb:alpha.md" and found["hits"][0]["bm25"] is not None
    assert other.search("glazing")["hits"] and not other.search("glazing", corpora=["none"])["hits"]
    many = other.hits(["clay", "glaze", "zzz"]).collect()
    assert {(r.query_id, r.rel) for r in many} == {(0, "beta.txt"), (1, "alpha.md")}


def test_an_answer_reads_the_candidates_alone(engine, monkeypatch):
    """Chunks and files of the candidates' parts, and of these the chunks that are named."""
    engine.index()
    engine.config["search"]["cache_vectors"] = False
    ask = lambda: engine.hits(["slowly"])
    plan = ask()._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("FileScan parquet")[1:]]
    assert len(scans) == 2 and all("InMemoryFileIndex(1 paths)" in x for x in scans)  # of two parts
    assert "EqualTo(chunk_id," in scans[0] or "In(chunk_id," in scans[0]
    named = ask().collect()
    monkeypatch.setattr("lodestack.engine.NAMED", 0)
    assert ask().collect() == named and named


def test_ids_say_where_chunks_lie(engine):
    from lodestack.engine import PLACE_BITS

    engine.index()
    rows = engine.table("chunks").withColumn("part", engine._part()).collect()
    assert len({r.chunk_id for r in rows}) == len(rows) and all(r.chunk_id >> PLACE_BITS == r.part for r in rows)
    assert {r.chunk_id for r in engine.table("vectors").collect()} == {r.chunk_id for r in rows}


def test_a_lost_lock_keeps_the_manifest(engine):
    """Another process takes the lock while a group is written: its manifest isn't overwritten."""
    engine.index()
    before = engine.manifest()
    engine._lock = type("Lost", (), {"mine": lambda self: False})()
    with pytest.raises(RuntimeError, match="lock was lost"):
        engine._swap({**before, "generation": "mine"})
    assert engine.manifest() == before


def test_an_answer_takes_five_scans(engine, monkeypatch):
    monkeypatch.setattr("lodestack.engine.NAMED", 0)
    engine.index()
    engine.config["search"]["cache_vectors"] = False
    plan = engine.hits(["glaze slowly"], vectors=[hashed_embedding(__import__("pandas").Series(["glaze"]))[0]])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 5  # postings, terms, chunks, vectors, and files for the dates
    assert "In(term, [glaze,slowly])" in plan


def test_background_refresh(engine, tmp_path):
    engine.index()
    s = service.Service(engine)
    assert not s.refresh("off")
    engine.config["auto_index_minutes"] = 1
    assert not s.refresh("fresh")
    engine._swap({**engine.manifest(), "indexed_at": 0})
    (tmp_path / "kb/new.md").write_text("# New\nslip")
    assert s.refresh("old")
    s.worker.join()
    assert s.last_run["trigger"] == "old" and s.last_run["files_indexed"] == 1


def test_lock_holds_while_renewed_and_is_left_when_lost(tmp_path):
    clock = [0.0]
    with writer_lock(tmp_path, lambda: clock[0]) as one:
        clock[0] = STALE_LOCK - 1
        assert one.renew()
        clock[0] = 2 * STALE_LOCK - 10
        with writer_lock(tmp_path, lambda: clock[0]) as two:
            assert two is None
        clock[0] = 4 * STALE_LOCK
        with writer_lock(tmp_path, lambda: clock[0]) as three:
            assert three and not one.renew()
            assert three.renew()
    (tmp_path / "writer.lock").write_text(json.dumps({"pid": 10**30, "host": "elsewhere", "at": clock[0]}))
    with writer_lock(tmp_path, lambda: clock[0]) as far:
        assert far is None  # its pid can't be judged from here
    clock[0] += 2 * STALE_LOCK
    for pid in (0, -1, 10**30):
        (tmp_path / "writer.lock").write_text(json.dumps({"pid": pid, "at": clock[0]}))
        with writer_lock(tmp_path, lambda: clock[0]) as four:
            assert four
    assert not list(tmp_path.glob("writer.lock*"))


def test_configuration_order(tmp_path, monkeypatch):
    from lodestack.sources import config as C

    for name, k in (("env", 1), ("user", 2), ("example", 3), ("extra", 4)):
        (tmp_path / name).write_text(json.dumps({"search": {"k": k}, "corpora": {"a": {"path": "~/x", "description": "d"}}}))
    at = lambda n: tmp_path / n
    monkeypatch.delenv("LODESTACK_CONFIG", raising=False)
    assert C.resolve(None, at("user"), at("example"))["search"] == {"k": 2, "per_file": 3, "rrf_k": 20}
    assert C.resolve(None, at("none"), at("example"))["_paths"]["source"] == "example" and C.resolve(None, at("none"), at("no"))["_paths"]["source"] == "builtin"
    monkeypatch.setenv("LODESTACK_CONFIG", str(at("env")))
    monkeypatch.setenv("LODESTACK_INDEX", "/i")
    assert C.resolve(None, at("user"), at("example"))["search"]["k"] == 1
    got = C.resolve(str(at("extra")), at("user"), at("example"))
    assert got["search"]["k"] == 4 and got["index_path"] == "/i" and C.corpora(got)[0].root == os.path.expanduser("~/x") and C.corpora(got)[0].description == "d"
    assert C.init_user(at("new/c.json"), at("example")) == (at("new/c.json"), True) and C.init_user(at("new/c.json"))[1] is False

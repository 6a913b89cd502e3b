"""The jobs: runs over growing input, a batch done again, the command line, their SQL."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from jobs import common, live_index, saved_searches, sql
from lodestack.operators import retrieval as R

ROOT = Path(__file__).resolve().parents[1]
INPUT = "doc_id long, text string, lang string, source string, n_chars long"


def put(spark, folder, rows):
    """One more file with rows (doc_id, text, lang, source)."""
    spark.createDataFrame([(*r, 0) for r in rows], INPUT).coalesce(1).write.mode("append").parquet(str(folder))


def settings(tmp_path, **more):
    return {"input": str(tmp_path / "in"), "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "mark"), **more}


def postings_of(spark, docs):
    """What the index should hold for documents key -> (text, lang, source), made in one go."""
    rows = [(k, lang, f"{source}/{k}", "", text, len(text.split())) for k, (text, lang, source) in docs.items()]
    chunks = spark.createDataFrame(rows, "chunk_id string, corpus string, rel string, heading string, body string, words long")
    return {(r.chunk_id, r.term, r.tf, r.words, r.corpus) for r in R.postings(chunks, also=("corpus", "words")).collect()}


def held(spark, s):
    return {tuple(r) for r in live_index.current(spark, s["output"]).select("doc", "term", "tf", "words", "corpus").collect()}


def raw(spark, s):
    return sorted(tuple(r) for n in ("docs", "postings") for r in live_index.read(spark, s["output"], n).select("batch", "sign", "doc", "words").collect())


def test_index_grows_with_its_input(spark, tmp_path):
    """New, changed, moved, repeated and emptied documents over four runs."""
    s = settings(tmp_path)
    docs = {"1": ("kiln firing notes", "en", "a"), "2": ("ton und glasur", "de", "a"), "3": ("shared words words", "en", "b")}
    put(spark, tmp_path / "in", [(1, "kiln firing notes", "en", "a"), (2, "ton und glasur", "de", "a"), (3, "shared words words", "en", "b"), (4, None, None, None), (4, None, None, None)])
    assert live_index.run(spark, s) == {"batches": 1, "rows": 5}
    docs["4"] = ("", "none", "none")
    assert held(spark, s) == postings_of(spark, docs)

    before = raw(spark, s)
    assert live_index.run(spark, s) == {"batches": 0, "rows": 0}  # nothing is new
    assert raw(spark, s) == before

    put(spark, tmp_path / "in", [(1, "kiln cooling notes", "en", "a"), (2, "ton und glasur", "de", "a"), (3, "shared words words", "fr", "b"), (5, "fresh", "en", "c"), (None, "no id", "en", "c")])
    assert live_index.run(spark, s) == {"batches": 1, "rows": 5}
    import hashlib

    lost = "sha256:" + hashlib.sha256(b"no id").hexdigest()
    docs |= {"1": ("kiln cooling notes", "en", "a"), "3": ("shared words words", "fr", "b"), "5": ("fresh", "en", "c"), lost: ("no id", "en", "c")}
    assert held(spark, s) == postings_of(spark, docs)
    # document 2 came again unchanged: no rows of the second batch are its own
    assert not live_index.read(spark, s["output"], "docs").where("batch = 1 and doc = '2'").count()
    assert {tuple(r) for r in live_index.read(spark, s["output"], "docs").where("sign = -1").select("doc", "since", "batch").collect()} == {("1", 0, 1), ("3", 0, 1)}

    # a version of the first run returns, another is emptied, and a version of the second run goes
    put(spark, tmp_path / "in", [(1, "kiln firing notes", "en", "a"), (5, "", "en", "c"), (2, "a", "de", "a"), (2, "a", "de", "a")])
    live_index.run(spark, s)
    docs |= {"1": ("kiln firing notes", "en", "a"), "5": ("", "en", "c"), "2": ("a", "de", "a")}
    assert held(spark, s) == postings_of(spark, docs)
    now = live_index.present(live_index.read(spark, s["output"], "docs"))
    assert {r.doc: r.since for r in now.collect()} == {"1": 2, "2": 2, "3": 1, "4": 0, "5": 2, lost: 1}


def test_a_batch_that_was_cut_off_is_done_again(spark, tmp_path):
    s = settings(tmp_path, max_files_per_batch=1)
    for i in range(3):
        put(spark, tmp_path / "in", [(j, f"text {i} of {j}", "en" if j % 2 else "de", "s") for j in range(i, i + 4)])
    assert live_index.run(spark, s)["batches"] == 3
    want, now = raw(spark, s), held(spark, s)
    assert now == postings_of(spark, {str(j): (f"text {min(j, 2)} of {j}", "en" if j % 2 else "de", "s") for j in range(6)})
    os.remove(tmp_path / "mark/commits/2")  # as if the driver had gone before the last commit
    for crc in (tmp_path / "mark/commits").glob(".2.crc"):
        crc.unlink()
    shutil.rmtree(tmp_path / "out/docs/batch=2")  # and half of what it wrote
    live_index.run(spark, s)
    assert raw(spark, s) == want and held(spark, s) == now


def odd_rows():
    words = "kiln glaze firing clay slip wheel bisque cone stoneware raku".split()
    rows = [(i, " ".join(words[(i * k) % 10] for k in range(1, 2 + i % 9)) + "\n" * (i % 3) + " é" * (i % 40), ["en", "de", "", None][i % 4], ["a", "b", "c", None][i % 3]) for i in range(120)]
    return [*rows, (200, None, "en", "a"), (201, "", None, None), (202, "Kiln  firing " * 5_000, "en", "a"), (None, "kiln", "en", "a"), (203, "raku", "en", "a"), (204, "raku", "en", "a")]


def odd_searches():
    return [(1, "the kiln firing"), (2, None), (3, ""), (4, "raku raku stoneware cones"), (5, "nothing there"), (6, "é glazed, clay!"), (None, "kiln")]


def written_searches(spark, tmp_path):
    put(spark, tmp_path / "docs", odd_rows())
    spark.createDataFrame(odd_searches(), "item_id long, text string").write.parquet(str(tmp_path / "asked"))
    return {"documents": str(tmp_path / "docs"), "searches": str(tmp_path / "asked"), "output": str(tmp_path / "hits")}


def test_saved_searches_equal_their_sql_and_run_again(spark, tmp_path):
    s = written_searches(spark, tmp_path)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(odd_rows(), columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"}))
    con.register("benchmark", pd.DataFrame(odd_searches(), columns=["item_id", "text"]).astype({"item_id": "Int64"}))
    rel = con.sql(sql.JOB2)
    want = sorted(rel.fetchall())
    assert len(want) > 15
    for _ in range(2):
        assert saved_searches.run(spark, s) == {"hits": len(want)}
        assert sorted(map(tuple, saved_searches.read(spark, s["output"]).select(*rel.columns).collect())) == want
    assert {p.name for p in (tmp_path / "hits").glob("corpus=*")} == {f"corpus={c}" for c in {r[-1] for r in want}}
    only = {**s, "corpora": ["de"], "k": 2}
    saved_searches.run(spark, only)  # replaces what other corpora had
    assert {p.name for p in (tmp_path / "hits").glob("corpus=*")} == {"corpus=de"}


def test_index_equals_its_sql(spark, tmp_path):
    s = settings(tmp_path)
    put(spark, tmp_path / "in", [*odd_rows(), (7, "again another text", "en", "a")])
    live_index.run(spark, s)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([*odd_rows(), (7, "again another text", "en", "a")], columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"}))
    rel = con.sql(sql.JOB1)
    got = live_index.read(spark, s["output"], "postings").select(*rel.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())


def test_empty_tables(spark, tmp_path):
    s = settings(tmp_path)
    put(spark, tmp_path / "in", [])
    live_index.run(spark, s)
    put(spark, tmp_path / "in", [(1, "late text", "en", "a")])
    live_index.run(spark, s)
    assert {r[1] for r in held(spark, s)} == {"late", "text", "en"}
    none = spark.createDataFrame([], INPUT)
    asked = spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert saved_searches.answers(none, asked, 10, 3, 50, []).count() == 0


def test_config_and_command_line(spark, tmp_path):
    s = written_searches(spark, tmp_path)
    (tmp_path / "c.json").write_text(json.dumps({"k": 2, "output": s["output"]}))
    assert common.read_config(spark, str(tmp_path / "c.json"), saved_searches.DEFAULTS)["k"] == 2
    (tmp_path / "bad.json").write_text('{"kk": 2}')
    with pytest.raises(ValueError, match="kk"):
        common.read_config(spark, str(tmp_path / "bad.json"), saved_searches.DEFAULTS)
    call = [sys.executable, "-m", "jobs.saved_searches", "--config", str(tmp_path / "c.json"), "--documents", s["documents"], "--searches", s["searches"], "--corpora", "de", "en"]
    done = subprocess.run(call, cwd=ROOT, capture_output=True, text=True, timeout=300, check=True)
    n = json.loads(done.stdout.strip().splitlines()[-1])["hits"]
    rows = saved_searches.read(spark, s["output"]).collect()
    assert n == len(rows) > 0 and max(r.place for r in rows) == 2 and {r.corpus for r in rows} <= {"de", "en"}
    assert f"{n} hits written to" in done.stderr

"""The engine's operators on small fixtures, and the SQL of its queries on the test tables."""

import os

import plain_chunker
import pytest
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import chunker, sections, upkeep
from lodestack.operators import retrieval as R
from lodestack.plans import queries as Q
from lodestack.sources import config, files
from lodestack.streaming import inbox

NOTE = "# Kiln log\nHow the kiln is fired.\n\n## Setup\nStack bricks.\n```\n# not a heading\n```\n## Faults\n### Cracks\nCool slowly.\n"


def test_small_sections_merge_into_one_chunk():
    _, parts, found = plain_chunker.chunks(NOTE)
    assert [s.path for s in parts] == [("Kiln log",), ("Kiln log", "Setup"), ("Kiln log", "Faults"), ("Kiln log", "Faults", "Cracks")]
    assert [(c["heading"], c["line_start"], c["line_end"]) for c in found] == [("Kiln log", 1, 11)]


def test_frontmatter_and_titles():
    text = '---\nname: kiln\ndescription: "Firing notes"\n  nested: no\n---\nplain body\n'
    meta, parts, (c,) = plain_chunker.chunks(text)
    assert meta == {"name": "kiln", "description": "Firing notes"} and c["heading"] == "Firing notes" and c["line_start"] == 6
    assert plain_chunker.title(meta, parts, "a/b.md") == "kiln" and plain_chunker.title({}, [], "a/b.md") == "b"
    assert sections.frontmatter(["---", "a: b"]) == ({}, 0)


@pytest.mark.parametrize(("line", "heading"), [("# C#", "C"), ("# #", "#"), ("### a ##", "a"), (" # no", None), ("#no", None)])
def test_heading_lines(line, heading):
    _, parts = sections.sections(line)
    assert parts[0].heading == (heading or "")


def test_fences_toggle_whatever_their_mark():
    _, parts = sections.sections("```\n# a\n~~~\n# b\n```\n# c")
    assert [s.heading for s in parts] == ["", "b"]


def test_long_text_splits_at_paragraphs_and_lines():
    para = "\n".join(" ".join(f"w{i}x{j}" for i in range(10)) for j in range(12))
    _, _, found = plain_chunker.chunks(f"# T\n\n## S\n\n{para}\n\n{para}\n\nshort end\n", max_words=100, target_words=90)
    assert all(c["words"] <= 100 for c in found) and len(found) >= 3
    assert sum(c["words"] for c in found) == len(f"# T ## S {para} {para} short end".split())
    _, _, one = plain_chunker.chunks(" ".join(["w"] * 900))
    assert [c["words"] for c in one] == [900]


def test_section_text():
    got = sections.section_text(NOTE, "faults", 1000)
    assert got["text"].startswith("## Faults") and "Cool slowly." in got["text"] and not got["truncated"]
    assert "error" in sections.section_text(NOTE, "nothing", 10)


def test_terms():
    assert T.query_terms("the rate-limit per site") == ["rate", "limit", "per", "site"]
    assert T.query_terms("the a an") == ["the", "a", "an"]
    assert T.stemmed_terms("ponies boxes glass running used the used") == ["pony", "boxe", "glass", "runn", "used"]


def test_stem_column_equals_driver(spark):
    words = ["ponies", "boxes", "glass", "running", "used", "dies", "bing", "seed", "as", "walked"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(T.light_stem(F.col("w"))).collect()]
    assert got == [T.stemmed_terms(w)[0] if T.stemmed_terms(w) else w for w in words]


def test_fusion_order(spark):
    lane = lambda ids: spark.createDataFrame([(1, i, -float(n)) for n, i in enumerate(ids)], "query_id int, id long, score double")
    rows = R.rrf([(lane([1, 2, 3]), F.lit(1.0)), (lane([2, 4]), F.lit(1.0))]).orderBy("rank").collect()
    assert rows[0].id == 2 and (rows[0].rank_1, rows[0].rank_2) == (2, 1) and rows[1].id == 1
    rows = R.rrf([(lane([1, 2, 3]), F.lit(1.0)), (lane([2, 4]), F.lit(0.0))]).orderBy("rank").collect()
    assert [r.id for r in rows][:3] == [1, 2, 3]


def test_normalize(spark):
    (r,) = spark.range(1).select(T.normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("a"), T.normalize(F.array(F.lit(0.0))).alias("z")).collect()
    assert r.a == [0.6, 0.8] and r.z == [0.0]


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"_note": 1, "chunk": {"max_words": 9, "_x": 2}, "corpora": {"a": {"path": "/x"}, "-bad": {"root": "/y"}}}')
    c = config.load(str(tmp_path / "none"), str(p))
    assert c["chunk"] == {"min_words": 60, "target_words": 500, "max_words": 9} and "_note" not in c
    assert [x.name for x in config.corpora(c)] == ["a"]


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "kb"
    (root / "private").mkdir(parents=True)
    (root / "alpha.md").write_text(NOTE)
    (root / "plain.txt").write_bytes(b"one \xff line\r\nsecond glaze line")
    (root / "private/secret.md").write_text("# secret")
    (root / "skip.bin").write_text("x")
    return root


def test_scan_index_and_search(spark, folder, tmp_path):
    corpus = config.Corpus("kb", str(folder), exclude=("private/**",))
    found = files.scan(spark, corpus)
    assert {r.rel: r.text for r in found.collect()}["plain.txt"] == "one � line\nsecond glaze line"
    assert {r.rel for r in found.collect()} == {"alpha.md", "plain.txt"}
    rows = chunker.chunk_files(found).withColumn("chunk_id", F.xxhash64("corpus", "rel", "ordinal"))
    files.write_index(rows, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    vec = files.embed(index, "crc").select(F.col("chunk_id").alias("id"), "vec")
    asked = spark.createDataFrame([(1, T.stemmed_terms("glaze line"))], "query_id int, terms array<string>")
    qv = spark.createDataFrame([(1, files.hashed_embedding(__import__("pandas").Series(["glaze line"]))[0])], "query_id int, vec array<float>")
    hits = R.search(index, R.postings(index), asked, vec, qv).orderBy("place").collect()
    assert hits[0].ref == "kb:plain.txt" and hits[0].lex_rank == 1 and hits[0].lexical_coverage == 1 and hits[0].vec_weight == 0.2
    lexical = R.search(index, R.postings(index), asked, mode="lexical").collect()
    assert [h.vec_rank for h in lexical] == [None] * len(lexical)


def test_find_file(spark):
    f = spark.createDataFrame([("n", "beta.md", "/r/beta.md"), ("n", "x/a.md", "/r/x/a.md")], "corpus string, rel string, path string")
    names = lambda spec: sorted(r.rel for r in upkeep.find_file(f, spec).collect())
    assert names("n:beta.md") == ["beta.md"] and names("n:none") == [] and names("/r/x/a.md") == ["x/a.md"]
    assert names("a.md") == ["beta.md", "x/a.md"] and names("x/a.md") == ["x/a.md"] and names("B%.md") == ["beta.md"]


def test_inbox(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    run = lambda: inbox.chunk_inbox(spark, str(folder), "kb", out, str(tmp_path / "state")).awaitTermination(120)
    run()
    assert spark.read.parquet(out).where("rel = 'alpha.md'").count() == 1
    deep = folder / "more" / str(folder).strip("/")  # the folder's own path below itself
    deep.mkdir(parents=True)
    (deep / "alpha.md").write_text("# Another\nof that name")
    run()
    assert {r.rel for r in spark.read.parquet(out).where("rel like '%alpha.md'").collect()} == {"alpha.md", f"more/{str(folder).strip('/')}/alpha.md"}


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
@pytest.mark.parametrize("name", ["bm25_topk", "rrf_fuse", "snapshot_diff", "corpus_stats", "snippet", "chunk_documents", "chunk_headed", "hybrid_search"])
def test_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "events"):
        con.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    got = Q.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    want = con.sql(f"select {', '.join(cols)} from ({Q.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, want))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test tables are absent")
def test_every_twentieth_vector_asks_all(spark):
    import duckdb

    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.sql(f"create view embeddings as from '{sf}/embeddings.parquet'")
    got = Q.queries()["vector_batch_all"](spark, sf)
    assert got.columns == ["query_id", "id", "score"] and got.schema["query_id"].dataType.simpleString() == "int"
    rows = sorted(tuple(r) for r in got.collect())
    assert len({q for q, _, _ in rows}) == 100
    assert rows == sorted(con.sql(f"select query_id, id, score from ({Q.oracle_sql()['vector_batch_all']})").fetchall())


def test_blocks_equal_all_pairs(spark, monkeypatch):
    import random

    monkeypatch.setattr(R, "VECTOR_BLOCK", 16)
    rng = random.Random(4)
    same = [0.5] * 6
    v = [(i, same if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(6 if i % 5 else 4)]) for i in range(150)] + [(900, None), (901, [])]
    df = spark.createDataFrame(v, "id long, vec array<float>")
    q = df.where("id % 20 = 0").select(F.col("id").cast("int").alias("query_id"), "vec")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(R.knn_blocks(df, q, 5)) == rows(R.knn(df, q, 5))
    assert rows(R.knn_blocks(df.limit(0), q, 5)) == [] == rows(R.knn_blocks(df, q.limit(0), 5))


def test_excerpts(spark):
    """By hand: a quarter of the limit before the first term, from the next word on if there is one."""
    long = "x" * 500 + "kiln" + "y" * 100
    rows = [(1, long), (2, "  kiln\n\tfired  "), (3, "w " * 100 + "the kiln " + "z " * 100), (4, "q" * 300)]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, t string").select("i", T.snippet(F.col("t"), ["kiln"], 100).alias("s")).collect()}
    assert got[1] == "..." + "x" * 25 + "kiln" + "y" * 71 + "..."
    assert got[2] == "kiln fired"
    # the term is at 204, a quarter of the limit before it is 179, the space before that 177: 178 to 277
    assert got[3] == "..." + "w " * 11 + "the kiln " + "z " * 34 + "z" + "..."
    assert got[4] == "q" * 100 + "..."

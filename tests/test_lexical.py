"""The field-weighted backend against a full-text table of SQLite; Porter's stems against its tokenizer."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestack.functions.porter import porter
from lodestack.operators.lexical import Fields, Light

WORDS = (
    "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli "
    "differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference "
    "airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll is by ion yes bee geology possibly "
    "queen rating beeing skies dying added agreement nation oats created university generically ssses eeds seeing"
).split()


def fts(rows):
    try:
        c = sqlite3.connect(":memory:")
        c.execute("create virtual table t using fts5(heading, body, path, tokenize='porter unicode61')")
    except sqlite3.Error:
        pytest.skip("SQLite lacks full-text tables")
    c.executemany("insert into t(rowid, heading, body, path) values (?, ?, ?, ?)", rows)
    return c


def test_stems():
    c = fts([(i, "", w, "") for i, w in enumerate(WORDS, 1)])
    c.execute("create virtual table v using fts5vocab(t, instance)")
    want = {d: t for t, d in c.execute("select term, doc from v")}
    assert [porter(w) for w in WORDS] == [want[i] for i in range(1, len(WORDS) + 1)]


def test_ranks_as_a_full_text_table(spark):
    bodies = ["the rate limit per site is a limit", "rates limited per sites", "limit the rate", "Café glazes, cafe\u0301s", "nothing here", "rate", "a site limiting rates of sites"] * 2
    heads = ["Rate limits", "", "Sites", "", "glaze", "", "x > rate limit per"] * 2
    corpora = ["a"] * 7 + ["b"] * 7
    rels = [f"n{i}/rate_{i % 3}.md" for i in range(14)]
    chunks = spark.createDataFrame([(0, i + 1, corpora[i], rels[i], heads[i], b, len(b.split())) for i, b in enumerate(bodies)], "part int, chunk_id long, corpus string, rel string, heading string, body string, words int")
    c = fts([(i + 1, heads[i], b, f"{corpora[i]}/{rels[i]}") for i, b in enumerate(bodies)])
    post = Fields.postings(chunks).cache()
    tokens = post.agg(F.sum("tf")).first()[0]
    queries = ["rate limit per", "glaze", "cafe", "cafe\u0301 glaze", "the limit of sites", "the", "zzz"]
    got = {}
    for r in Fields.rank(post, None, 0, 0, tokens, 14, list(enumerate(queries)), 40).collect():
        got.setdefault(r.query_id, {})[r.id] = r.score
    some = {r.id: r.score for r in Fields.rank(post, None, 0, 0, tokens, 14, [(0, queries[0])], 40, ["b"]).collect()}
    from lodestack.functions import text as T
    from lodestack.operators.lexical import raw_words

    for i, q in enumerate(queries):
        parts = [f'"{t}"' for t in T.query_terms(q, raw_words(q))] + ([f'"{" ".join(raw_words(q))}"'] if len(raw_words(q)) > 1 else [])
        want = {d: round(-s, 6) for d, s in c.execute("select rowid, bm25(t, 2.0, 1.0, 0.5) from t where t match ?", [" OR ".join(parts)])}
        assert got.get(i, {}).keys() == want.keys()
        assert all(abs(got[i][d] - s) < 2e-6 for d, s in want.items())
    assert some == {d: s for d, s in got[0].items() if d > 7}


def test_light_backend_equals_plain_bm25(spark):
    from lodestack.operators import retrieval as R

    chunks = spark.createDataFrame([(0, i, "ab"[i % 2], f"f{i}.md", "", t, len(t.split())) for i, t in enumerate(["kiln glaze", "glaze glaze slip", "clay", "kilns and clay", ""])], "part int, chunk_id long, corpus string, rel string, heading string, body string, words int")
    post = Light.postings(chunks).cache()
    terms = post.groupBy("corpus", "term").agg(F.count("*").alias("df"))
    queries = spark.createDataFrame([(0, ["kiln", "glaze"]), (1, ["clay"])], "query_id int, terms array<string>")
    for corpora in ((), ("a",)):
        of = chunks.where(F.col("corpus").isin(*corpora)) if corpora else chunks
        n, words = of.agg(F.count("*"), F.sum("words")).first()
        got = Light.rank(post, terms, n, words, 0, 0, [(0, "kiln glaze"), (1, "clay")], 5, corpora)
        want = R.bm25(R.postings(chunks), chunks, queries, 5, corpora)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_phrases_against_plain_python(spark):
    """Repeated words in a phrase, words of many places, phrases at a field's end, absent words."""
    import random

    from lodestack.operators import phrases as P

    rng = random.Random(8)
    docs = {i: ([rng.choice("abc") for _ in range(rng.randrange(4))], [rng.choice("aaabbcdefg") for _ in range(rng.randrange(60))]) for i in range(200)}
    chunks = spark.createDataFrame([(i, "xy"[i % 2], h, b) for i, (h, b) in docs.items()], "chunk_id long, corpus string, h array<string>, b array<string>").repartition(3)
    post = P.postings(chunks, [F.col("h"), F.col("b")], ("corpus",)).cache()
    asked = [(1, [["a"], ["a", "a", "b"]]), (2, [["c", "d"], ["g", "a", "g"], ["zz", "a"]]), (3, []), (4, [["b", "a", "b", "a"]])]
    terms = post.groupBy("term").agg(F.count("*").alias("df"))
    for t in (None, terms):
        got = {(r.query_id, r.phrase, r.chunk_id): sorted(r.starts) for r in P.found(post, asked, t).collect()}
        want = {}
        for i, ps in asked:
            for j, p in enumerate(ps):
                for d, fields in docs.items():
                    at = [k + f * P.GAP for f, ws in enumerate(fields) for k in range(len(ws) - len(p) + 1) if ws[k : k + len(p)] == p]
                    if at:
                        want[i, j, d] = at
        assert got == want


def test_names_of_backends():
    from lodestack.operators.lexical import BACKENDS

    assert BACKENDS["python"] is Light and BACKENDS["fts5"] is BACKENDS["auto"] is Fields

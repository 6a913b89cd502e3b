"""The source divergence audit against plain Python and its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pyarrow as pa
import pytest

from lodestack.llm import source_divergence as D

KEY = lambda r: tuple((x is None, x) for x in r)


def plain_audit(rows, min_docs, top):
    upper = {c: c + 32 for c in range(65, 91)}
    count, df, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(upper))
        count[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
        langs[lang or ""].add(source or "")
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        all_ = Counter()
        for s in sources:
            all_.update(count[lang, s])

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(all_)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items, 1)]
    return sorted(out, key=KEY)


def corpus():
    rng = random.Random(11)
    words = ["the", "The", "THE", "été", "ÉTÉ", "naïve", "x", "漢字", "🎉a", *(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100))]
    rows = []
    for _ in range(500):
        s = min(int(rng.expovariate(0.25)), 17)
        some = words[: 9 + s * 5] if s % 2 else words[s * 3 :]
        rows.append((" ".join(rng.choice(some) for _ in range(rng.randrange(30))) + rng.choice(["", "1", "_", "-x"]), rng.choice(["en", "de", None]), f"src{s}" if s else None))
    return [*rows, *rows[:40], (None, "en", "nul"), ("", "en", "nul"), ("42 _-", "zz", "only"), ("", "zz", "two"), ("rare words here", "zz", "é"), ("the " * 60_000 + "漢字", "en", "src1"), ("", None, None)]


@pytest.mark.parametrize(("block", "share", "tile"), [(256, 4, 512), (4, 4, 8), (3, 10**6, 16), (5, 1, 10**6)])
def test_audit_against_plain_python(spark, monkeypatch, block, share, tile):
    """With several blocks of groups and tiles of terms; all terms heavy; nearly all light."""
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "HEAVY_SHARE", share)
    monkeypatch.setattr(D, "TILE", tile)
    if block == 4:  # nothing is broadcast
        monkeypatch.setattr(D, "BROADCAST_GROUPS", 0)
        monkeypatch.setattr(D, "BROADCAST_BLOCKS", 0)
    rows = corpus()
    df = spark.createDataFrame([(i, *r, 7, "k") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, g int, term string").repartition(6)
    got = D.audit(df, 5, 12)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect()), key=KEY) == plain_audit(rows, 5, 12)


def test_empty_table_and_nothing_kept(spark):
    df = spark.createDataFrame([("a b", "en", "s"), ("", "en", "t")], "text string, lang string, source string")
    assert D.audit(df.where("lang = 'no'")).count() == 0
    assert sorted(map(tuple, D.audit(df).collect())) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_sql_equals(spark, monkeypatch):
    rows = corpus()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["text", "lang", "source"]))
    want = con.sql(D.OP11_SQL).select("lang, source, part, item, value, rank").fetchall()
    got = D.audit(spark.createDataFrame(rows, "text string, lang string, source string")).collect()
    assert sorted(map(tuple, got), key=KEY) == sorted(want, key=KEY)


def test_long_texts_are_counted_in_slices(monkeypatch):
    """Slices end between words, and full dictionaries are handed on."""
    monkeypatch.setattr(D, "SLICE", 7)
    monkeypatch.setattr(D, "FLUSH", 3)
    texts = ["alpha beta, gamma Été été unbrokenwordoverslices x" * 3, "beta"]
    rb = pa.record_batch({"lang": ["en", "en"], "source": ["s", "s"], "text": texts})
    n, df = Counter(), Counter()
    for out in D._count(iter([rb])):
        for r in out.to_pylist():
            n[r["term"]] += r["n"]
            df[r["term"]] += r["df"]
    want = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.replace("É", "É").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    assert +n == Counter(want[0] + want[1])
    assert df["beta"] == 2 and df["été"] == 1


def test_shares_are_exact_beyond_64_bits(spark):
    big = 10**13
    got = spark.range(1).select(D.share(D.F.lit(big), D.F.lit(3 * big + 7), D.F.lit(11))).first()[0]
    assert got == 1 + 10**9 * (big + 5) // (3 * big + 7 + 55)

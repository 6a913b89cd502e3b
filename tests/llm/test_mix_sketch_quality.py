"""Mixing, fingerprints and the classifier on small tables."""

import base64
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestack.llm import fm_quality, scaled_sketch, source_mix

ROWS = [
    (1, "a b c d e f g h", "s1"), (2, None, "s1"), (3, "", None), (4, " \n\t", "s2"), (5, "one", None), (6, "x y " * 300, "big"), (7, "a b c d e f g h", "s1"),
    (8, "ein Wort é 漢字 🎉", "s2"), (None, "no id here", "s1"), (5, "twice the id", "big"), (7, "a b c d e f g h", "s1"), (12, "!!! ### $$", "ztail"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, source string, size int, score string").repartition(3)


def test_targets_are_reshared(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), (None, 5), ("c", 100)], "source string, size long")
    got = {r.source: (r.weight, r.target) for r in source_mix.source_targets(sized, source_mix.ramped((1, 2, 3))).collect()}
    assert got["a"] == (1, 30) and got["b"][0] == 2 and got["c"] == (3, 300) and got[None] == (1, 15)
    assert abs(sum(t for _, t in got.values()) - 1115) < 1e-9


def test_mix_fills_targets(docs):
    rows = source_mix.plan_mix(docs, source_mix.ramped((1, 2, 3))).collect()
    assert len(rows) == len(ROWS)
    taken, target = {}, {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"] and all(0 < s.position <= 1 for s in r.slots)
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
        target[r.source_size] = r.target
    assert all(abs(taken[k] - target[k]) <= 1 for k in target)
    again = source_mix.plan_mix(docs.repartition(7), source_mix.ramped((1, 2, 3))).collect()  # reruns agree
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_positions_follow_the_schedule(spark):
    """A source whose weight falls to zero gives most of its words early."""
    df = spark.createDataFrame([(i, "w " * 10, "a") for i in range(200)], "doc_id long, text string, source string")
    rows = source_mix.plan_mix(df, [[(0.0, 2.0), (1.0, 0.0)]]).collect()
    pos = sorted(s.position for r in rows for s in r.slots)
    want = [1 - (1 - (i + 0.5) / 200) ** 0.5 for i in range(200)]
    assert np.allclose(pos, want, atol=1e-9)


def test_one_id_of_many_rows_is_cut(spark, monkeypatch):
    """Rows of one doc_id, and copies, fall into many ranges, and what is taken is as ever."""
    from lodestack.llm import _common

    monkeypatch.setattr(_common, "RANGE_ROWS", 40)
    rows = [(7, f"text {i} " * (i % 5 + 1), "a") for i in range(400)] + [(7, "the same words", "a")] * 400 + [(i, "w " * (i % 7), "b") for i in range(200)] + [(None, "none", None)] * 90 + [(1, "long " * 50_000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    made, ranged = [], source_mix.ranged
    monkeypatch.setattr(source_mix, "ranged", lambda *a: made.append(ranged(*a)) or made[-1])
    plan = source_mix.plan_mix(df, source_mix.ramped((1, 2, 3))).collect()
    sizes = [r["count"] for r in made[0].groupBy(_common.RANGE).count().collect()]
    assert sum(sizes) == len(rows) == len(plan) and len(sizes) > 15 and max(sizes) < 120
    taken, of = {}, {}
    for r in plan:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source_size], of[r.source_size] = taken.get(r.source_size, 0) + r.taken, r.target
    assert len(of) == 3 and all(abs(taken[k] - of[k]) <= 1 for k in of)
    again = source_mix.plan_mix(df.repartition(3), source_mix.ramped((1, 2, 3))).collect()
    assert sorted(map(str, again)) == sorted(map(str, plan))


def test_mixed_keeps_columns_and_order(docs):
    out = source_mix.mixed(docs, source_mix.ramped((1, 2, 3)))
    assert out.columns == docs.columns and out.count() > 0


def test_mixed_gives_equal_rows_plans_of_their_own(spark):
    """What a mix takes of repeated rows is what their plans say together."""
    rows = [(1, "a b c d e f g h", "s", 1)] * 3 + [(i, f"w{i} " * (i % 9 + 1), "t" if i % 3 else "s", 2) for i in range(2, 40)] + [(None, "x y", "u", 3)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, kept int").repartition(3)
    cycle = source_mix.ramped((1, 2, 3))
    want = {}
    for r in source_mix.plan_mix(df, cycle).collect():
        for s in r.slots:
            if 2 * s.words >= r["size"]:
                want[r.doc_id] = want.get(r.doc_id, 0) + 1
    for _ in range(2):
        got = {}
        for r in source_mix.mixed(df, cycle).collect():
            got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert got == want


def test_mix_equals_sql(spark, docs):
    frame = pd.DataFrame([(d, t, s) for d, t, s in ROWS if d is not None and (d, t) != (7, "a b c d e f g h")], columns=["doc_id", "text", "source"]).drop_duplicates("doc_id")
    frame["doc_id"] = frame["doc_id"].astype("int64")
    con = duckdb.connect()
    con.register("documents", frame)
    want = con.sql(source_mix.OP1_SQL).fetchall()
    df = spark.createDataFrame(frame)
    plan = source_mix.plan_mix(df, source_mix.ramped((1, 2, 3))).collect()
    assert {(r.doc_id, r.taken) for r in plan} == {(r[0], r[4]) for r in want}


def brute_sketch(text, fraction=scaled_sketch.FRACTION):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_edited_and_next(docs):
    got = scaled_sketch.compare_edited(docs).collect()
    order = sorted([(d if d is not None else 1 << 62, t or "") for d, t, _ in ROWS])
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, (d, t) in enumerate(order):
        nxt = [x for x in order if x[0] > d] or order
        if len([x for x in order if x[0] == d]) > 1 or len([x for x in order if x[0] == nxt[0][0]]) > 1:
            continue
        n = nxt[0][1]
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        (r,) = by[None if d == 1 << 62 else d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if t == n:
            assert r.near_next == 1
    prints = {}
    for (d, t), rs in ((o, by[None if o[0] == 1 << 62 else o[0]]) for o in order):
        if len(rs) == 1:
            assert prints.setdefault(t, rs[0].fingerprint) == rs[0].fingerprint
            assert (rs[0].fingerprint == "") == (not t.split())


def test_sketch_estimates(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    a = " ".join(rng.choice(words, 3000))
    b = " ".join(a.split()[:1500] + list(rng.choice(words, 1500)))
    import pyarrow as pa

    s = scaled_sketch.Sketches(*scaled_sketch.V.buffers(pa.array([a, b, " ".join(a.split()[:700])])))
    common = s.common(np.array([0, 0]), s, np.array([1, 2]))
    x, y = brute_sketch(a), brute_sketch(b)
    assert abs(scaled_sketch.likeness(common[:1], s.sizes[:1], s.sizes[1:2])[0] - len(x & y) / len(x | y)) < 0.05
    assert scaled_sketch.containment(common[1:], s.sizes[:1], s.sizes[2:3])[0] == 1
    one, two = scaled_sketch.Sketches(*scaled_sketch.V.buffers(pa.array(["a b c d e f", "b c d e f g"]))).strings()
    assert scaled_sketch.merge(one, two) in (one, two) or len(base64.b64decode(scaled_sketch.merge(one, two))) % 4 == 0


def test_one_and_no_document(spark):
    lone = spark.createDataFrame([(3, "a b c d e f")], "doc_id long, text string")
    (r,) = scaled_sketch.compare_edited(lone).collect()
    assert r.near_next == 1
    empty = lone.where("doc_id < 0")
    assert scaled_sketch.compare_edited(empty).count() == 0
    assert source_mix.plan_mix(empty.selectExpr("*", "'a' as source"), source_mix.ramped((1,))).count() == 0
    assert fm_quality.score(empty, fm_quality.fit([])).count() == 0


def test_classifier(spark, docs):
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"], 40)) for _ in range(300)]
    bad = [" ".join(f"{w}###" for w in rng.choice(["alpha", "beta", "gamma"], 40)) for _ in range(300)]
    rows = [(i, t, int(i < 300)) for i, t in enumerate(good + bad)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    m = fm_quality.train(df, labels, max_rows=200)
    out = fm_quality.score(df, m).select("doc_id", fm_quality.held_out(fm_quality.F.col("doc_id")).alias("h"), "score", "predicted").collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([r.predicted == int(r.doc_id < 300) for r in out if r.h]) > 0.98
    scored = fm_quality.score(docs, m)
    assert scored.count() == len(ROWS) and all(0 <= r.score <= 1 for r in scored.collect())
    assert scored.columns == ["doc_id", "text", "source", "size", "score", "predicted"]


def test_repeated_ids_leave_room_for_others(spark, monkeypatch):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"text of {i}") for i in ids] + [(ids[0], f"again {k}") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    got = []
    monkeypatch.setattr(fm_quality, "fit", got.extend)
    fm_quality.train(df, labels, max_rows=len(ids))
    assert [label for label, _, _ in got] == [i % 2 for i in ids]


def test_sum_of_squares_identity():
    rng = np.random.default_rng(2)
    m = fm_quality.Machine(0.1, rng.normal(size=fm_quality.SIZE), rng.normal(size=(fm_quality.SIZE, 3)))
    col, val = np.array([3, 9, 77, 500]), np.array([1.0, -2.0, 0.5, 3.0])
    want = 0.1 + m.weight[col] @ val + sum(m.factor[col[i]] @ m.factor[col[j]] * val[i] * val[j] for i in range(4) for j in range(i))
    assert abs(m.raw(np.array([0, 4]), col, val)[0][0] - want) < 1e-9

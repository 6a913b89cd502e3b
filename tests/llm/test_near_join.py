"""The join against all pairs, and components against a plain search."""

import random
import re

import pytest

from lodestack.llm import near_join
from lodestack.llm._components import components


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(12):
        words = [rng.choice(vocab) for _ in range(rng.choice([60, 120, 300]))]
        for _ in range(rng.choice([1, 2, 6, 25])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append(" ".join(copy))
    rows += ["one two", "one two", "", " ", None, "one  two", "a b c d e", "a b c d e f"]
    rng.shuffle(rows)
    return [*enumerate(rows), (None, rows[3]), (4, rows[4])]


@pytest.mark.parametrize("block", [512, 4])
def test_against_all_pairs(spark, block):
    rows = corpus(1)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, class_id string").repartition(4)
    got = {(r.key, r.tag): r for r in near_join.near_duplicates(df, block=block).collect()}
    key = lambda d: near_join.LAST_ID if d is None else d
    sets = {}
    for d, t in rows:
        sets.setdefault(shingles(t), set()).add(key(d))
    reps = [(min(ds), s) for s, ds in sets.items() if s]
    links = {r: {q for q, u in reps if q != r and len(s & u) / len(s | u) >= 0.8} for r, s in reps}
    assert sum(map(len, links.values())) > 40
    root = {}
    for r in sorted(links):
        if r not in root:
            todo = [r]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = r
                    todo += links[x]
    by = {}
    for (k, _), r in got.items():
        by.setdefault(k, r)
    for d, t in rows:
        r, s = by[key(d)], shingles(t)
        if s:
            rep = min(sets[s])
            assert (r.class_id, r.n_links) == (root[rep], len(links[rep])), (d, t)
        else:
            assert (r.class_id, r.n_links, r.n_copies) == (key(d), 0, 1)
    kept = near_join.keep_first(df, block=block)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect() if shingles(r.text)]
    assert sorted(set(ids)) == sorted(set(root.values()))


@pytest.mark.parametrize("block", [512, 2])
def test_null_and_repeated_ids(spark, block):
    words = lambda name, *swaps: " ".join("x" if i in swaps else f"{name}{i}" for i in range(100))
    rows = [
        *((None, words("a", *s)) for s in ((), (3,), (97,))),  # near copies, all without id
        (7, words("b")), (None, words("b", 98)),  # one near a document with an id
        *((None, words(n)) for n in "cdefgh"),  # unrelated
        *[(None, words("i"))] * 3,  # exact copies without id
        (9, words("j")), (9, words("j", 50)), (9, words("k")), (9, words("k")),  # an id of several texts
        (None, ""), (None, ""), (None, None),
    ]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, lang string").repartition(5)
    kept = [(r.doc_id, r.text) for r in near_join.keep_first(df, block=block).collect()]
    assert sum(t in {words("a", *s) for s in ((), (3,), (97,))} for _, t in kept) == 1
    assert sum(t in {words("j"), words("j", 50)} for _, t in kept) == 1
    rest = [(d, t) for d, t in kept if not t or t[0] not in "aj"]
    key = lambda r: (r[0] or 0, r[1] is None, r[1] or "")
    assert sorted(rest, key=key) == sorted([(7, words("b")), (9, words("k")), *((None, words(n)) for n in "cdefghi"), (None, ""), (None, ""), (None, None)], key=key)
    got = sorted((r.class_id, r.n_links, r.n_copies) for r in near_join.near_duplicates(df, block=block).collect())
    last = near_join.LAST_ID
    want = [(7, 1, 1)] * 2 + [(9, 1, 1)] * 2 + [(9, 0, 2)] * 2 + [(last, 2, 1)] * 3 + [(last, 0, 1)] * 9 + [(last, 0, 3)] * 3
    assert got == sorted(want)


def test_depth_reaches_the_recall():
    d = near_join.depth_for()
    assert 1 - (1 - 0.8**d) ** near_join.TREES >= near_join.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** near_join.TREES


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.vertex: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {v: v for e in edges for v in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {v: r for v, r in root.items() if any(v in e and e[0] != e[1] for e in edges)}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_join.near_duplicates(empty).count() == 0


@pytest.fixture
def split(monkeypatch):
    """Every table counts as large, and groups of three rows as hot."""
    from lodestack.llm import _common

    monkeypatch.setattr(_common, "SMALL_ROWS", 0)
    monkeypatch.setattr(_common, "HOT_ROWS", 2)
    monkeypatch.setattr(near_join, "NODE_CLASSES", 3)


def test_hot_groups_give_the_same(spark, split):
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 300) for i in range(1, 20)] + [(1000, 1001)]
    got = {r.vertex: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 321


def test_forest_recall_and_wide_nodes(spark, split):
    """Pairs at and above the threshold, queries with ids divisible by 20 against all rows."""
    rng = random.Random(8)
    rows = []
    for base in range(60):
        words = [f"b{base}w{i}" for i in range(rng.choice([120, 400, 800]))]
        for _ in range(8):
            copy = list(words)
            for at in rng.sample(range(len(copy)), max(1, len(copy) // rng.choice([100, 130, 200]))):
                copy[at] = f"x{rng.randrange(10**9)}"
            rows.append(" ".join(copy))
    sets = [shingles(t) for t in rows]
    df = spark.createDataFrame([*enumerate(rows)], "doc_id long, text string").repartition(4)
    got = {r.key: r for r in near_join.near_duplicates(df).collect()}
    want = found = 0
    for q in range(0, len(rows), 20):
        links = [i for i, s in enumerate(sets) if i != q and s != sets[q] and len(s & sets[q]) / len(s | sets[q]) >= 0.8]
        want += len(links)
        found += sum(got[i].class_id == got[q].class_id for i in links)
        assert got[q].n_links <= len(links)
    assert want >= 20 and found >= 0.9 * want


def test_depth_follows_what_is_found():
    import numpy as np

    few, many = np.zeros(near_join.BINS), np.zeros(near_join.BINS)
    few[-2:], many[:] = 100, 100
    floor = near_join.depth_for()
    assert near_join.next_depth(few, 8, floor, 0.8, 0.9999) is None  # all are nearly equal: the longest prefixes do
    assert floor <= near_join.next_depth(many, 8, floor, 0.8, 0.9999) < 8
    assert near_join.next_depth(np.zeros(near_join.BINS), 8, floor, 0.8, 0.9999) == floor
    assert near_join.next_depth(many, floor, floor, 0.8, 0.9999) is None

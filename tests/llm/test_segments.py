"""Both substring operators against brute force."""

import hashlib
import os
import random
import re
from collections import defaultdict

import pytest

from lodestack.llm import suffix_repeats, superkmer_dedup


def brute(symbols_by_doc, k):
    first = {}
    for doc, sym in symbols_by_doc:
        for i in range(len(sym) - k + 1):
            w = tuple(sym[i : i + k])
            first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, sym in symbols_by_doc:
        gone = [False] * len(sym)
        for i in range(len(sym) - k + 1):
            if first[tuple(sym[i : i + k])] < doc:
                gone[i : i + k] = [True] * k
        out.append(gone)
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = ["alpha", "bé", "gamma", "δ", "x", "omega", "zz", "quince"]
    passage = [rng.choice(vocab) for _ in range(80)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) + str(rng.randrange(9)) for _ in range(rng.choice([0, 3, 40, 90, 150]))]
        kind = rng.randrange(6)
        if kind == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        elif kind == 1 and rows:
            other = (rng.choice(rows)[1] or "").split()
            if other:
                other[rng.randrange(len(other))] = "changed"
            words = other
        elif kind == 2 and rows:
            rows.append((i, rng.choice(rows)[1]))
            continue
        elif kind == 3:
            words = ["ha"] * rng.randrange(200)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (None, rows[0][1]), (5, rows[9][1]), (7, rows[7][1])]
    rng.shuffle(rows)
    return rows


PLANS = [{}, {"hot_tasks": 1}, {"buckets": 64, "tasks": 2, "hot_tasks": 3}, {"buckets": 2, "bits": 128, "hot_tasks": 2}]


@pytest.mark.parametrize("plan", PLANS)
def test_bytes_against_brute_force(spark, plan):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in suffix_repeats.removal_report(df, **plan).collect()]
    data = [(float("inf") if d is None else d, (t or "").encode()) for d, t in rows]
    want = []
    for (d, t), gone in zip(rows, brute(data, 50), strict=True):
        raw = (t or "").encode()
        spans = len(re.findall("x+", "".join("x" if g else "." for g in gone)))
        want.append((d, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    assert sum(w[2] for w in want) > 1000
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("plan", PLANS)
def test_words_against_brute_force(spark, plan):
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in superkmer_dedup.removal_report(df, **plan).collect()]
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    data = [(float("inf") if d is None else d, split(t)) for d, t in rows]
    want = []
    for (d, t), gone in zip(rows, brute(data, 50), strict=True):
        words = split(t)
        want.append((d, len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone, strict=True) if not g).encode()).hexdigest()))
    assert sum(w[2] for w in want) > 200
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_repeats.removal_report(empty).count() == 0
    assert superkmer_dedup.removal_report(empty).count() == 0
    df = spark.createDataFrame([(1, "a" * 60, 9, "k"), (2, "b" + "a" * 60, 9, "k")], "doc_id long, text string, n_removed int, __ls_key string")
    got = {r.doc_id: r.text for r in suffix_repeats.remove_repeats(df).collect()}
    assert got == {1: "a" * 60, 2: "b"}


def test_maximal_repeats_against_all_pairs():
    rng = random.Random(3)
    for _ in range(20):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(6, 40))) for _ in range(5)]
        import numpy as np

        sa = suffix_repeats.SuffixArray(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), 5)
        suffixes = []
        base = 0
        for s in strings:
            suffixes += [(s[i:], base + i) for i in range(len(s) - 4)]
            base += len(s)
        text = {p: s for s, p in suffixes}
        assert [text[p] for p in sa.at.tolist()] == sorted(s for s, _ in suffixes)
        for i in range(1, len(sa.at)):
            a, b = text[sa.at[i - 1]], text[sa.at[i]]
            n = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert sa.lcp[i] == n
        where = defaultdict(set)
        for s, p in suffixes:
            for n in range(5, len(s) + 1):
                where[s[:n]].add(p)
        found = {}
        for length, lo, hi in suffix_repeats.maximal_repeats(sa.lcp.tolist(), sa.left.tolist(), 5):
            found[text[sa.at[lo]][:length]] = set(sa.at[lo : hi + 1].tolist())
        for s, at in where.items():
            if len(at) > 1:
                assert any(s in r and len(group) == len(at) for r, group in found.items())
        assert all(where[r] == group for r, group in found.items())


def test_rows_follow_the_text_and_not_the_buckets(spark):
    """With a filter that lets everything through, as a saturated one does."""
    from lodestack.llm import _segments as S

    rng = random.Random(9)
    df = S.with_keys(spark.createDataFrame([(i, "".join(rng.choice("abcdefgh ") for _ in range(20_000))) for i in range(60)], "doc_id long, text string").repartition(4))
    n = {}
    for buckets in (32, 16_384):
        plan = S.plan_for(df, "bytes", 50, 16, buckets=buckets, tasks=16)
        everything = S.Filter(plan, [(b, b"\xff" * (plan.block // 8), b"") for b in range(buckets)])
        n[buckets] = S.routed(df.select(S.KEY, S.TAG, "text"), plan, spark.sparkContext.broadcast(everything)).count()
    assert 0 < n[16_384] <= 2 * n[32]


def test_long_texts(spark):
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150_000))
    words = long.split(" ")
    part = " ".join(words[1000:60_000])
    df = spark.createDataFrame([(1, long), (2, "new start " + part), (3, "x" * 1_500_000)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in suffix_repeats.removal_report(df).collect()}
    assert len(long) > 1_000_000 and got[1].n_removed == 0
    assert (got[2].n_removed, got[2].n_spans) in ((len(part), 1), (len(part) + 1, 1))
    assert got[3].n_removed == 0  # a document never removes from itself
    got = {r.doc_id: r.n_removed for r in superkmer_dedup.removal_report(df).collect()}
    assert got == {1: 0, 2: 59_000, 3: 0}


def brute_groups(rows, k, most):
    """(repeat, occurrences) of every maximal repeat of k to most bytes that two documents hold."""
    where = defaultdict(set)
    for row, (doc, text) in enumerate(rows):
        raw = (text or "").encode()
        for i in range(len(raw) - k + 1):
            for n in range(k, min(most, len(raw) - i) + 1):
                where[raw[i : i + n]].add((row, i))
    raw = [(t or "").encode() for _, t in rows]
    out = {}
    for s, at in where.items():
        if len({rows[r][0] for r, _ in at}) < 2:
            continue
        left = {raw[r][i - 1] if i else (r, "start") for r, i in at}
        right = {raw[r][i + len(s)] if i + len(s) < len(raw[r]) else (r, "end") for r, i in at}
        if len(left) > 1 and (len(right) > 1 or len(s) == most):
            out[s] = sorted((rows[r][0] is None, rows[r][0] or 0, i) for r, i in at)
    return out


@pytest.mark.parametrize("plan", [{}, {"buckets": 8, "tasks": 2}])
def test_repeat_groups_against_brute_force(spark, plan):
    rng = random.Random(31)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(12, 60))) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [rng.choice([rng.choice(passages), rng.choice(passages)[3:30], "".join(rng.choice("xyz") for _ in range(rng.randrange(1, 30)))]) for _ in range(rng.randrange(4))]
        rows.append((i, "".join(parts)))
    rows += [(50, rows[4][1]), (51, rows[4][1]), (52, None), (53, ""), (None, passages[0] + "q"), (54, passages[0] + "r"), (55, "w" + "ab" * 30), (56, "v" + "ab" * 30)]
    want = brute_groups(rows, 12, 10_000)
    assert len(want) > 30 and sum(len(s) > 40 for s in want) > 5 and any(len(s) < 40 for s in want)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int").repartition(3)
    got = defaultdict(list)
    for r in suffix_repeats.repeat_groups(df, k=12, m=8, reach=28, **plan).collect():
        got[r["group"], r.length].append((r.doc_id is None, r.doc_id or 0, r.start))
    assert {(int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True), len(s)): at for s, at in want.items()} == {g: sorted(at) for g, at in got.items()}
    assert suffix_repeats.repeat_groups(df.where("false")).count() == 0


@pytest.mark.parametrize(("first", "node_bytes"), [(512, 4 << 20), (64, 600)])
def test_long_repeats_are_whole(spark, monkeypatch, first, node_bytes):
    """Passages of thousands of bytes that branch after hundreds, copies of whole texts, a common
    head of many texts; with blocks that have to be shortened."""
    from lodestack.llm import _extend

    monkeypatch.setattr(_extend, "FIRST", first)
    monkeypatch.setattr(_extend, "NODE_BYTES", node_bytes)
    rng = random.Random(77)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    long, head, whole = text(2000), text(900), text(1500)
    rows = [(1, "p" + long), (2, "q" + long + "tail"), (3, "r" + long[:700] + text(50)), (4, "p" + long[:1200] + "zz"), (5, whole), (6, whole), (7, "x" + whole), (8, whole[:1000])]
    rows += [(20 + i, head + text(30)) for i in range(12)] + [(40, "s" + head[:600]), (41, None), (41, ""), (None, long[100:1900])]
    want = brute_groups(rows, 50, 10_000)
    assert max(map(len, want)) > 2000 and sum(len(s) > 512 for s in want) > 6
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = defaultdict(list)
    for r in suffix_repeats.repeat_groups(df).collect():
        got[r["group"], r.length].append((r.doc_id is None, r.doc_id or 0, r.start))
    assert {(int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True), len(s)): at for s, at in want.items()} == {g: sorted(at) for g, at in got.items()}


def test_reduce_tasks_have_partitions_of_their_own(spark):
    import pyarrow as pa
    from pyspark import TaskContext

    from lodestack.llm import _segments as S

    def tasks(batches):
        seen = sorted({t for rb in batches for t in rb.column("task").to_pylist()})
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array([TaskContext.get().partitionId()] * len(seen), pa.int32())], ["task", "part"])

    df = S.with_keys(spark.createDataFrame(corpus(3), "doc_id long, text string"))
    plan = S.plan_for(df, "bytes", 50, 16, buckets=64, tasks=32)
    got = S.solved_by(df, plan, tasks, "task int, part int").collect()
    assert len(got) > 16
    assert len({r.part for r in got}) == len({r.task for r in got}) == len(got)


@pytest.mark.parametrize("ids", [lambda i: 64 * i, lambda i: None if i else 0])
def test_settled_spans_spread_over_tasks(spark, ids):
    """Equal passages of one map task, in documents whose ids ascend in steps or are null."""
    from lodestack.llm import _segments as S

    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    df = S.with_keys(spark.createDataFrame([(ids(i), f"{passage} {i:04d}") for i in range(200)], "doc_id long, text string").coalesce(1))
    plan = S.plan_for(df, "bytes", 50, 16, buckets=16, tasks=16)
    everything = S.Filter(plan, [(b, b"\xff" * (plan.block // 8), b"") for b in range(16)])
    settled = S.routed(df.select(S.KEY, S.TAG, "text"), plan, spark.sparkContext.broadcast(everything)).where("blobs is null")
    n = [r["count"] for r in settled.groupBy("task").count().collect()]
    assert sum(n) >= 199  # all documents but the first
    assert len(n) == 16
    assert max(n) <= 5 * sum(n) / 16


def test_routed_strings_take_few_bytes(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(6)) for _ in range(3000)]
    df = spark.createDataFrame([(i * 977, " ".join(rng.choice(words) for _ in range(3000))) for i in range(60)], "doc_id long, text string").coalesce(1)
    from lodestack.llm import _segments as S

    keyed = S.with_short_keys(df)
    assert keyed.where(f"{S.TAG} <> 0").isEmpty()  # no id comes twice
    twice = S.with_short_keys(df.union(spark.createDataFrame([(977, "other")], df.schema)))
    assert twice.select(S.TAG).distinct().count() == 61
    plan = S.Plan("bytes", 50, 16, 64, 16, 1 << 16)
    every = S.Filter(plan, [(b, b"\xff" * (plan.block // 8), b"") for b in range(plan.buckets)])
    rows = S.routed(keyed.select(S.KEY, S.TAG, "text"), plan, spark.sparkContext.broadcast(every)).where("blobs is not null").collect()
    blobs = [bytes(b) for r in rows for b in r["blobs"] if b is not None]
    index, keys, runs, owner, docs, tags, starts = S.unpacked(blobs)
    text = {r["doc_id"]: r["text"].encode() for r in df.collect()}
    strings = list(index)
    found = [(o, d, s) for os, ds, ss in zip(owner, docs, starts, strict=True) for o, d, s in zip(os.tolist(), ds.tolist(), ss.tolist(), strict=True)]
    assert all(text[d][s : s + len(strings[o])] == strings[o] for o, d, s in found)
    assert sum(runs[o] for o, _, _ in found) == sum(len(t) - 49 for t in text.values())
    assert sum(map(len, blobs)) < 52 * len(found)  # 56.8 with whole keys and tags in one block with the text


@pytest.mark.parametrize("plan", [{}, {"hot_tasks": 1}, {"buckets": 16, "tasks": 2, "hot_tasks": 3}])
@pytest.mark.parametrize("module", [suffix_repeats, superkmer_dedup])
def test_rounds_change_nothing(spark, module, plan):
    df = spark.createDataFrame(corpus(6), "doc_id long, text string").repartition(5)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    once, often = (sorted((tuple(r) for r in module.removal_report(df, rounds=n, **plan).collect()), key=key) for n in (1, 5))
    assert once == often


def test_rounds_follow_the_strings():
    from lodestack.llm import _segments as S

    plan = S.Plan("bytes", 50, 16, 4096, 1024, 1 << 20, total=6 << 30)
    assert plan.in_rounds(0).rounds == plan.in_rounds(1000).rounds == 1
    much = plan.in_rounds(300_000_000)
    assert 4 <= much.rounds <= 8 and much.tasks == 4096
    turns = [much.turn(n) for n in range(much.rounds)]
    assert [a for a, _ in turns] == [0, *(b for _, b in turns[:-1])] and turns[-1][1] == much.tasks
    assert max(b - a for a, b in turns) <= min(b - a for a, b in turns) + 1


def test_a_minimiser_in_many_tasks_is_split_only_where_it_fills_a_bucket(spark):
    """A phrase in one text of each of 80 tasks, each time between other words: 80 strings or so for
    each minimiser, which no bucket has trouble with."""
    import numpy as np
    import pyarrow as pa

    from lodestack.llm import _segments as S

    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(n))
    phrase = text(30)
    df = S.with_keys(spark.createDataFrame([(i, phrase.join(text(200) for _ in range(100))) for i in range(80)], "doc_id long, text string").repartitionByRange(80, "doc_id"))
    assert df.rdd.getNumPartitions() == 80

    def strings(batches):
        n = [int(np.frombuffer(b, np.int64, 1)[0]) for rb in batches for row in rb.column("blobs").to_pylist() for b in row or () if b]
        yield pa.RecordBatch.from_arrays([pa.array([sum(n)], pa.int64())], ["n"])

    found = S.solved_by(df, S.plan_for(df, "bytes", 50, 16), strings, "n long").agg({"n": "sum"}).first()[0]
    assert 80 * 99 < found < 80 * 99 * 8  # about 4 strings each; 35 windows when split


def test_shuffles_go_when_their_round_is_done(spark):
    import time

    def left():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getPath() for i in range(files.size()) if "shuffle_" in files.apply(i).getName()}

    df = spark.createDataFrame(corpus(7, 1000), "doc_id long, text string").repartition(5).localCheckpoint()
    before = left()
    report = suffix_repeats.removal_report(df, rounds=3)
    for _ in range(50):
        if not (more := left() - before):
            break
        time.sleep(0.2)
    size = sum(os.path.getsize(f) for f in more if os.path.exists(f))
    assert size < 10_000  # sums over the table; the census alone left 61,647 bytes
    assert report.count() == df.count()

"""The pipeline's stages in a chain, each against a plain Python version."""

import hashlib
import math
import random
import re
from pathlib import Path

import pytest
import tiktoken

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as C  # noqa: E402
import public_tokenizers as P  # noqa: E402

from lodestack.llm import _common, bpe_transducer, fm_quality  # noqa: E402


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def corpus():
    rng = random.Random(21)
    text = lambda n: " ".join(rng.choice(["alpha", "béta", "gamma", "漢字", "of", "the"]) + str(rng.randrange(500)) for _ in range(n))
    passage = " " + text(60) + " "
    rows = []
    for i in range(120):
        t = text(rng.choice([30, 80, 150]))
        if i % 10 == 3:
            t = t[: len(t) // 2] + passage + t[len(t) // 2 :]
        if i % 10 == 5:
            t = rows[-5][1] or ""
        if i % 10 == 6:
            t = (rows[-1][1] or "") + " extra"
        if i % 3 == 0:
            t = " ".join("###" + w for w in t.split())
        rows.append((i, t, rng.choice(["s1", "s2", None])))
    rows += [(200, None, "s1"), (201, "", None), (202, " \n", "s2"), (None, text(70), "s1"), (None, text(70), None), (203, text(40), "s3"), (203, text(40), "s3")]
    rows += [rows[1]] * 3 + [rows[-2]] * 2
    rng.shuffle(rows)
    return rows


def near(rows):
    """The row of the least (doc_id, tag) for all that chains of links lead to."""
    texts = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if texts[i] and texts[j] and len(texts[i] & texts[j]) >= 0.8 * len(texts[i] | texts[j]) - 1e-9:
                root[top(i)] = top(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(top(i) if texts[i] else (i,), []).append(r)
    return groups.values()


def cut(rows, k=50):
    first = {}
    key = lambda d: math.inf if d is None else d
    raw = [((t or "").encode(), key(d)) for d, t, _ in rows]
    for t, d in raw:
        for i in range(len(t) - k + 1):
            first[t[i : i + k]] = min(d, first.get(t[i : i + k], math.inf))
    out = []
    for (t, d), (doc, text, source) in zip(raw, rows, strict=True):
        gone = [False] * len(t)
        for i in range(len(t) - k + 1):
            if first[t[i : i + k]] < d:
                gone[i : i + k] = [True] * k
        out.append((doc, bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore") if any(gone) else text, source))
    return out


def mix(rows, weights=(1, 2, 3), cap=3):
    """(position, doc_id, text) by plain sums: queues, quotas and the inverse of each schedule."""
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(words(t)) for _, t, x in rows if x == s) for s in names}
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, target = set(), {}
    while True:
        left = sum(size.values()) - sum(cap * size[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s in share if share[s] > cap * size[s]}
        if not over:
            break
        full |= over
    target = {s: cap * size[s] if s in full else share[s] for s in names}
    out = []
    for s in names:
        swing = 0.5 if (weights.index(weight[s])) % 2 == 0 else -0.5
        queue = sorted((hashlib.md5((str(d) if d is not None else f"null{tag(t)}").encode()).hexdigest(), d is None, d or 0, tag(t), t) for d, t, x in rows if x == s)
        quota, at = math.floor(target[s] + 0.5), 0
        for j in range(cap):
            for _, none, d, _, t in queue:
                n = len(words(t))
                take = max(0, min(n, quota - at))
                if n and take and 2 * take >= n:
                    area, w0, slope = (at + take / 2) / quota * weight[s], weight[s] * (1 + swing), -2 * weight[s] * swing
                    out.append((2 * area / (w0 + math.sqrt(max(w0 * w0 + 2 * slope * area, 0))), None if none else d, t))
                at += n
    return sorted(out, key=lambda r: r[0])


def tag(t):
    import xxhash

    h = xxhash.xxh64((t or "").encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows = corpus()
    df = spark.createDataFrame([(d, t, "en", s, len(t) if t else 0, i, 0.5, "x") for i, (d, t, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, position long, score double, tokens string")
    df.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, int(not (t or "").startswith("###")), 0) for d, t, _ in rows if d is not None] + [(None, 1, 0), (999, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows


def test_stages_against_plain_python(spark, folder):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    names = docs.columns
    take = lambda df: [(r.doc_id, r.text, r.source) for r in df.collect()]
    order = lambda rs: sorted(rs, key=lambda r: tuple((x is None, x) for x in r))

    scores = fm_quality.score(docs, fm_quality.train(docs, spark.read.parquet(f"{at}/labels.parquet")))
    want = order([(r.doc_id, r.text, r.source) for r in scores.collect() if r.score >= 0.3])
    docs = _common.staged(C.STAGES[0][1](spark, docs, at))
    kept = take(docs)
    assert docs.columns == names and order(kept) == want and 60 < len(kept) < len(rows)

    docs = _common.staged(C.STAGES[1][1](spark, docs, at))
    groups, got = near(kept), take(docs)
    assert docs.columns == names and len(got) == len(groups)
    for g in groups:
        assert len([r for r in got if r in g]) == 1
        assert any(r in got for r in g if (r[0] is None, r[0]) == min((x[0] is None, x[0] or 0) for x in g) or r[0] is None)

    docs = _common.staged(C.STAGES[2][1](spark, docs, at))
    assert docs.columns == names and order(take(docs)) == order(cut(got))
    assert take(docs) != got and all(r.n_chars == len(r.text or "") for r in docs.collect())

    want, rest = mix(take(docs)), docs
    docs = _common.staged(C.STAGES[3][1](spark, docs, at))
    assert docs.columns == names and order(take(docs)) == order([(d, t, next(s for a, b, s in take(rest) if (a, b) == (d, t))) for _, d, t in want])

    out = C.STAGES[4][1](spark, docs, at).orderBy("position").collect()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_transducer.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert [(r.doc_id, r.tokens) for r in out] == [(d, enc.encode_ordinary(t)) for _, d, t in want]
    assert len({r.position for r in out}) == len(out)


def test_run_keeps_the_order_and_drops_its_scratch(spark, folder):
    at, _ = folder
    before = _common.scratch(spark)
    out = C.run(spark, at)
    left = _common.scratch(spark) - before
    rows = out.orderBy("position").collect()
    assert len(left) == 1 and all(Path(p).exists() for p in left)
    again = C.run(spark, at).orderBy("position").collect()
    assert [(r.doc_id, r.tokens) for r in rows] == [(r.doc_id, r.tokens) for r in again] and rows
    _common.drop_scratch(spark, before)
    assert not any(Path(p).exists() for p in left)


def test_empty_table(spark, folder, tmp_path):
    at, _ = folder
    for name in ("documents", "labels"):
        spark.read.parquet(f"{at}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_the_stage_that_cuts_repeats_leaves_no_shuffle(spark):
    """What it shuffles to find repeats is gone before the texts are joined."""
    import os
    import time

    def left():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getPath() for i in range(files.size()) if "shuffle_" in files.apply(i).getName()}

    rng = random.Random(22)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(400)
    docs = spark.createDataFrame([(i, text(2000) + passage * (i % 2)) for i in range(100)], "doc_id long, text string").repartition(5).localCheckpoint()
    before = left()
    cut = C.cut_repeats(spark, docs, "")
    for _ in range(50):
        if not (more := left() - before):
            break
        time.sleep(0.2)
    assert sum(os.path.getsize(f) for f in more if os.path.exists(f)) < 10_000  # sums over the table
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.text for r in cut.collect()}
    assert len(got) == 100 and got[1] == rows[1]
    assert all(abs(len(got[i]) - 2000) < 10 for i in range(3, 100, 2))

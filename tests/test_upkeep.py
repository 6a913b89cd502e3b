"""Digest trees, names by their ends, and signed postings, against the plain operators."""

import datetime
import random

import pytest

from lodestack.operators import retrieval as R
from lodestack.operators import upkeep

FILES = "corpus string, rel string, sha256 string, mtime timestamp, size long"


def state(rng, names):
    day = datetime.datetime(2024, 1, 1)
    return {n: (rng.choice("abc"), day + datetime.timedelta(days=rng.randrange(2)), rng.randrange(2)) for n in names}


def table(spark, files):
    return spark.createDataFrame([(*k, *v) for k, v in files.items()], FILES).repartition(3)


def diff_by_tree(spark, old, new):
    o, n = table(spark, old), table(spark, new)
    return upkeep.tree_diff(o, n, upkeep.folder_digests(o), upkeep.folder_digests(n)).collect(), upkeep.snapshot_diff(o, n).collect()


def test_tree_equals_snapshot_diff(spark):
    rng = random.Random(3)
    names = [(c, "/".join([*(rng.choice(["x", "y", "long name", "é"]) for _ in range(rng.randrange(4))), f"f{i}.md"])) for i in range(300) for c in ("kb", "other")]
    old = state(rng, names)
    new = dict(old)
    touched = [k for k in names if k[1].startswith("x/y/")]  # changes lie below one folder of two corpora
    for k in touched[::3]:
        new[k] = ("z", *old[k][1:])
    for k in touched[1::7]:
        del new[k]
    new["kb", "x/y/brand/new/one.md"] = ("n", datetime.datetime(2024, 2, 2), 9)
    got, want = diff_by_tree(spark, old, new)
    same = lambda s: "unchanged" if s == "touched" else s
    assert sorted((r.corpus, r.rel, r.status) for r in got) == sorted((r.corpus, r.rel, r.status) for r in want)
    folder = lambda k: (k[0], k[1].rpartition("/")[0])
    changed = {folder(k) for k in old.keys() | new.keys() if old.get(k) != new.get(k)}
    assert all(r.compared == (folder((r.corpus, r.rel)) in changed) for r in got)
    assert 0 < sum(r.compared for r in got) < 0.5 * len(got) and same("touched") == "unchanged"


def test_tree_of_equal_new_and_empty_states(spark):
    rng = random.Random(4)
    files = state(rng, [("kb", f"d{i % 3}/f{i}.md") for i in range(20)])
    got, _ = diff_by_tree(spark, files, files)
    assert {(r.status, r.compared) for r in got} == {("unchanged", False)} and len(got) == 20
    got, _ = diff_by_tree(spark, {}, files)
    assert {(r.status, r.compared) for r in got} == {("new", True)} and len(got) == 20
    got, _ = diff_by_tree(spark, files, {})
    assert {r.status for r in got} == {"removed"} and len(got) == 20
    assert diff_by_tree(spark, {}, {})[0] == []


@pytest.fixture(scope="module")
def named(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("names") / "files")
    rows = [("n", r, f"/kb/{r}") for r in ("beta.md", "x/a.md", "A.MD", "box.md", "dir/é.MD", "50%.md", "under_score.md", "a\\b.md")] + [("m", f"sub{i}/note{i:03d}.md", f"/kb/m/{i}") for i in range(500)]
    f = spark.createDataFrame(rows, "corpus string, rel string, path string")
    upkeep.with_tail(f).coalesce(1).sortWithinPartitions("tail").write.parquet(at)
    return f, spark.read.parquet(at)


def test_names_by_their_ends(named):
    f, tails = named
    for spec in ("a.md", "n:beta.md", "n:none", "/kb/x/a.md", "x/a.md", "B%.md", "_.md", "7.MD", "%", "é.md", "É.md", "x.MD", "0%.md", "nothing", "r_score.md", "99.md", "%1_.md"):
        want = sorted(map(tuple, upkeep.find_file(f, spec).collect()))
        assert sorted(map(tuple, upkeep.find_by_tail(tails, spec).select(*f.columns).collect())) == want, spec


def test_the_scan_gets_the_end_of_the_name(named):
    plan = upkeep.find_by_tail(named[1], "/note1%7.md")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(tail,dm.7)" in plan
    assert "EqualTo(rel,x.md)" in upkeep.find_by_tail(named[1], "n:x.md")._jdf.queryExecution().executedPlan().toString()


def test_deltas_equal_a_rebuild(spark):
    """Three states one after another, deltas merged in any order."""
    rng = random.Random(9)
    words = ["kiln", "glaze", "clay", "slip", "wheel"]

    def make(before, n):
        out = {i: t for i, t in before.items() if rng.random() > 0.2}
        out |= {i: " ".join(rng.choice(words) for _ in range(rng.randrange(6))) for i in rng.sample(range(60), n)}
        return out

    def chunks(texts):
        rows = [(i, "c", f"f{i}.md", "", t, len(t.split()), str(hash(t))) for i, t in texts.items()]
        return spark.createDataFrame(rows, "chunk_id long, corpus string, rel string, heading string, body string, words long, hash string")

    states = [make({}, 40)]
    for _ in range(2):
        states.append(make(states[-1], 15))
    frames = [chunks(s) for s in states]
    deltas = [upkeep.posting_deltas(a, b, R.postings) for a, b in zip(frames, frames[1:], strict=False)]
    assert all(0 < d.count() < R.postings(frames[-1]).count() * 2 for d in deltas)
    rows = lambda df: sorted(map(tuple, df.collect()))
    base, want = R.postings(frames[0]), rows(R.postings(frames[-1]))
    assert rows(upkeep.with_deltas(base, deltas)) == want == rows(upkeep.with_deltas(base, deltas[::-1]))
    assert rows(upkeep.freq_with_deltas(R.doc_freq(base), deltas)) == rows(R.doc_freq(R.postings(frames[-1])))
    assert rows(upkeep.with_deltas(base, [])) == rows(base)

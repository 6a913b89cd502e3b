"""The backlog's micro-batches: a dead service, a stop in between, refused texts."""

import pandas as pd
import pytest

from lodestack.streaming import backlog


def service(down, refused=()):
    """Embeds a text as its length; the service is away for texts in ``down``."""

    def run(texts):
        out = pd.DataFrame({"vec": [[float(len(t))] for t in texts], "state": "embedded"}, index=texts.index)
        for i, t in texts.items():
            if t in down or t in refused:
                out.at[i, "vec"], out.at[i, "state"] = None, "unreached" if t in down else "refused"
        return out

    return run


@pytest.fixture
def folders(spark, tmp_path):
    for i in range(4):  # a file each, in this order
        rows = spark.createDataFrame([(10 * i + j, f"text {i} " + "x" * j) for j in range(3)], "chunk_id long, text string")
        backlog.write_backlog(rows, str(tmp_path / "pending"), 1)
    return [str(tmp_path / x) for x in ("pending", "out", "mark")]


def held(spark, out):
    return {r.chunk_id: (r.vec, r.state) for r in backlog.results(spark, out).collect()}


def test_a_dead_service_keeps_finished_batches(spark, folders):
    got = backlog.embed_backlog(spark, *folders, service({"text 2 x"}), "s", files_per_batch=1)
    assert got == {"embedded": 8, "refused": 0, "unreached": 1, "batches": 2, "ended": "interrupted"}
    assert {k for k, (_, state) in held(spark, folders[1]).items() if state == "embedded"} == {0, 1, 2, 10, 11, 12, 20, 22}
    # the next run begins with the batch that wasn't finished, and takes nothing twice
    got = backlog.embed_backlog(spark, *folders, service(set(), {"text 3 "}), "s", files_per_batch=1)
    assert got == {"embedded": 5, "refused": 1, "unreached": 0, "batches": 2, "ended": "done"}
    rows = backlog.results(spark, folders[1])
    assert rows.count() == 12 and held(spark, folders[1])[30] == (None, "refused") and held(spark, folders[1])[21] == ([8.0], "embedded")
    assert backlog.embed_backlog(spark, *folders, service(set()), "s")["batches"] == 0


def test_a_stop_in_between(spark, folders):
    asked = iter([False, False, True])
    got = backlog.embed_backlog(spark, *folders, service(set()), "s", files_per_batch=1, should_stop=lambda: next(asked))
    assert got["ended"] == "stopped" and got["batches"] == 2 and len(held(spark, folders[1])) == 6
    backlog.write_backlog(spark.createDataFrame([(99, "late")], "chunk_id long, text string"), folders[0], 1)
    assert backlog.embed_backlog(spark, *folders, service(set()), "s", files_per_batch=2) ["embedded"] == 7
    assert set(held(spark, folders[1])) == {10 * i + j for i in range(4) for j in range(3)} | {99}


def test_other_failures_are_errors(spark, folders):
    def broken(texts):
        raise ZeroDivisionError

    with pytest.raises(Exception, match="ZeroDivisionError"):
        backlog.embed_backlog(spark, *folders, broken, "s")

"""The embedding service's rungs, states and probe, on answers of our own."""

import pandas as pd
import pytest

from lodestack.sources import embedding
from lodestack.sources.embedding import EMBEDDED, REFUSED, UNREACHED, Probe, Reply, Service

SENT = []


def answer(url, payload, seconds):
    """Refuses texts above 100 characters, can't be reached for texts that hold 'down'."""
    if url.endswith("/api/tags"):
        SENT.append("probe")
        return Reply(200, {"models": [{"name": "nomic-embed-text:latest"}]}, "")
    SENT.append([len(t) for t in payload["input"]])
    if any("down" in t for t in payload["input"]):
        return Reply(0, {}, "URLError refused")
    if any(len(t) > 100 for t in payload["input"]):
        return Reply(500, {}, "the input length exceeds the context length")
    return Reply(200, {"embeddings": [[3.0, 4.0] for _ in payload["input"]]}, "")


@pytest.fixture(autouse=True)
def fresh(monkeypatch):
    SENT.clear()
    monkeypatch.setattr(embedding, "_RESTS", {})


def fake(**settings):
    return Service.of(settings, exchange=answer)


def test_batches_and_unit_vectors():
    got = fake(doc_prefix="", batch_size=32).climb(["x"] * 70)
    assert list(got.vec) == [[0.6, 0.8]] * 70 and set(got.state) == {EMBEDDED} and SENT == [[1] * 32, [1] * 32, [1] * 6]
    assert embedding.unit([[0.0, 0.0], [0.0, 2.0]]) == [[0.0, 0.0], [0.0, 1.0]]


def test_long_texts_are_cut_to_half_and_a_quarter():
    got = fake(doc_prefix="", max_chars=320).climb(["short", "y" * 400])
    assert list(got.state) == [EMBEDDED] * 2 and SENT == [[5, 320], [5], [320], [160], [80]]
    SENT.clear()
    got = fake(doc_prefix="", max_chars=800).climb(["y" * 1000, "z"])
    assert list(got.state) == [REFUSED, EMBEDDED] and list(got.vec) == [None, [0.6, 0.8]] and SENT == [[800, 1], [800], [1], [400], [200]]


def test_a_dead_service_is_asked_once():
    s = fake(batch_size=2, doc_prefix="")
    got = s(pd.Series(["a", "b", "down", "c", "d", "e"], index=[7, 8, 9, 10, 11, 12]))
    assert list(got.state) == [EMBEDDED] * 2 + [UNREACHED] * 4 and list(got.index) == [7, 8, 9, 10, 11, 12]
    assert len(SENT) == 2
    assert set(s(pd.Series(["f"])).state) == {UNREACHED} and len(SENT) == 2  # the next Arrow batch waits for nothing
    assert len(s(pd.Series([], dtype=object))) == 0


def test_answers_that_do_not_fit():
    s = Service.of({"doc_prefix": ""}, exchange=lambda *_: Reply(200, {"embeddings": [[1.0]]}, ""))
    assert set(s.climb(["a", "b"]).state) == {UNREACHED}
    bad = Service.of({"url": "http://other"}, exchange=lambda *_: Reply(400, {}, "bad"))
    assert set(bad.climb(["a"]).state) == {REFUSED} and bad.question("q") == (None, "bad")


def test_prefixes_signature_and_probe():
    s = fake()
    assert s.signature == "nomic-embed-text|search_document: " and s.query_prefix == "search_query: "
    assert fake(model="other").signature == "other|" and fake(doc_prefix="").signature == "nomic-embed-text|"
    assert s.question("what") == ([0.6, 0.8], "") and SENT == [[len("search_query: what")]]
    SENT.clear()
    p = Probe(s)
    assert p() == (True, "ready") == p() and SENT == ["probe"]
    assert p(anew=True)[0] and SENT == ["probe"] * 2
    assert not fake(model="absent").ready()[0] and not fake(enabled=False).ready()[0]
    assert not Service.of({"url": "http://127.0.0.1:9", "probe_timeout_s": 0.2}).ready()[0]


def test_hooks_see_requests_and_failures():
    seen = []
    s = Service.of({"url": "http://h"}, exchange=lambda *_: Reply(503, {}, "busy"), pace=lambda u: seen.append(u), told=lambda u, c: seen.append((u, c)))
    s.climb(["a"])
    assert seen == ["http://h/api/embed", ("http://h/api/embed", 503)]

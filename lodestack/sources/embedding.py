"""Vectors from an embedding service over HTTP, as a column with a state for each text.

What is tried with a text is data: ``RUNGS`` says how many texts go into a request and to which
share of the cap they are cut.  Texts that a rung's request is refused for go to the next one;
those that the last rung refuses are ``refused``.  A service that can't be reached leaves
what it hasn't answered ``unreached``, and the worker asks it nothing more for a while, so
a dead service costs one time limit and not one for each Arrow batch.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any, NamedTuple
from urllib import error, request

import numpy as np
import pandas as pd

# Addresses and keys of the service, its defaults, what it says of long texts,
# and the prefixes that a family of models wants.
TAGS, EMBED = "/api/tags", "/api/embed"
DEFAULTS: dict[str, Any] = {"enabled": True, "url": "http://127.0.0.1:11434", "model": "nomic-embed-text", "batch_size": 32, "max_chars": 6000, "num_ctx": 8192, "timeout_s": 120, "probe_timeout_s": 2}
LENGTH_SAID = ("context length", "input length")
PREFIXES = {"nomic-embed": ("search_document: ", "search_query: ")}

#: (texts of a request, 0 for the batch size; share of the cap), one rung after another.
RUNGS = ((0, 1.0), (1, 1.0), (1, 0.5), (1, 0.25))
#: Seconds for which an answer to a probe, or a failure seen by a worker, holds.
HOLDS = 30.0

EMBEDDED, REFUSED, UNREACHED = "embedded", "refused", "unreached"
#: By address, until when this worker leaves a service alone.
_RESTS: dict[str, float] = {}


class Reply(NamedTuple):
    """status 0: no answer came."""

    status: int
    body: dict
    said: str

    @property
    def good(self) -> bool:
        return self.status == 200

    @property
    def too_long(self) -> bool:
        return self.status == 400 or any(x in self.said.lower() for x in LENGTH_SAID)


def http(url: str, payload: dict | None, seconds: float) -> Reply:
    """One exchange of JSON; failures are replies too."""
    asked = request.Request(url, json.dumps(payload).encode() if payload is not None else None, {"Content-Type": "application/json"})
    try:
        with request.urlopen(asked, timeout=seconds) as answer:
            return Reply(answer.status, json.load(answer), "")
    except error.HTTPError as e:
        return Reply(e.code, {}, e.read().decode("utf-8", "replace"))
    except (OSError, ValueError) as e:
        return Reply(0, {}, f"{type(e).__name__} {e}")


def unit(rows: Sequence[Sequence[float]]) -> list[list[float]]:
    """Rows scaled to length 1; zero rows stay."""
    m = np.array(rows, np.float64).reshape(len(rows), -1)
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return (m / np.where(size == 0, 1.0, size)).tolist()


@dataclass(frozen=True)
class Service:
    """Settings of a service, sent to the executors.  ``pace`` is called with the address before
    each request and ``told`` with address and status after one that fails; both are pickled."""

    url: str
    model: str
    doc_prefix: str
    query_prefix: str
    batch: int
    cap: int
    context: int
    seconds: float
    probe_seconds: float
    enabled: bool = True
    exchange: Callable[[str, dict | None, float], Reply] = http
    pace: Callable[[str], None] | None = None
    told: Callable[[str, int], None] | None = None

    @classmethod
    def of(cls, settings: dict, **hooks: Any) -> Service:
        s = {**DEFAULTS, **{k: v for k, v in settings.items() if v is not None}}
        usual = next((p for family, p in PREFIXES.items() if s["model"].startswith(family)), ("", ""))
        return cls(s["url"].rstrip("/"), s["model"], s.get("doc_prefix", usual[0]), s.get("query_prefix", usual[1]), int(s["batch_size"]), int(s["max_chars"]), int(s["num_ctx"]), float(s["timeout_s"]), float(s["probe_timeout_s"]), bool(s["enabled"]), **hooks)

    @property
    def signature(self) -> str:
        """Vectors of another model or prefix are not comparable."""
        return f"{self.model}|{self.doc_prefix}"

    def _ask(self, path: str, payload: dict | None, seconds: float) -> Reply:
        if self.pace:
            self.pace(self.url + path)
        reply = self.exchange(self.url + path, payload, seconds)
        if self.told and not reply.good and reply.status:
            self.told(self.url + path, reply.status)
        return reply

    def ready(self) -> tuple[bool, str]:
        """Whether the service answers and has the model, under any tag, and what to say of it."""
        if not self.enabled:
            return False, "the embedder is disabled in the configuration"
        reply = self._ask(TAGS, None, self.probe_seconds)
        if not reply.good:
            return False, f"{self.url} can't be reached ({reply.said or reply.status})"
        untagged = {m.get("name", "").partition(":")[0] for m in reply.body.get("models", [])}
        has = self.model.partition(":")[0] in untagged
        return has, "ready" if has else f"{self.url} answers but lacks the model {self.model}"

    def _vectors(self, texts: list[str]) -> tuple[list[list[float]] | None, Reply]:
        payload = {"model": self.model, "input": texts, "truncate": True} | ({"options": {"num_ctx": self.context}} if self.context else {})
        reply = self._ask(EMBED, payload, self.seconds)
        rows = reply.body.get("embeddings", []) if reply.good else []
        if reply.good and len(rows) != len(texts):
            return None, Reply(0, {}, f"{len(rows)} vectors came for {len(texts)} texts")
        return (unit(rows) if reply.good else None), reply

    def climb(self, texts: Sequence[str]) -> pd.DataFrame:
        """vec and state for each text, by the rungs."""
        out = pd.DataFrame({"vec": pd.Series([None] * len(texts), dtype=object), "state": UNREACHED})
        left = list(range(len(texts)))
        for together, share in RUNGS:
            refused: list[int] = []
            size = together or self.batch
            for at in range(0, len(left), size):
                if _RESTS.get(self.url, 0) > time.monotonic():
                    return out
                some = left[at : at + size]
                rows, reply = self._vectors([self.doc_prefix + texts[i][: int(self.cap * share)] for i in some])
                if rows is not None:
                    for i, v in zip(some, rows, strict=True):
                        out.at[i, "vec"], out.at[i, "state"] = v, EMBEDDED
                elif reply.too_long:
                    refused += some
                else:
                    _RESTS[self.url] = time.monotonic() + HOLDS
            left = refused
        out.loc[left, "state"] = REFUSED
        return out

    def __call__(self, texts: pd.Series) -> pd.DataFrame:
        """:meth:`climb` for a column of texts on an Arrow batch."""
        return self.climb([t or "" for t in texts]).set_index(texts.index)

    def question(self, text: str) -> tuple[list[float] | None, str]:
        """The vector of a query, or why there is none."""
        rows, reply = self._vectors([self.query_prefix + text[: self.cap]])
        return (rows[0], "") if rows else (None, reply.said or f"status {reply.status}")


class Probe:
    """The driver's last probe of a service, which holds for a while."""

    def __init__(self, service: Service):
        self.service, self.at, self.last = service, float("-inf"), (False, "not asked yet")

    def __call__(self, anew: bool = False) -> tuple[bool, str]:
        if anew or time.monotonic() - self.at > HOLDS:
            self.last, self.at = self.service.ready(), time.monotonic()
        return self.last

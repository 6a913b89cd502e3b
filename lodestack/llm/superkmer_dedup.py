"""Substring dedup by super-k-mers of words.

A window is 50 consecutive words of a document.  Consecutive windows that share a minimiser
(the least hash of the 8-word runs within them) travel as one packed string, their words
joined by one space, to the minimiser's bucket (see ``_segments``).  There the windows of
each minimiser are sorted as strings, so equal ones stand together and are counted exactly.

Edge cases: null, empty and blank texts have no words; texts under 50 words have no window
and stay whole; rows that share a doc_id never remove from each other; a null doc_id counts
as the largest; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _segments as S
from ._common import documents
from .suffix_repeats import _finish

K, M = 50, 8
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def count_windows(strings: list[bytes], key: np.ndarray, run: np.ndarray, least: np.ndarray, k: int = K) -> np.ndarray:
    """Least document of every window of the bucket's packed strings, string after string."""
    out = np.repeat(least, run)
    base = (np.cumsum(run) - run).tolist()
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    bounds = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1])).tolist() + [len(order)]
    order, docs = order.tolist(), least.tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a == 1:
            continue  # equal windows have equal minimisers, so these are in no other string
        windows = []
        for j in order[a:b]:
            s, doc, at = strings[j], docs[j], base[j]
            gaps = [-1, *(np.flatnonzero(np.frombuffer(s, np.uint8) == 32).tolist()), len(s)]
            windows += [(s[gaps[i] + 1 : gaps[i + k]], doc, at + i) for i in range(len(gaps) - k)]
        windows.sort()
        text, first = None, 0
        for w, doc, at in windows:
            if w != text:
                text, first = w, doc
            elif doc > first:
                out[at] = first
    return out


def repeated_words(docs: DataFrame, k: int = K, m: int = M, **plan: int) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...), texts compressed, with the ranges of word numbers covered by
    k-word windows that also start in a smaller doc_id (see ``_segments.removable``)."""
    keyed = S.with_short_keys(docs)
    return S.with_spans(keyed, S.removable(keyed, S.plan_for(docs, "words", k, m, **plan), count_windows))


def _kept(text: bytes, spans: list[tuple[int, int]]) -> tuple[list[bytes], int]:
    words = WORD.findall(text)
    n = len(words)
    for s, e in reversed(spans):
        del words[s:e]
    return words, n


def removal_report(docs: DataFrame, k: int = K, m: int = M, **plan: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs``."""

    def make(text: bytes, spans: list[tuple[int, int]]) -> tuple:
        words, n = _kept(text, spans)
        return n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    rows = repeated_words(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, m, **plan)
    return rows.select("doc_id", "text", S.SPANS).mapInArrow(_finish(["n_words", "n_removed", "kept_sha256"], schema, make), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, k: int = K, m: int = M, **plan: int) -> DataFrame:
    """doc_id and ``text`` of the words that stay, joined by one space."""

    def make(text: bytes, spans: list[tuple[int, int]]) -> tuple:
        return (b" ".join(_kept(text, spans)[0]).decode(),)

    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    rows = repeated_words(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, m, **plan)
    return rows.select("doc_id", "text", S.SPANS).mapInArrow(_finish(["text"], schema, make), "doc_id long, text string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(documents(spark, sf_dir))

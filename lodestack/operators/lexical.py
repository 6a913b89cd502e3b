"""Lexical backends of an index: what they store for a chunk and how they rank by it.

``bm25`` stems lightly and sums the fields into one frequency, with statistics of the corpora
searched.  ``fields`` stems by Porter's rules, weighs heading, body and path apart, credits a
query's words in sequence, and has statistics of the whole index, as a full-text table of a
database has.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from ..functions.porter import porter
from ..session import ship
from . import phrases as P
from . import retrieval as R

Asked = Sequence[tuple[int, str]]


class Light:
    name = "bm25"
    counts_tokens = False

    @staticmethod
    def postings(chunks: DataFrame) -> DataFrame:
        """part, term, chunk_id, corpus, words, tf and an empty ``at``."""
        return R.postings(chunks, also=("part", "corpus", "words")).withColumn("at", F.lit(None).cast("array<int>"))

    @staticmethod
    def terms(query: str) -> list[str]:
        """The terms whose postings a query needs."""
        return T.stemmed_terms(query)

    @staticmethod
    def rank(post: DataFrame, terms: DataFrame, n: int, words: int, tokens: int, every: int, asked: Asked, pool: int, corpora: Sequence[str] = ()) -> DataFrame:
        """(query_id, id, score) of the best ``pool`` chunks for each of ``asked`` (query_id, query).
        ``n`` chunks and ``words`` words are those of the corpora searched, ``every`` chunks and
        ``tokens`` postings those of the whole index."""
        rows = [(i, T.stemmed_terms(q)) for i, q in asked]
        queries = post.sparkSession.createDataFrame(rows, "query_id int, terms array<string>")
        return R.bm25_stored(post, terms, n, words, queries, pool, corpora, n_asked=sum(len(t) for _, t in rows))


@lru_cache(200_000)
def folded(token: str) -> str:
    """A token in lower case, without diacritics, by Porter's stem."""
    plain = "".join(c for c in unicodedata.normalize("NFD", token.lower()) if not unicodedata.combining(c))
    return porter(plain)


@F.pandas_udf(ArrayType(StringType()))
def _folded(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ts: None if ts is None else [folded(t) for t in ts])


#: Words with the marks that follow their letters, as a letter and its accent may be two characters.
MARKED = r"[\p{L}\p{N}][\p{L}\p{N}\x{300}-\x{36F}]*"


def raw_words(query: str) -> list[str]:
    return re.findall(r"[^\W_](?:[^\W_]|[̀-ͯ])*", query.lower())


WEIGHTS = {"heading": 2.0, "body": 1.0, "path": 0.5}


class Fields:
    name = "fields"
    counts_tokens = True

    @staticmethod
    def postings(chunks: DataFrame) -> DataFrame:
        """part, term, chunk_id, corpus, words (tokens of all fields), tf and ``at``, the places:
        those of the i-th field start at i * GAP."""
        ship(chunks.sparkSession)
        words = lambda c: F.regexp_extract_all(c, F.lit(f"({MARKED})"), F.lit(1))
        parts = (F.col("heading"), F.col("body"), F.concat_ws("/", "corpus", "rel"))
        return P.postings(chunks, [_folded(words(c)) for c in parts], ("part", "corpus"))

    @staticmethod
    def phrases(query: str) -> list[list[str]]:
        """Each word of a query, and all of them in sequence (stop words too) if they are several."""
        words = raw_words(query)
        return [[folded(t)] for t in T.query_terms(query, words)] + ([[folded(t) for t in words]] if len(words) > 1 else [])

    @staticmethod
    def terms(query: str) -> list[str]:
        return sorted({t for p in Fields.phrases(query) for t in p})

    @staticmethod
    def rank(post: DataFrame, terms: DataFrame | None, n: int, words: int, tokens: int, every: int, asked: Asked, pool: int, corpora: Sequence[str] = ()) -> DataFrame:
        """As :meth:`Light.rank`."""
        return P.rank(post, [(i, Fields.phrases(q)) for i, q in asked], list(WEIGHTS.values()), every, tokens, pool, terms, corpora)


BACKENDS = {b.name: b for b in (Light, Fields)}
# The names that configurations use for them.
BACKENDS |= {"python": Light, "fts5": Fields, "auto": Fields}

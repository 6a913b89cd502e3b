"""Scalar functions on text and vectors, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are not indexed.
STOPWORDS = (
    "a an and are as at be by for from has have how i in is it its of on or that the this to was we what when "
    "where which who why will with you your do does did not no can could should would about into over under "
    "than then there these those they them their our us me my"
).split()

TOKEN = r"[\p{L}\p{N}]+"


def word_count(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("long")


def light_stem(tok: Column) -> Column:
    """One suffix rule, the first that applies: -ies, -ing, -ed, -s but not -ss."""
    n = F.char_length(tok)
    cut = lambda k: F.substring(tok, F.lit(1), n - k)
    return (
        F.when((n > 5) & tok.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 5) & tok.endswith("ing"), cut(3))
        .when((n > 4) & tok.endswith("ed"), cut(2))
        .when((n > 3) & tok.endswith("s") & ~tok.endswith("ss"), cut(1))
        .otherwise(tok)
    )


def cased_tokens(text: Column) -> Column:
    """Tokens as the text has them."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def raw_tokens(text: Column) -> Column:
    return F.transform(cased_tokens(text), lambda t: F.lower(t))


def tokens(text: Column, stem: bool = True) -> Column:
    """Indexed tokens of a text, in order: lower case, two characters at least, no stop words."""
    stop = F.array(*(F.lit(w) for w in STOPWORDS))
    kept = F.filter(raw_tokens(text), lambda t: (F.char_length(t) >= 2) & ~F.array_contains(stop, t))
    return F.transform(kept, light_stem) if stem else kept


def is_indexed(token: Column) -> Column:
    """Of a token in lower case, one to a row: what :func:`tokens` keeps."""
    return (F.char_length(token) >= 2) & ~token.isin(STOPWORDS)


def query_terms(query: str, words: list[str] | None = None) -> list[str]:
    """Unstemmed tokens of a query (or its ``words``); if stop words are all it has, these."""
    found = [t.lower() for t in re.findall(r"[^\W_]+", query)] if words is None else words
    return [t for t in found if len(t) > 1 and t not in STOPWORDS] or found


def stem(token: str) -> str:
    """:func:`light_stem` of one token."""
    rules = ((5, "ies", "y"), (5, "ing", ""), (4, "ed", ""), (3, "s", ""))
    hit = next(((s, r) for n, s, r in rules if len(token) > n and token.endswith(s) and not (s == "s" and token.endswith("ss"))), None)
    return token[: len(token) - len(hit[0])] + hit[1] if hit else token


def stemmed_terms(query: str) -> list[str]:
    """Distinct stemmed tokens of a query, in order, as the index has them."""
    found = (t.lower() for t in re.findall(r"[^\W_]+", query))
    return list(dict.fromkeys(stem(t) for t in found if len(t) > 1 and t not in STOPWORDS))


def path_text(path: Column) -> Column:
    """A path as text to tokenise."""
    return F.translate(path, "/.", "  ")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, words: Column, avg: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * words / avg))


def coverage(query: Column, doc: Column) -> Column:
    """Share of a query's distinct terms that a document has; 0 without terms."""
    q = F.array_distinct(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, doc)) / F.size(q)).otherwise(0.0)


def adaptive_weight(cov: Column, low: float = 0.2, high: float = 1.0) -> Column:
    return high - (high - low) * cov


def snippet(text: Column, terms: list[str], limit: int = 300) -> Column:
    """About ``limit`` characters around the first place where a term shows."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    probes = [t[: max(4, len(t) - 2)] if len(t) > 4 else t for t in terms]
    found = [F.nullif(F.instr(F.lower(flat), p), F.lit(0)) for p in probes]
    first = F.coalesce(found[0] if len(found) == 1 else F.least(*found), F.lit(1)) - 1 if found else F.lit(0)
    rough = F.greatest(F.lit(0), first - limit // 4)
    back = F.instr(F.reverse(F.substring(flat, F.lit(1), rough)), " ")  # distance to the space before
    start = F.when(back > 0, rough - back + 1).otherwise(rough)  # without a space before it, right there
    body = F.substring(flat, start + 1, F.lit(limit))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.trim(body), F.when(start + limit < F.char_length(flat), "...").otherwise(""))
    return F.when(F.char_length(flat) <= limit, flat).otherwise(cut)

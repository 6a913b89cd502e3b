"""Secrets in texts: fixed patterns, and strings of high entropy, in DataFrame functions only.

Base spans come from three patterns.  The method adds candidate strings (runs of a character
class of ``WINDOW`` characters at least) in which some window of ``WINDOW`` characters has a
Shannon entropy of the class's threshold or more, unless the allow-list knows the whole
string.  The window slides by one character: the count of the one that leaves falls by one,
that of the one that enters rises by one, and the sum of n * log2(n) over the counts changes
by two table entries.  The table holds whole millionths, so results are exact.

Positions are sums of lengths: the pieces between the matches and the matches themselves, one
row each, added up by a window over the rows of a text.  Only these lengths and the candidate
strings are shuffled, not the texts.

Edge cases: null and empty texts have no spans; a null doc_id stays null; repeated rows are
scanned each for itself; spans of one start come in the order of ``KINDS``; an added span
within another span is left out; columns of other names in the input don't matter; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import documents, text_of

#: Characters of the sliding window.
WINDOW = 20
#: Base patterns with the least length of what counts: of group 2, or of the whole match.  The
#: letters of "assign" are spelt out, as ignoring case means other letters to other engines.
_NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: Added kinds: the characters of the class and the entropy in bits from which a window counts.
CLASSES = {"entropy_hex": ("0123456789ABCDEFabcdef", 2.8), "entropy_base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 3.4), "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.8)}
#: Whole candidate strings that are no secrets: numbers, words in one case or joined to names,
#: paths and identifiers, identifiers by UUID, and the alphabets themselves.
ALLOW = (
    r"[0-9]+",
    r"[A-Z]+",
    r"([A-Z]?[a-z]{2,})+",
    r"[+/_-]*(([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8})[+/_-]+)*([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8})?",
    r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    r".*(ABCDEFGHIJKLMNOP|abcdefghijklmnop|0123456789ABCDEF|0123456789abcdef).*",
)
KINDS = (*BASE, *CLASSES)
#: Millionths of n * log2(n) for a count of n.
TABLE = tuple(round(1e6 * n * math.log2(n)) if n else 0 for n in range(WINDOW + 1))


def _class(chars: str) -> str:
    return "[" + chars.replace("-", "") + ("-" if "-" in chars else "") + "]"


def pattern(kind: str) -> str:
    return BASE[kind] if kind in BASE else f"{_class(CLASSES[kind][0])}{{{WINDOW},}}"


def most_sum(bits: float) -> int:
    """The sum of n * log2(n), in millionths, that a window of ``bits`` or more does not exceed."""
    return TABLE[WINDOW] - math.ceil(1e6 * bits * WINDOW)


def least_sum(text: Column, chars: str) -> Column:
    """The least sum of n * log2(n) over the counts of any window of ``text``, in millionths."""
    table = F.array(*(F.lit(x) for x in TABLE))
    code = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(chars), c))
    steps = F.transform(F.sequence(F.lit(0), F.char_length(text) - 1), lambda i: F.array(F.struct(F.lit(-1).alias("by"), (i - WINDOW).alias("i")), F.struct(F.lit(1).alias("by"), i.alias("i"))))
    steps = F.filter(F.flatten(steps), lambda s: s["i"] >= 0)
    state = F.struct(F.array_repeat(F.lit(0), len(chars)).alias("n"), F.lit(0).alias("sum"), F.lit(TABLE[WINDOW]).alias("least"))

    def slide(s: Column, e: Column) -> Column:
        at = F.get(code, e["i"])
        was = F.element_at(s["n"], at)
        now = was + e["by"]
        total = s["sum"] + F.get(table, now) - F.get(table, was)
        counts = F.concat(F.slice(s["n"], F.lit(1), at - 1), F.array(now), F.slice(s["n"], at + 1, F.lit(len(chars))))
        full = (e["by"] == 1) & (e["i"] >= WINDOW - 1)
        return F.struct(counts.alias("n"), total.alias("sum"), F.when(full, F.least(s["least"], total)).otherwise(s["least"]).alias("least"))

    return F.aggregate(steps, state, slide, lambda s: s["least"])


def _matches(kind: str, text: Column, where: Column) -> Column:
    """(kind, i, gap, size, value) for each match of a pattern and, last, what follows it: the
    characters since the match before, those of the match, and of group 2 or the match itself."""
    p = F.lit(pattern(kind))
    found, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, pattern(kind), -1)
    value = F.regexp_extract_all(text, p, F.lit(2)) if kind == "assign" else found
    rows = F.transform(found, lambda m, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.char_length(F.get(gaps, i)).alias("gap"), F.char_length(m).alias("size"), F.get(value, i).alias("value")))
    return F.when(where, rows)


def scan(docs: DataFrame, allow: Sequence[str] = ALLOW) -> DataFrame:
    """row, doc_id, kind (a number in KINDS), start, end of every span, in code points, end exclusive; a row
    of ``docs`` (doc_id, text) without spans has one with null kind.  ``row`` tells rows apart."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("row", F.monotonically_increasing_id())
    # a text without a long run has none of the other kinds
    run = F.col("text").rlike(f"{_class(CLASSES['entropy_base64'][0])}{{{WINDOW}}}")
    every = [_matches(k, F.col("text"), F.col("text").rlike(ASSIGN) if k == "assign" else run) for k in KINDS]
    none = F.expr("cast(array() as array<struct<kind int, i int, gap int, size int, value string>>)")
    t = t.select("row", "doc_id", F.explode_outer(F.concat(*(F.coalesce(e, none) for e in every))).alias("m")).select("row", "doc_id", "m.*")
    # all that follows keeps together what is partitioned by row
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.repartition("row").withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(before))
    number = {k: n for n, k in enumerate(KINDS)}
    known = F.lit(False)
    for a in allow:
        known |= F.col("value").rlike(f"^(?:{a})$")
    holds = F.when(F.col("kind") == number["assign"], F.char_length("value") >= ASSIGN_VALUE).when(F.col("kind") < len(BASE), True)
    for k, (chars, bits) in CLASSES.items():
        holds = holds.when(F.col("kind") == number[k], ~known & (least_sum(F.col("value"), chars) <= most_sum(bits)))
    t = t.select("row", "doc_id", F.when(holds, F.struct("kind", (F.col("end") - F.col("size")).alias("start"), "end")).alias("s"))
    t = t.select("row", "doc_id", "s.kind", "s.start", "s.end")
    # a span within another lies behind one that reaches as far; base spans stay
    earlier = Window.partitionBy("row").orderBy(F.col("start").asc_nulls_last(), F.col("end").desc(), "kind").rowsBetween(Window.unboundedPreceding, -1)
    within = (F.col("kind") >= len(BASE)) & (F.max("end").over(earlier) >= F.col("end"))
    t = t.withColumn("within", F.coalesce(within, F.lit(False)))
    return t.select("row", "doc_id", *(F.when(~F.col("within"), F.col(c)).alias(c) for c in ("kind", "start", "end")))


def _of_kind(n: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == n


def report(spans: DataFrame) -> DataFrame:
    """A row for each row of the input: counts by base kind, the base spans' hash, all spans."""
    names = F.array(*(F.lit(k) for k in KINDS))
    text = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    own = F.struct("start", "kind", "end")
    x = spans.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), own))).alias("all"))
    base = F.filter("all", lambda s: s["kind"] < len(BASE))
    counts = [F.size(F.filter("all", _of_kind(n))).cast("long").alias(f"n_{k}") for n, k in enumerate(BASE)]
    return x.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"), F.array_join(F.transform("all", text), ",").alias("spans"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(documents(spark, sf_dir)))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_matches() -> str:
    rows = []
    for n, k in enumerate(KINDS):
        p = _sql_text(pattern(k))
        rows.append(f"SELECT rid, {n} AS kind, unnest(range(1, len(f) + 1)) AS i, unnest(g[1:len(f)]) AS gap, unnest(f) AS m, unnest({'v' if k == 'assign' else 'f'}) AS value FROM (SELECT rid, regexp_extract_all(text, {p}) AS f, {f'regexp_extract_all(text, {p}, 2) AS v, ' if k == 'assign' else ''}regexp_split_to_array(text, {p}) AS g FROM d)")
    return " UNION ALL ".join(rows)


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({_sql_matches()}),
p AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY rid, kind ORDER BY i) AS e FROM m),
c AS (SELECT rid, kind, i, value, unnest(range(1, length(value) - {WINDOW - 2})) AS st FROM p
  WHERE kind >= {len(BASE)} AND NOT ({" OR ".join(f"regexp_full_match(value, {_sql_text(a)})" for a in ALLOW)})),
n AS (SELECT rid, kind, i, st, ch, count(*) AS n FROM (SELECT rid, kind, i, st, unnest(string_split(value[st:st + {WINDOW - 1}], '')) AS ch FROM c) GROUP BY ALL),
h AS (SELECT rid, kind, i, min(s) AS least FROM (SELECT rid, kind, i, st, sum({list(TABLE)}[n + 1]) AS s FROM n GROUP BY ALL) GROUP BY ALL),
s AS (SELECT p.rid, p.kind, (e - length(m))::BIGINT AS st, e::BIGINT AS e FROM p LEFT JOIN h USING (rid, kind, i)
  WHERE (p.kind = 0 AND length(value) >= {ASSIGN_VALUE}) OR p.kind IN (1, 2) OR {" OR ".join(f"(p.kind = {KINDS.index(k)} AND least <= {most_sum(b)})" for k, (_, b) in CLASSES.items())}),
w AS (SELECT *, max(e) OVER (PARTITION BY rid ORDER BY st, e DESC, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
k AS (SELECT rid, kind, st, {list(KINDS)}[kind + 1] || ':' || st || ':' || e AS t FROM w WHERE kind < {len(BASE)} OR before IS NULL OR before < e),
a AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = {n}) AS n_{b}" for n, b in enumerate(BASE))}, string_agg(t, ',' ORDER BY st, kind) FILTER (kind < {len(BASE)}) AS base, string_agg(t, ',' ORDER BY st, kind) AS spans FROM k GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{b}, 0)::BIGINT AS n_{b}" for b in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)
"""

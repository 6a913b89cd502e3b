"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

A rule rejects a document whose metric exceeds a cutoff.  Cutoffs are not guessed: on the
labelled holdout (documents marked good that pass the fixed base rules) an exact binomial
test asks, for each stratum, rule and candidate cutoff, whether more than ``RISK`` of good
documents would be rejected; a cutoff is certified if that is refuted at level ``LEVEL``
divided by the number of tests made (Bonferroni).  The least certified cutoff holds; a
stratum with too few labels certifies none and rejects by the base rules only.  Copies are no
independent trials: the holdout has one text for each doc_id, that of the least hash, and each
text of a stratum once.

Metrics are whole per-mille numbers, so cutoffs compare exactly.  Strata are languages.

Edge cases: null and empty texts have no words and fail the base rules; a null lang is the
stratum ``none``; a document with several labels counts as good only if all say so; labels
without a document are ignored; repeated rows get equal results; an empty table gives an
empty result; no labels certify nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import documents, staged, text_of, words_of

WINDOW = 8
#: Base rules.
MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30
#: False rejections allowed for each rule, and chance that any certified cutoff exceeds them.
RISK, LEVEL = 0.005, 0.05
#: Candidate cutoffs, per mille of the metric's base; fixed before any label is seen.
CUTOFFS = (5, 10, 20, 50, 100, 150, 200, 300, 400, 500, 700, 900)
RULES = ("symbols", "repeated_lines", "repeated_words", "capitals", "word_length")
#: Strata that are broadcast at most.
BROADCAST_STRATA = 100_000


def measure(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, base counts and metrics for every row of ``docs`` (doc_id, text, lang)."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("none")).alias("stratum"), text_of().alias("text"))
    t = t.withColumns({"words": words_of(F.col("text")), "lines": F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    t = t.withColumn("hash", F.transform("words", lambda w: F.xxhash64(w)))
    # window i: the hashes of words i to i + 7, from shifted copies side by side
    shifts = [F.slice("hash", F.lit(i + 1), F.greatest(F.size("hash"), F.lit(1))) for i in range(WINDOW)]
    whole = F.greatest(F.size("hash") - (WINDOW - 1), F.lit(0))
    t = t.withColumn("grams", F.slice(F.transform(F.arrays_zip(*shifts), lambda z: F.xxhash64(z)), F.lit(1), whole))
    sorted_ = F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    t = t.withColumn("sorted", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), sorted_))
    twice = F.zip_with("sorted", F.slice("sorted", F.lit(2), F.greatest(F.size("sorted"), F.lit(1))), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
    t = t.withColumn("at", F.array_sort(F.array_distinct(F.flatten(F.filter(twice, lambda p: p.isNotNull())))))
    steps = F.zip_with("at", F.slice("at", F.lit(2), F.greatest(F.size("at"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    t = t.select(
        "doc_id", "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit(r"[A-Z]")).cast("long").alias("n_capitals"),
        F.md5("text").alias("digest"),
    )
    per_mille = lambda a, b: F.coalesce(F.floor(1000 * F.col(a) / F.nullif(F.col(b), F.lit(0))), F.lit(0)).cast("long")
    metrics = {"symbols": per_mille("n_symbols", "word_chars"), "repeated_lines": per_mille("n_dup_lines", "n_lines"), "repeated_words": per_mille("n_repeat_words", "n_words"), "capitals": per_mille("n_capitals", "word_chars")}
    # characters a word, in tens, so that the same grid spans 0.5 to 90 of them
    metrics["word_length"] = F.coalesce(F.floor(10 * F.col("word_chars") / F.nullif(F.col("n_words"), F.lit(0))), F.lit(0)).cast("long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return t.withColumns({"base_failed": failed, **{f"m_{k}": v for k, v in metrics.items()}})


def log_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) for X binomial (n, p): the terms are added in log space one after another."""
    odds = F.log(F.lit(p / (1 - p)))
    first = n * F.log1p(F.lit(-p))
    start = F.struct(first.alias("term"), first.alias("sum"))

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j) + odds
        high = F.greatest(acc["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(F.least(acc["sum"], term) - high))).alias("sum"))

    return F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("cast(array() as array<bigint>)")), start, add, lambda a: a["sum"])


def certified(measured: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """stratum and one column for each rule: the least cutoff certified on the holdout, or null."""
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q")).dropna().groupBy("doc_id").agg(F.min("q").alias("q")).where("q = 1").select("doc_id")
    metrics = [f"m_{r}" for r in RULES]
    held = measured.where("not base_failed").join(good, "doc_id")
    one = held.groupBy("doc_id").agg(F.min(F.struct("digest", "stratum", *metrics)).alias("x")).select("x.*")
    held = one.groupBy("stratum", "digest").agg(*(F.max(m).alias(m) for m in metrics))  # equal texts have equal metrics
    over = [F.struct(F.lit(r).alias("rule"), sum(((F.col(f"m_{r}") > c).cast("int") for c in CUTOFFS), F.lit(0)).alias("passed")) for r in RULES]
    tally = held.select("stratum", F.explode(F.array(*over)).alias("x")).groupBy("stratum", "x.rule", "x.passed").agg(F.count("*").alias("n"))
    # documents that exceed the i-th cutoff are those that passed at least i of them
    grid = tally.select("stratum", "rule", F.posexplode(F.array(*(F.when(F.col("passed") >= i, F.col("n")).otherwise(0) for i in range(1, len(CUTOFFS) + 1)))).alias("i", "k"), "n")
    grid = grid.groupBy("stratum", "rule", "i").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    grid = grid.withColumn("tests", F.count("*").over(Window.partitionBy()))  # rows of the grid: strata x rules x cutoffs
    hopeless = F.col("k") > F.col("n") * risk  # the tail is then about a half or more
    ok = ~hopeless & (log_tail(F.when(hopeless, F.lit(0)).otherwise(F.col("k")).cast("long"), F.col("n"), risk) <= F.log(F.lit(level) / F.col("tests")))
    cut = F.get(F.array(*(F.lit(c) for c in CUTOFFS)), F.col("i"))
    return grid.groupBy("stratum").agg(*(F.min(F.when(ok & (F.col("rule") == r), cut)).alias(f"c_{r}") for r in RULES))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, base counts, base_failed, kept and the rules that rejected each row of ``docs``."""
    measured = staged(measure(docs, stratum))
    cuts = staged(certified(measured, labels))
    cuts = F.broadcast(cuts) if cuts.count() <= BROADCAST_STRATA else cuts
    x = measured.join(cuts, "stratum", "left")
    hits = F.filter(F.array(*(F.when(F.col(f"m_{r}") > F.col(f"c_{r}"), F.lit(r)) for r in RULES)), lambda r: r.isNotNull())
    x = x.withColumn("rejected_by", hits)
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("rejected_by")


OP10_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, 'none') AS stratum, coalesce(text, '') AS text, md5(coalesce(text, '')) AS digest FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d
), g AS (
  SELECT rid, i, array_to_string(words[i:i+{WINDOW - 1}], ' ') AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)
), rep AS (
  SELECT rid, count(DISTINCT j) AS n FROM (
    SELECT rid, unnest(range(i, i + {WINDOW})) AS j FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1) GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, stratum, digest, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_capitals
  FROM w LEFT JOIN rep USING (rid)
), x AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
         coalesce(1000 * n_symbols // nullif(word_chars, 0), 0) AS m_symbols, coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) AS m_repeated_lines,
         coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) AS m_repeated_words, coalesce(1000 * n_capitals // nullif(word_chars, 0), 0) AS m_capitals,
         coalesce(10 * word_chars // nullif(n_words, 0), 0) AS m_word_length FROM m
), good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
one AS (SELECT x.* FROM x JOIN good USING (doc_id) WHERE NOT base_failed QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY digest, stratum) = 1),
h AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY stratum, digest) = 1),
v AS (
  SELECT stratum, unnest(['symbols', 'repeated_lines', 'repeated_words', 'capitals', 'word_length']) AS rule,
         unnest([m_symbols, m_repeated_lines, m_repeated_words, m_capitals, m_word_length]) AS val FROM h
), grid AS (
  SELECT stratum, rule, c, count(*) FILTER (val > c) AS k, count(*) AS n FROM v, (SELECT unnest({list(CUTOFFS)}) AS c) GROUP BY stratum, rule, c
), tail AS (
  SELECT stratum, rule, c, count(*) OVER () AS tests, k, n,
         list_sum(list_transform(range(0, least(k, (n * {RISK})::BIGINT + 1) + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK}) + (n - j) * ln(1 - {RISK})))) AS p FROM grid
), cut AS (
  SELECT stratum, rule, min(c) AS c FROM tail WHERE k <= n * {RISK} AND p <= {LEVEL} / tests GROUP BY stratum, rule
), cuts AS (
  SELECT stratum, {", ".join(f"min(c) FILTER (rule = '{r}') AS c_{r}" for r in RULES)} FROM cut GROUP BY stratum
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(f"coalesce(m_{r} > c_{r}, false)" for r in RULES)}) AS kept
FROM x LEFT JOIN cuts USING (stratum)
"""

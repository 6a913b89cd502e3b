"""How far sources of a language differ in their words: a heavy-light split of the vocabulary.

Each (lang, source) group gives every kept term a smoothed whole-number share p; two groups
differ by the sum of abs(p - q) over all kept terms.  A term without occurrences in a group
has the group's floor share z, so with d(t) = abs(p - q) - abs(z - z') the sum is
V * abs(z - z') plus d(t) over the terms that either group has.  These come in two parts:

* heavy terms, present in a quarter or more of a language's groups, lie in dense numpy tiles
  of terms x groups, two blocks of groups at a time;
* light terms have short posting lists.  What a term adds to a pair in which one group alone
  has it depends on the count only, so it comes from a histogram of counts of each group; pairs
  of one posting list get the correction for having been counted from both sides.

All parts are whole numbers, so their sum is exact, whatever their order.

Words are counted in Python, one dictionary for each Arrow batch and group, before anything is
shuffled: a frequent word is a row for each group and batch.  A posting list, and the list of
a language's sources, is as long as the language has sources.

Edge cases: null text, lang and source count as ''; repeated rows are documents of their own;
a group without terms is there with floor shares (0 where nothing is kept); ties go by the
item's UTF-8 bytes; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import documents, drop, ship, staged

#: Documents of a language that must have a term for it to be kept.
MIN_DOCS = 30
SMOOTH, SCALE = 5, 1_000_000_000
#: Terms reported for each group.
TOP_TERMS = 50
#: A term in at least one of so many of the language's groups is heavy.
HEAVY_SHARE = 4
#: Groups of a block and, about, heavy terms of a tile.
BLOCK, TILE = 256, 512
#: Groups, or blocks of them, that are broadcast at most: about 10 MB.
BROADCAST_GROUPS, BROADCAST_BLOCKS = 100_000, 4_000
#: Entries of a dictionary before it is handed on, bytes of a text that are split at once.
FLUSH, SLICE = 200_000, 1 << 22

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
GAP = re.compile(rb"[^A-Za-z\x80-\xff]")


def _slices(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > SLICE:
        cut = GAP.search(text, at + SLICE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, df) summed over a task's documents so far; a group's row with an
    empty term says that it occurs.  Bytes above 0x7F are those of letters outside ASCII."""
    n: dict[tuple, Counter] = {}
    df: dict[tuple, Counter] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), words in n.items():
            terms = [b"", *words]
            docs = df[lang, source]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *words.values()], pa.int64()), pa.array([0, *(docs[t] for t in words)], pa.int64())],
                ["lang", "source", "term", "n", "df"],
            )

    for rb in batches:
        texts = rb.column("text").cast(pa.large_binary())
        for lang, source, text in zip(rb.column("lang").to_pylist(), rb.column("source").to_pylist(), texts, strict=True):
            mine: Counter = Counter()
            for part in _slices(text.as_py()):
                mine.update(TERM.findall(part.lower()))  # bytes: only A-Z change
            words = n.setdefault((lang, source), Counter())
            size -= len(words)
            words.update(mine)
            size += len(words)
            df.setdefault((lang, source), Counter()).update(mine.keys())
            if size > FLUSH:
                yield from out()
                n, df, size = {}, {}, 0
    yield from out()


def kept_postings(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term and posts (source, n) of every kept term; the empty term has all sources."""
    ship(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    part = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_count, "lang string, source string, term string, n long, df long")
    part = part.repartition("lang", "term")  # holds for all that follows
    sums = part.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    post = sums.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("posts"))
    return post.where((F.col("df") >= min_docs) | (F.col("term") == "")).drop("df")


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 5) / (total + 5 * kept)), exact for any counts; 0 without terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    over = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (whole(n) + SMOOTH), F.nullif(whole(total) + SMOOTH * whole(kept), F.lit(0).cast("decimal(20,0)")))
    return F.coalesce(1 + over, F.lit(0)).cast("long")


def groups_of(post: DataFrame) -> DataFrame:
    """lang, source, g (from 0 by source), n_groups, total, kept, z, and the language's own total."""
    terms = post.where("term <> ''").withColumn("all", F.aggregate("posts", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("lang_total"))
    totals = terms.select("lang", F.explode("posts").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("total"))
    named = post.where("term = ''").select("lang", F.size("posts").alias("n_groups"), F.posexplode(F.array_sort(F.transform("posts", lambda x: x["source"]))).alias("g", "source"))
    x = named.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["kept", "lang_total", "total"])
    return x.withColumn("z", share(F.lit(0), F.col("total"), F.col("kept")))


def _hint(rows: DataFrame, most: int) -> DataFrame:
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def scored(post: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each kept term and group that has it: shares p of the group, q of the language."""
    terms = post.where("term <> ''").select("lang", "term", F.size("posts").alias("m"), F.aggregate("posts", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("all"), F.explode("posts").alias("x"))
    x = terms.select("lang", "term", "m", "all", "x.source", "x.n").join(_hint(groups, BROADCAST_GROUPS), ["lang", "source"])
    return x.select("lang", "source", "term", "g", "z", "n", (F.col("m") * HEAVY_SHARE >= F.col("n_groups")).alias("heavy"), share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("all"), F.col("lang_total"), F.col("kept")).alias("q"))


class _Sums:
    """Sums by (lang, pair of groups), handed on when they are many."""

    def __init__(self) -> None:
        self.held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, lang: str, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        code, inverse = np.unique((np.minimum(a, b).astype(np.int64) << 32) | np.maximum(a, b), return_inverse=True)
        total = np.zeros(len(code), np.int64)
        np.add.at(total, inverse.ravel(), value)
        self.held.setdefault(lang, []).append((code, total))
        self.size += len(code)
        if self.size > 4 * FLUSH:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        for lang, parts in self.held.items():
            code, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            total = np.zeros(len(code), np.int64)
            np.add.at(total, inverse.ravel(), np.concatenate([t for _, t in parts]))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code >> 32), pa.array(code & 0xFFFFFFFF), pa.array(total)], ["lang", "a", "b", "value"])
        self.held, self.size = {}, 0


PAIR = "lang string, a long, b long, value long"


def _list(rb: pa.RecordBatch, name: str, i: int, *fields: str) -> list[np.ndarray]:
    rows = rb.column(name)[i].values
    return [rows.field(f).to_numpy(zero_copy_only=False) for f in fields]


def _upper(first: np.ndarray, second: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of two blocks of groups, each once: of a block with itself those above the diagonal."""
    a, b = np.meshgrid(first, second, indexing="ij")
    pick = a < b
    return a[pick], b[pick], value[pick]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heavy terms: |p - q| - |z - z'| from a dense tile of the terms for two blocks of groups."""
    sums = _Sums()
    for rb in batches:
        for i in range(rb.num_rows):
            (ga, za), (gb, zb) = _list(rb, "za", i, "g", "z"), _list(rb, "zb", i, "g", "z")
            g, p = _list(rb, "cells", i, "g", "p")
            names = np.unique(np.array(rb.column("cells")[i].values.field("term").to_pylist(), object), return_inverse=True)[1].ravel()
            sides = []
            for gs, zs in ((ga, za), (gb, zb)):
                order = np.argsort(gs)
                dense = np.repeat(zs[order][None, :], names.max() + 1, axis=0)
                at = np.minimum(np.searchsorted(gs[order], g), len(gs) - 1)
                mine = gs[order][at] == g
                dense[names[mine], at[mine]] = p[mine]
                sides.append((gs[order], zs[order], dense))
            (ga, za, da), (gb, zb, db) = sides
            value = -len(da) * np.abs(za[:, None] - zb[None, :])
            for k in range(0, len(ga), 16):  # 16 x BLOCK x TILE numbers at once
                value[k : k + 16] += np.abs(da[:, k : k + 16, None] - db[:, None, :]).sum(axis=0)
            yield from sums.add(rb.column("lang")[i].as_py(), *_upper(ga, gb, value))
    yield from sums.out()


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Light terms: for pairs of a posting list, what the one-sided sums of both have too much."""
    sums = _Sums()
    for rb in batches:
        for i in range(rb.num_rows):
            g, p, z = _list(rb, "cells", i, "g", "p", "z")
            for k in range(len(g) - 1):
                a, b = (p[k], z[k]), (p[k + 1 :], z[k + 1 :])
                value = np.abs(a[0] - b[0]) - np.abs(a[0] - b[1]) - np.abs(a[1] - b[0]) + np.abs(a[1] - b[1])
                yield from sums.add(rb.column("lang")[i].as_py(), np.full(len(value), g[k]), g[k + 1 :], value)
    yield from sums.out()


def _one_sided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For two blocks of groups V * |z - z'| and, from each group's histogram of light shares,
    the sum of |p - z'| - |z - z'|: sorted shares and their running sums answer each z'."""
    sums = _Sums()
    for rb in batches:
        for i in range(rb.num_rows):
            (ga, za), (gb, zb) = _list(rb, "za", i, "g", "z"), _list(rb, "zb", i, "g", "z")
            value = rb.column("kept")[i].as_py() * np.abs(za[:, None] - zb[None, :])
            for mine, others, zs, zo, name in ((ga, gb, za, zb, "ha"), (gb, ga, zb, za, "hb")):
                side = np.zeros((len(mine), len(others)), np.int64)
                g, p, n = _list(rb, name, i, "g", "p", "n") if rb.column(name)[i].is_valid else [np.zeros(0, np.int64)] * 3
                order = np.lexsort((p, g))
                g, p, n = g[order], p[order], n[order]
                for k, x in enumerate(mine):
                    lo, hi = np.searchsorted(g, (x, x + 1))
                    many, mass = (np.concatenate([[0], np.cumsum(v)]) for v in (n[lo:hi], n[lo:hi] * p[lo:hi]))
                    below = np.searchsorted(p[lo:hi], zo)
                    side[k] = mass[-1] - 2 * mass[below] - zo * (many[-1] - 2 * many[below]) - many[-1] * np.abs(zs[k] - zo)
                value += side if name == "ha" else side.T
            yield from sums.add(rb.column("lang")[i].as_py(), *_upper(ga, gb, value))
    yield from sums.out()


def pair_sums(marks: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b (numbers of two groups, a < b) and the sum of abs(p - q) over all kept terms."""
    n_parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.floor(F.col("g") / BLOCK).cast("int").alias("block")
    zs = groups.groupBy("lang", "kept", "n_groups", block).agg(F.collect_list(F.struct(F.col("g").cast("long").alias("g"), "z")).alias("zs"))
    other = lambda x: zs.select("lang", F.col("block").alias(f"b{x}"), F.col("zs").alias(f"z{x}"))

    # heavy: an entry goes to the tiles of its block with every other
    tiles = F.greatest(F.lit(1), F.ceil(F.col("v") / TILE)).cast("long")
    heavy = marks.where("heavy")
    sizes = heavy.groupBy("lang").agg(F.approx_count_distinct("term").alias("v"))  # only sizes the tiles
    per_lang = groups.select("lang", "n_groups").distinct().join(sizes, "lang", "left").select("lang", "n_groups", F.coalesce(tiles, F.lit(1)).alias("tiles"))
    cell = heavy.join(_hint(per_lang, BROADCAST_GROUPS), "lang")
    cell = cell.select("lang", "term", "g", "p", block, F.pmod(F.xxhash64("term"), "tiles").alias("tile"), F.explode(F.sequence(F.lit(0), F.floor((F.col("n_groups") - 1) / BLOCK).cast("int"))).alias("with"))
    cell = cell.groupBy("lang", "tile", F.least("block", "with").alias("ba"), F.greatest("block", "with").alias("bb")).agg(F.collect_list(F.struct(F.col("g").cast("long").alias("g"), "p", "term")).alias("cells"))
    joined = cell.join(_hint(other("a"), BROADCAST_BLOCKS), ["lang", "ba"]).join(_hint(other("b"), BROADCAST_BLOCKS), ["lang", "bb"])
    dense = joined.select("lang", "za", "zb", "cells").mapInArrow(_tiles, PAIR)

    # light: histograms of shares for one side, posting lists for both
    light = marks.where("not heavy")
    hist = light.groupBy("lang", "g", "p").agg(F.count("*").alias("n")).groupBy("lang", block).agg(F.collect_list(F.struct(F.col("g").cast("long").alias("g"), "p", "n")).alias("hist"))
    sides = zs.join(hist, ["lang", "block"], "left")
    of = lambda x, *also: sides.select("lang", *also, F.col("block").alias(f"b{x}"), F.col("zs").alias(f"z{x}"), F.col("hist").alias(f"h{x}"))
    blocks = of("a", "kept").join(of("b"), "lang").where("ba <= bb").repartition(n_parts, "lang", "ba", "bb")
    single = blocks.select("lang", "kept", "za", "ha", "zb", "hb").mapInArrow(_one_sided, PAIR)
    lists = light.groupBy("lang", "term").agg(F.collect_list(F.struct(F.col("g").cast("long").alias("g"), "p", "z")).alias("cells")).where("size(cells) > 1")
    double = lists.select("lang", "cells").mapInArrow(_both, PAIR)
    return dense.union(single).union(double).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: in part ``pair`` every other source of the language
    by its distance, in part ``term`` the ``top`` terms that the group uses more than the language."""
    post = staged(kept_postings(docs, min_docs))
    groups = staged(groups_of(post))
    marks = staged(scored(post, groups))
    drop(post)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = marks.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    pairs = pair_sums(marks, groups)
    both = pairs.select("lang", "value", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("lang", "value", "x.a", "x.b")
    name = lambda g, as_: _hint(groups.select("lang", F.col("g").cast("long").alias(g), F.col("source").alias(as_)), BROADCAST_GROUPS)
    named = both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    pairs = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return terms.unionByName(pairs)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
o AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS c FROM o GROUP BY ALL HAVING count(DISTINCT rid) >= {MIN_DOCS}),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, (1 + {SCALE}::HUGEINT * (coalesce(c.c, 0) + {SMOOTH}) // (coalesce(t.n, 0) + {SMOOTH} * v.v))::BIGINT AS p, (1 + {SCALE}::HUGEINT * (k.c + {SMOOTH}) // (v.n + {SMOOTH} * v.v))::BIGINT AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""

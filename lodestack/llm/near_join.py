"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Texts are sets of five-word shingles; two are linked if the sets' Jaccard similarity is 0.8
or more.

1. Texts with equal sets are one class; all that follows runs on one text of each class.  A
   class has a number of its own, as a doc_id may be null or name several texts.
2. A class gets one label for each of ``TREES`` trees: ``MAX_DEPTH`` MinHash values of a byte
   each.  Each tree's labels are sorted, which makes a prefix trie: classes below one node are
   neighbours, and the longest prefix that a class shares with a neighbour is its match.
   Classes whose match is too short in every tree have no partner and end here.
3. From the longest prefixes on, the classes below each node are compared by all their labels,
   and those that may be alike are tied together.  The similarities found tell what share of
   such pairs a depth reaches; prefixes are shortened to the longest that promises ``RECALL``,
   and of the nodes there only those that branch are looked at.  When the estimate holds, or
   the depth is one at which even pairs at the threshold are reached with that probability,
   shortening ends.
4. Classes tied together are a family.  Within a family every pair is verified on the full
   sets.  A large family is cut into cells by set size, as sets that differ more in size can't
   be linked, and cells into blocks of bounded bytes; tasks take two blocks each, count links
   and return one row for each class.  Pairs are never rows.

So whatever the forest missed inside a family is found too, and links that count are exact
(up to equal 64-bit hashes of different shingles).

Edge cases: null and empty texts, and texts of white space, have no links and are classes of
their own; a text under five words has one shingle; a null doc_id comes last and appears as
null; rows that share a doc_id but not the text are texts like any others; rows that repeat
a doc_id and text are copies of it, of which one stays; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec as V
from ._common import LAST_ID, documents, drop, hot_join, id_key, ship, shuffle_partitions, staged, text_of
from ._components import components

U64 = np.uint64
WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: A label has a byte for each level, so that labels order as numbers do.
TREES, MAX_DEPTH = 24, 8
#: Labels that agree in this much less than the threshold leave a pair out (five standard errors).
MARGIN = 0.16
#: A class compared with all below a node speaks for those that agree with it so much: what is
#: linked to them is then above threshold - MARGIN for that class, too.
COVERS = 0.92
#: Classes of a node that are compared in one task; all below a larger node are tied together.
NODE_CLASSES = 1024
#: Classes and bytes of a block; a task holds two blocks.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Rows that are broadcast at most (16 bytes each, about); beyond, the join shuffles.
BROADCAST_ROWS = 500_000
SEED = 20_240_601
#: Bins of similarity from the threshold to 1 in which pairs are counted.
BINS = 40


def reach(similarity: float | np.ndarray, depth: int, trees: int = TREES) -> float | np.ndarray:
    """Probability that a pair shares a node of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES) -> int:
    """The least shortened depth that may be needed: pairs at the threshold share a node."""
    depth = MAX_DEPTH
    while depth > 1 and reach(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def estimated_recall(found: np.ndarray, depth: int, threshold: float, trees: int = TREES, at: int | None = None) -> float:
    """Share of similar pairs that are reached at depth ``at``, given how many were found in each
    bin of similarity at ``depth``: each pair found stands for 1 / reach of its like."""
    middle = threshold + (np.arange(BINS) + 0.5) / BINS * (1 - threshold)
    every = found / reach(middle, depth, trees)
    return float((every * reach(middle, at or depth, trees)).sum() / every.sum()) if found.sum() else 0.0


def next_depth(found: np.ndarray, depth: int, floor: int, threshold: float, recall: float, trees: int = TREES) -> int | None:
    """The depth to shorten prefixes to, the longest that promises the recall; None if it is
    reached already."""
    if depth == floor or estimated_recall(found, depth, threshold, trees) >= recall:
        return None
    return next((d for d in range(depth - 1, floor, -1) if estimated_recall(found, depth, threshold, trees, d) >= recall), floor)


def _sets(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, bounds): each document's distinct shingles in ascending order."""
    start, end, first = V.word_spans(text, offsets)
    h, doc = V.shingle_rows(V.span_hashes(text, start, end), first, WORDS)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        fresh = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
        h, doc = h[fresh], doc[fresh]
    return h, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))])


def _signatures(trees: int) -> object:
    rng = np.random.default_rng(SEED)
    factor = rng.integers(0, 1 << 63, trees * MAX_DEPTH, dtype=U64) * U64(2) + U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            text, off = V.buffers(rb.column("text"))
            for a, b in V.slices(off):
                h, at = _sets(text[off[a] : off[b]], off[a : b + 1] - off[a])
                has = np.flatnonzero(np.diff(at))
                n = b - a
                low, high = np.zeros(n, U64), np.zeros(n, U64)
                labels = np.zeros((len(has), trees, MAX_DEPTH), np.uint8)
                if len(has):
                    cut = at[has]
                    low[has], high[has] = np.add.reduceat(h, cut), np.add.reduceat(V.mix(h + U64(1)), cut)
                    for i, f in enumerate(factor):
                        x = h * f
                        x ^= x >> U64(32)
                        labels[:, i // MAX_DEPTH, i % MAX_DEPTH] = V.mix(np.minimum.reduceat(x, cut)) >> U64(56)
                raw = pa.array([x.tobytes() for x in labels], pa.binary())
                place = np.full(n, -1)
                place[has] = np.arange(len(has))
                part = rb.slice(a, n)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("tag"), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.array(np.diff(at).astype(np.int64)), raw.take(pa.array(place, pa.int64(), mask=place < 0))], ["key", "tag", "low", "high", "n", "labels"])

    return run


def _tries(floor: int) -> object:
    """From (tree, label, cls) sorted by label: the rows that share at least ``floor`` values
    with a neighbour.  The first and last row of a partition stay, as their neighbours in the
    next one are not known here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree", "label", "cls"]
        held = [np.zeros(0, np.int64)] * 3  # the last row so far, and whether it is known to stay
        stays = True
        for rb in batches:
            if not len(rb):
                continue
            tree, label, cls = (np.concatenate([h, rb.column(c).to_numpy()]) for h, c in zip(held, names, strict=True))
            top = label.view(U64) >> U64(64 - 8 * floor)
            near = (tree[1:] == tree[:-1]) & (top[1:] == top[:-1])
            keep = np.append(near, False) | np.append(stays, near)
            stays = bool(near[-1]) if len(near) else True
            held = [x[-1:] for x in (tree, label, cls)]
            keep[-1] = False  # decided with the next row
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (tree, label, cls)], names)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in held], names)

    return run


def _ties(depth: int, above: int, threshold: float) -> object:
    """From rows (tree, node, cls, labels) sorted by node: a tie (a, b) from each class to the
    first one below the node that it hangs together with, and rows (bin, pairs) that count the pairs compared by estimated similarity, each
    where it is first met: at its longest shared prefix, in the first such tree.  Prefixes of
    ``above`` values and more were looked at before."""
    noise = 1 / 256  # different values with equal bytes

    def node(tree: int, labels: np.ndarray, count: np.ndarray) -> np.ndarray:
        """For each class below a node the first one that it is tied to through others."""
        root, covered = np.arange(len(labels)), np.zeros(len(labels), bool)
        for i in range(len(labels)):
            if covered[i]:
                continue
            same = labels == labels[i]
            alike = (same.mean((1, 2)) - noise) / (1 - noise)
            hit = np.flatnonzero(alike >= threshold - MARGIN)
            shared = np.logical_and.accumulate(same[hit], 2).sum(2)
            most = shared.max(1)
            fresh = (hit > i) & (most >= depth) & (most < above) & (shared.argmax(1) == tree) & (alike[hit] >= threshold)
            count += np.bincount(np.minimum(((alike[hit][fresh] - threshold) / (1 - threshold) * BINS).astype(int), BINS - 1), minlength=BINS)
            covered[hit[alike[hit] >= COVERS]] = True
            tied = np.unique(root[hit])
            if len(tied) > 1:
                root[np.isin(root, tied)] = tied[0]
        return root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "bin", "pairs"]
        count = np.zeros(BINS, np.int64)

        def done(now: tuple, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
            labels = np.frombuffer(b"".join(x for _, x in held), np.uint8).reshape(len(held), -1, MAX_DEPTH)
            cls, root = np.array([c for c, _ in held], np.int64), node(now[0], labels, count)
            of = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(cls[of]), pa.array(cls[root[of]]), pa.nulls(len(of), pa.int32()), pa.nulls(len(of), pa.int64())], names)

        now, held = None, []
        for rb in batches:
            for at in zip(*(rb.column(c).to_pylist() for c in ("tree", "node", "cls", "labels")), strict=True):
                if at[:2] != now and held:
                    yield done(now, held)
                    held = []
                now = at[:2]
                held.append(at[2:])
        if held:
            yield done(now, held)
        some = np.flatnonzero(count)
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(some.astype(np.int32)), pa.array(count[some])], names)
        V.trim()

    return run


def forest_ties(classes: DataFrame, threshold: float, recall: float, trees: int) -> DataFrame:
    """Ties (a, b) between ``classes`` (cls, labels) that the forest finds; see the module's
    steps 2 and 3."""
    spark = classes.sparkSession
    floor = depth_for(threshold, recall, trees)
    number = lambda t: F.conv(F.hex(F.substring("labels", 8 * t + 1, 8)), 16, -10).cast("long")
    every = classes.select("cls", F.posexplode(F.array(*(number(t) for t in range(trees)))).alias("tree", "label"))
    # sorted by unsigned label: the sign bit is flipped for the order only
    order = ["tree", F.col("label").bitwiseXOR(F.lit(-(1 << 63)))]
    parts = max(shuffle_partitions(spark), 1)
    tries = every.select(F.col("tree").cast("long").alias("tree"), "label", "cls").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    matched = staged(tries.mapInArrow(_tries(floor), "tree long, label long, cls long"))
    labels = staged(classes.join(matched.select("cls").distinct(), "cls", "left_semi").select("cls", "labels"))
    ties, found, old = [], np.zeros(BINS), []
    depth: int | None = MAX_DEPTH
    above = MAX_DEPTH + 1
    while depth is not None:
        prefix = lambda d: F.shiftrightunsigned("label", 64 - 8 * d)
        rows = matched.select("tree", prefix(depth).alias("node"), (prefix(above) if above <= MAX_DEPTH else F.col("cls")).alias("child"), "cls")
        nodes = rows.groupBy("tree", "node").agg(F.count("*").alias("size"), F.min("cls").alias("least"), F.min("child").alias("c0"), F.max("child").alias("c1")).where("c0 <> c1").select("tree", "node", "size", "least")
        nodes = staged(nodes)  # only where the trie branches
        total = nodes.agg(F.sum("size")).first()[0] or 0
        inside = hot_join(rows.select("tree", "node", "cls"), nodes.withColumn("n", F.col("size")), ["tree", "node"], "n", total)
        fit = inside.where(F.col("size") <= NODE_CLASSES).join(labels, "cls").select("tree", "node", "cls", "labels")
        tied = fit.repartition("tree", "node").sortWithinPartitions("tree", "node", "cls").mapInArrow(_ties(depth, above, threshold), "a long, b long, bin int, pairs long")
        wide = inside.where(F.col("size") > NODE_CLASSES).select(F.col("cls").alias("a"), F.col("least").alias("b"), F.lit(None).cast("int").alias("bin"), F.lit(None).cast("long").alias("pairs"))
        level = staged(tied.union(wide))
        old += [nodes, level]
        ties.append(level.where("a is not null").select("a", "b"))
        for r in level.where("bin is not null").groupBy("bin").agg(F.sum("pairs").alias("n")).collect():  # BINS rows at most
            found[r["bin"]] += r["n"]
        above, depth = depth, next_depth(found, depth, floor, threshold, recall, trees)
    out = staged(reduce(DataFrame.union, ties).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    drop(matched, labels, *old)
    return out


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        text, off = V.buffers(rb.column("text"))
        for a, b in V.slices(off):
            h, at = _sets(text[off[a] : off[b]], off[a : b + 1] - off[a])
            sets = [h[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            part = rb.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column("cls"), part.column("family"), part.column("cells"), part.column("own"), pa.array(sets, pa.binary())], ["cls", "family", "cells", "own", "items"])


def overlaps(sets: list[np.ndarray], first: int) -> np.ndarray:
    """Sizes of the intersections of the first ``first`` sets with the others (with each other,
    if they are all): products of membership matrices, some columns at a time."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    items = np.concatenate(sets)
    order = np.argsort(items, kind="stable")
    items, row = items[order], row[order]
    begin = np.flatnonzero(np.append(True, items[1:] != items[:-1]))
    size = np.diff(np.append(begin, len(items)))
    column = np.repeat(np.cumsum(size > 1) - 1, size)
    shared = np.repeat(size > 1, size)  # what one set alone has is in no intersection
    row, column = row[shared], column[shared]
    split = n if first == n else first
    out = np.zeros((split, n if first == n else n - first), np.float32)
    step = max(256, (1 << 20) // n)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [c, c + step])
        x = np.zeros((n, step), np.float32)
        x[row[a:b], column[a:b] - c] = 1
        out += x[:split] @ (x if first == n else x[first:]).T
    return out


def _links(threshold: float) -> object:
    def group(rows: list[tuple[int, bytes]], others: list[tuple[int, bytes]]) -> dict[int, list[int]]:
        """For each class its links here and the least class that links lead to."""
        keys = np.array([k for k, _ in rows + others], np.int64)
        sets = [np.frombuffer(s, U64) for _, s in rows + others]
        sizes, m = np.array([len(s) for s in sets]), len(rows)
        inter = overlaps(sets, m)
        a, b = sizes[:m, None], (sizes[None, m:] if others else sizes[None, :])
        linked = inter >= threshold * (a + b - inter) - 1e-6
        if not others:
            np.fill_diagonal(linked, False)
            degree = linked.sum(1)
        else:
            degree = np.concatenate([linked.sum(1), linked.sum(0)])
        label = keys.copy()
        while True:  # least label over links, until it rests
            left, right = label[:m], label[m:] if others else label
            new_left = np.minimum(left, np.where(linked, right[None, :], LAST_ID).min(1, initial=LAST_ID))
            new = np.concatenate([new_left, np.minimum(right, np.where(linked, new_left[:, None], LAST_ID).min(0, initial=LAST_ID))]) if others else new_left
            if (new == label).all():
                break
            label = new
        return {k: [d, t] for k, d, t in zip(keys.tolist(), degree.tolist(), label.tolist(), strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(now: tuple, held: list[dict]) -> pa.RecordBatch:
            _, i, j = now
            rows = [(r["cls"], r["items"]) for r in held if r["own"] == i]
            got = group(rows, [] if i == j else [(r["cls"], r["items"]) for r in held if r["own"] == j])
            return pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array([x[0] for x in got.values()], pa.int64()), pa.array([x[1] for x in got.values()], pa.int64()), pa.array([held[0]["split"]] * len(got))], ["cls", "links", "link_to", "split"])

        now, held = None, []
        for rb in batches:
            for row in rb.to_pylist():
                at = (row["family"], row["i"], row["j"])
                if at != now and held:
                    yield done(now, held)
                    held = []
                now = at
                held.append(row)
        if held:
            yield done(now, held)
        V.trim()

    return run


def _tag() -> Column:
    """Tells the texts of one doc_id (or of none) apart."""
    return F.xxhash64(text_of())


def _small(df: DataFrame, lists: str | None = None) -> DataFrame:
    """Broadcasting for few rows, counting the entries of a column of lists as rows too."""
    entries = F.greatest(F.size(lists), F.lit(0)) if lists else F.lit(0)  # a null list has size -1 or null
    n = df.agg(F.sum(1 + F.coalesce(entries, F.lit(0))).alias("n")).first()["n"] or 0
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _cells(families: DataFrame, classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """(cls, key, tag, family, own, cells): the cell of each class (size class of its set, and a
    block in it, as one number) and the cells it is compared with; null ``cells`` for classes
    of families that fit in one block."""
    members = families.select(F.col("vertex").alias("cls"), F.col("root").alias("family")).join(classes, "cls")
    room = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(8 * size / BLOCK_BYTES)).cast("int")
    fam = members.groupBy("family").agg(room(F.count("*"), F.sum("n")).alias("blocks")).where("blocks > 1").select("family")
    # sets of sizes a < b are linked only if a / b is the threshold or more
    size_class = F.floor(F.log("n") / float(-np.log(threshold)) + 1e-9).cast("int") if threshold < 1 else F.col("n").cast("int")
    members = members.withColumn("q", size_class)
    cells = members.join(_small(fam), "family", "left_semi").groupBy("family", "q").agg(room(F.count("*"), F.sum("n")).alias("blocks"))
    grid = cells.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("q", "blocks"))).alias("grid"))  # one entry for each size class
    x = members.join(_small(staged(grid)), "family", "left")
    base = lambda q: q.cast("long") * (1 << 32)
    own = base(F.col("q")) + F.pmod(F.xxhash64("cls"), F.col("grid")[F.col("q")])

    def cells_of(q: Column) -> Column:
        some = F.transform(F.sequence(F.lit(0), F.col("grid")[q] - 1), lambda i: base(q) + i)
        return F.when(F.col("grid")[q].isNotNull(), some).otherwise(F.expr("cast(array() as array<bigint>)"))

    near = F.concat(*(cells_of(F.col("q") + d) for d in (-1, 0, 1)))
    return x.select("cls", "key", "tag", "family", F.when(F.col("grid").isNotNull(), own).otherwise(0).alias("own"), F.when(F.col("grid").isNotNull(), near).alias("cells"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, block: int = BLOCK) -> DataFrame:
    """(key, tag, class_id, n_links, n_copies, first) for every row of ``docs`` (doc_id, text):
    class_id is the least doc_id key that chains of links lead to, n_links the number of other
    texts within the threshold, n_copies the documents with the same shingles; ``first`` are
    the rows of the one text (tag) that stands for all that are chained."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(id_key().alias("key"), _tag().alias("tag"), text_of().alias("text"))
    signed = staged(rows.mapInArrow(_signatures(trees), "key long, tag long, low long, high long, n long, labels binary"))
    classes = signed.where("n > 0").groupBy("low", "high").agg(F.min(F.struct("key", "tag")).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("labels").alias("labels"))
    classes = staged(classes.withColumn("cls", F.monotonically_increasing_id()))
    ties = forest_ties(classes.select("cls", "labels"), threshold, recall, trees)
    families = components(ties)
    members = staged(_cells(families, classes.select("cls", "n", "rep.key", "rep.tag"), threshold, block))
    text = rows.join(_small(members, "cells"), ["key", "tag"]).dropDuplicates(["cls"])
    items = text.select("cls", "family", "cells", "own", "text").mapInArrow(_shingles, "cls long, family long, cells array<long>, own long, items binary")
    pair = F.transform(F.coalesce("cells", F.array(F.lit(0).cast("long"))), lambda o: F.struct(F.least(o, "own").alias("i"), F.greatest(o, "own").alias("j")))
    pairs = items.withColumn("p", F.explode(pair)).select("family", "p.i", "p.j", "own", F.col("cells").isNotNull().alias("split"), "cls", "items")
    linked = staged(pairs.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "cls").mapInArrow(_links(threshold), "cls long, links long, link_to long, split boolean"))
    degree = linked.groupBy("cls").agg(F.sum("links").alias("n_links"), F.min("link_to").alias("near"))
    chains = components(linked.where("split and cls <> link_to").select(F.col("cls").alias("a"), F.col("link_to").alias("b")))
    root = staged(degree.join(chains, F.col("cls") == F.col("vertex"), "left").select("cls", "n_links", F.coalesce("root", "near").alias("chain")).join(members.select("cls", "key", "tag"), "cls"))
    head = root.groupBy("chain").agg(F.min(F.struct("key", "tag", "cls")).alias("head"), F.count("*").alias("size"))
    root = hot_join(root, head, ["chain"], "size", classes.count()).select("cls", "n_links", F.col("head.key").alias("class_id"), (F.col("head.cls") == F.col("cls")).alias("leads"))
    named = classes.select("low", "high", "copies", "rep", "cls").join(root, "cls", "left")
    named = staged(named.select("low", "high", "copies", "rep", F.coalesce("class_id", "rep.key").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("leads", F.lit(True)).alias("leads")))
    # rows beside their class; a class of very many copies is broadcast
    marked = named.select("low", "high", F.col("copies").alias("n_copies"), "copies", "rep", "class_id", "n_links", "leads")
    out = hot_join(signed.where("n > 0").select("key", "tag", "low", "high"), marked, ["low", "high"], "copies", signed.count())
    first = F.col("leads") & (F.col("key") == F.col("rep.key")) & (F.col("tag") == F.col("rep.tag"))
    out = out.select("key", "tag", "class_id", "n_links", "n_copies", first.alias("first"))
    drop(ties, members, linked, classes)
    bare = signed.where("n = 0").select("key", "tag", F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.lit(True).alias("first"))
    return out.union(bare)


def keep_first(docs: DataFrame, **options: float) -> DataFrame:
    """One row of ``docs`` for all that chains of links lead to: that of the least doc_id (of
    several texts under it the one of the least tag, of repeated rows the one of the least hash).
    Texts without words all stay."""
    cols = docs.columns
    marks = near_duplicates(docs, **options).where("not first or n_copies > 1").groupBy(F.col("key").alias("__ls_key"), F.col("tag").alias("__ls_tag"))
    marks = staged(marks.agg(F.max("first").alias("__ls_first"), F.count("*").alias("__ls_rows")).where("not __ls_first or __ls_rows > 1"))
    keyed = docs.select(*cols, id_key().alias("__ls_k"), _tag().alias("__ls_t"))
    on = (F.col("__ls_k") == F.col("__ls_key")) & (F.col("__ls_t") == F.col("__ls_tag"))
    kept = keyed.join(_small(marks), on, "left_anti").select(*cols)
    again = marks.where("__ls_first")
    if again.isEmpty():
        return kept
    # merged in map tasks, so that a row repeated very often doesn't gather in one task
    one = keyed.join(_small(again), on).groupBy("__ls_key", "__ls_tag").agg(F.min_by(F.struct(*cols), F.xxhash64(*cols)).alias("__ls_row"))
    return kept.union(one.select(*(F.col("__ls_row")[c].alias(c) for c in cols)))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document; class_id is null only for the class of a null doc_id."""
    real = lambda c: F.nullif(F.col(c), F.lit(LAST_ID))
    return near_duplicates(documents(spark, sf_dir)).select(real("key").alias("doc_id"), real("class_id").alias("class_id"), "n_links", "n_copies")

"""Markdown and plain text into chunks: heading-scoped, merged when small, split when long.

All of it is Column expressions over one row, so a table of texts is chunked where it lies,
without a shuffle and without Python.  A text becomes an array of lines; only lines that are
headings or fence marks go through a fold, which keeps the fence's state; the headings' paths
come from a second one.  Neighbouring sections are merged by a fold over the sections of a
text, and paragraphs packed by one over paragraphs: both keep where the current group began
and note only where a new one begins, so long texts don't copy growing arrays at each step.

Edge cases: null and empty texts have no chunks; columns of other names pass as they are
asked for; repeated files are chunked each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ends of lines, white space, a heading line, a fence mark, a field above the text.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
SPACE = r"(?U)[\s\x1c-\x1f]"
HEADING = r"^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$"
FENCE = rf"^{SPACE}{{0,3}}(?:```|~~~)"
FIELD = rf"^(name|title|description):{SPACE}*(.*)$"

CHUNK_SCHEMA = "corpus string, rel string, path string, title string, ordinal int, heading string, line_start int, line_end int, words int, body string, hash string"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""))


def lines_of(text: Column) -> Column:
    """The lines of a text without their ends; a last end begins no line."""
    every = F.split(text, LINE_END, -1)
    return F.when(F.element_at(every, -1) == "", F.slice(every, F.lit(1), F.size(every) - 1)).otherwise(every)


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _part(a: Column, first: Column, last: Column) -> Column:
    """Elements ``first`` to ``last`` of an array, counted from 1; none if there are none."""
    return F.slice(a, first, F.greatest(last - first + 1, F.lit(0)))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + x)


def _runs(cuts: Column, total: Column) -> Column:
    """(a, b) for runs of 1..total that begin at each of ``cuts``."""
    ends = F.concat(F.slice(cuts, F.lit(2), F.size(cuts)), F.array(total + 1))
    return F.when(F.size(cuts) > 0, F.zip_with(cuts, ends, lambda a, b: F.struct(a.alias("a"), (b - 1).alias("b")))).otherwise(_empty("struct<a:int,b:int>"))


def with_sections(files: DataFrame, text: str = "text") -> DataFrame:
    """``files`` and ``lines`` (n, t, w: number, text, words), ``fields`` (key, value) and
    ``sections`` (level, head, path, a, b, words, full: has text beyond its heading)."""
    x = files.withColumn("raw", lines_of(F.coalesce(F.col(text), F.lit(""))))
    shut = F.array_position(F.transform(F.slice("raw", F.lit(2), F.greatest(F.size("raw"), F.lit(1))), strip), "---")
    x = x.withColumn("skip", F.when((strip(F.get("raw", F.lit(0))) == "---") & (shut > 0), shut.cast("int") + 1).otherwise(0))
    x = x.withColumn("lines", F.transform("raw", lambda t, i: F.struct((i + 1).alias("n"), t.alias("t"), n_words(t).alias("w"))))
    named = F.filter(_part(F.col("raw"), F.lit(2), F.col("skip") - 1), lambda t: t.rlike(FIELD))
    value = lambda t: strip(F.regexp_extract(t, FIELD, 2))
    quoted = lambda v: v.rlike("(?s)^(\".*\"|'.*')$")
    x = x.withColumn("fields", F.transform(named, lambda t: F.struct(F.regexp_extract(t, FIELD, 1).alias("key"), F.when(quoted(value(t)), F.substring(value(t), F.lit(2), F.char_length(value(t)) - 2)).otherwise(value(t)).alias("value"))))

    # headings that aren't inside a fence; any mark of a fence toggles it
    event = lambda z: F.struct(z["n"].alias("n"), z["t"].rlike(FENCE).alias("fence"), F.length(F.regexp_extract(z["t"], HEADING, 1)).alias("level"), strip(F.regexp_extract(z["t"], HEADING, 2)).alias("head"))
    events = F.transform(F.filter("lines", lambda z: (z["n"] > F.col("skip")) & z["t"].rlike(rf"{FENCE}|^#{{1,6}}[ \t]")), event)
    head = "struct<n:int,level:int,head:string>"

    def meet(s: Column, e: Column) -> Column:
        shut = s["shut"] != e["fence"]
        counts = ~shut & (e["level"] > 0)
        return F.struct(shut.alias("shut"), F.when(counts, F.concat(s["heads"], F.array(F.struct(e["n"].alias("n"), e["level"].alias("level"), e["head"].alias("head"))))).otherwise(s["heads"]).alias("heads"))

    x = x.withColumn("heads", F.aggregate(events, F.struct(F.lit(False).alias("shut"), _empty(head).alias("heads")), meet, lambda s: s["heads"]))

    # the path of a heading: those above it with a lesser level, and itself
    def climb(s: Column, h: Column) -> Column:
        trail = F.concat(F.filter(s["trail"], lambda t: t["level"] < h["level"]), F.array(h))
        return F.struct(trail.alias("trail"), F.concat(s["paths"], F.array(F.transform(trail, lambda t: t["head"]))).alias("paths"))

    x = x.withColumn("paths", F.aggregate("heads", F.struct(_empty(head).alias("trail"), _empty("array<string>").alias("paths")), climb, lambda s: s["paths"]))
    begun = lambda n, level, head, path: F.struct(n.alias("n"), level.alias("level"), head.alias("head"), path.alias("path"))
    first = F.array(begun(F.col("skip") + 1, F.lit(0), F.lit(""), _empty("string")))
    x = x.withColumn("begun", F.concat(first, F.zip_with("heads", "paths", lambda h, p: begun(h["n"], h["level"], h["head"], p))))
    last = lambda i: F.coalesce(F.get(F.col("begun"), i + 1)["n"] - 1, F.size("lines"))
    size = lambda a, b: _sum(F.transform(_part(F.col("lines"), a, b), lambda z: z["w"]))
    made = F.transform("begun", lambda h, i: F.struct(h["level"].alias("level"), h["head"].alias("head"), h["path"].alias("path"), h["n"].alias("a"), last(i).alias("b"), size(h["n"], last(i)).alias("words"), size(h["n"] + 1, last(i)).alias("below")))
    x = x.withColumn("sections", F.filter(made, lambda s: (s["level"] > 0) | (s["words"] > 0)))
    return x.drop("raw", "heads", "paths", "begun")


def _takes(a: Column, b: Column) -> Column:
    """Whether section ``b`` belongs below the heading of ``a``, or beside it."""
    n = F.size(a["path"])
    above = lambda s: F.slice(s["path"], F.lit(1), F.greatest(F.size(s["path"]) - 1, F.lit(0)))
    return (n > 0) & ((F.slice(b["path"], F.lit(1), n) == a["path"]) | ((a["level"] == b["level"]) & (above(a) == above(b))))


def grouped(sections: Column, least: int, target: int) -> Column:
    """(a, b), numbers of the first and last of neighbouring sections that are merged: a group
    below ``least`` words takes what follows under its heading, otherwise a small section is
    taken while the group stays within ``target``."""

    def take(s: Column, i: Column) -> Column:
        own, lead = F.get(sections, i - 1), F.get(sections, s["lead"] - 1)
        same = (s["lead"] > 0) & _takes(lead, own) & ((s["size"] < least) | ((own["words"] < least) & (s["size"] + own["words"] <= target)))
        return F.when(F.coalesce(same, F.lit(False)), F.struct(s["lead"].alias("lead"), (s["size"] + own["words"]).alias("size"), s["cuts"].alias("cuts"))).otherwise(F.struct(i.alias("lead"), own["words"].alias("size"), F.concat(s["cuts"], F.array(i)).alias("cuts")))

    start = F.struct(F.lit(0).alias("lead"), F.lit(0).alias("size"), _empty("int").alias("cuts"))
    each = F.when(F.size(sections) > 0, F.sequence(F.lit(1), F.size(sections))).otherwise(_empty("int"))
    return _runs(F.aggregate(each, start, take, lambda s: s["cuts"]), F.size(sections))


def packed(full: Column, most: int) -> Column:
    """(a, b), places in ``full`` (the lines with words of a text that is too long): paragraphs
    together up to ``most`` words; one that is too long by itself is cut between lines."""
    n = F.size(full)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(_empty("int"))
    begins = F.filter(places, lambda i: (i == 1) | (F.get(full, i - 1)["n"] > F.get(full, i - 2)["n"] + 1))
    words = lambda a, b: _sum(F.transform(_part(full, a, b), lambda z: z["w"]))
    unit = lambda a, b, w, big: F.struct(a.alias("a"), b.alias("b"), w.alias("w"), big.alias("big"))
    whole = F.transform(_runs(begins, n), lambda r: unit(r["a"], r["b"], words(r["a"], r["b"]), F.lit(0)))
    units = F.flatten(F.transform(whole, lambda u: F.when(u["w"] > most, F.transform(F.sequence(u["a"], u["b"]), lambda i: unit(i, i, F.get(full, i - 1)["w"], u["a"]))).otherwise(F.array(u))))

    def pack(s: Column, u: Column) -> Column:
        fits = (u["big"] == s["big"]) & (s["size"] + u["w"] <= most)
        return F.when(fits, F.struct(s["big"].alias("big"), (s["size"] + u["w"]).alias("size"), s["cuts"].alias("cuts"))).otherwise(F.struct(u["big"].alias("big"), u["w"].alias("size"), F.concat(s["cuts"], F.array(u["a"])).alias("cuts")))

    start = F.struct(F.lit(-1).alias("big"), F.lit(0).alias("size"), _empty("int").alias("cuts"))
    return _runs(F.aggregate(units, start, pack, lambda s: s["cuts"]), n)


def chunk_files(files: DataFrame, min_words: int = 60, target_words: int = 500, max_words: int = 800, also: Sequence[str] = ()) -> DataFrame:
    """Chunks of ``files`` (corpus, rel, path, text), with columns ``also`` of the file."""
    x = with_sections(files.select("corpus", "rel", "path", *also, "text")).drop("text")
    field = lambda k: F.nullif(F.try_element_at(F.filter("fields", lambda f: f["key"] == k), F.lit(-1))["value"], F.lit(""))
    top = F.nullif(F.get(F.filter("sections", lambda s: s["level"] == 1), F.lit(0))["head"], F.lit(""))
    stem = F.regexp_replace(F.regexp_extract("rel", r"([^/]*)/*$", 1), r"(?<=.)\.[^.]+$", "")
    x = x.withColumn("title", F.coalesce(top, field("name"), field("title"), stem))
    x = x.withColumn("about", F.coalesce(F.substring(field("description"), 1, 160), F.lit("")))

    def group(g: Column) -> Column:
        parts = _part(F.col("sections"), g["a"], g["b"])
        full = F.filter(parts, lambda s: F.when(s["level"] > 0, s["below"] > 0).otherwise(s["words"] > 0))
        path = F.array_join(F.coalesce(F.get(full, F.lit(0)), F.get(parts, F.lit(0)))["path"], " > ")
        lines = _part(F.col("lines"), F.get(parts, F.lit(0))["a"], F.element_at(parts, -1)["b"])
        return F.struct(path.alias("path"), _sum(F.transform(parts, lambda s: s["words"])).alias("words"), lines.alias("lines"))

    x = x.withColumn("groups", F.transform(grouped(F.col("sections"), min_words, target_words), group))
    x = x.withColumn("full", F.transform("groups", lambda g: F.filter(g["lines"], lambda z: z["w"] > 0)))
    x = x.select("corpus", "rel", "path", *also, "title", "about", F.arrays_zip("groups", "full").alias("groups"))

    def pieces(g: Column) -> Column:
        whole = F.array(g["groups"]["lines"])
        long = F.transform(packed(g["full"], max_words), lambda r: _part(g["full"], r["a"], r["b"]))
        return F.transform(F.when(g["groups"]["words"] > max_words, long).otherwise(whole), lambda p: F.struct(g["groups"]["path"].alias("path"), p.alias("lines")))

    x = x.select("corpus", "rel", "path", *also, "title", "about", F.posexplode(F.flatten(F.transform("groups", pieces))).alias("ordinal", "piece"))
    x = x.withColumn("full", F.filter("piece.lines", lambda z: z["w"] > 0)).withColumn("body", strip(F.array_join(F.transform("piece.lines", lambda z: z["t"]), "\n")))
    heading = F.coalesce(F.nullif("piece.path", F.lit("")), F.col("about"))
    x = x.select("corpus", "rel", "path", *also, "title", "ordinal", heading.alias("heading"), F.get("full", F.lit(0))["n"].alias("line_start"), F.element_at("full", -1)["n"].alias("line_end"), _sum(F.transform("full", lambda z: z["w"])).alias("words"), "body")
    return x.withColumn("hash", F.sha2(F.concat_ws("\n", "heading", "body"), 256))

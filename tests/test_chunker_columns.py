"""The chunker's DataFrame functions against the plain Python version."""

import random

import pytest
from plain_chunker import chunks, title

from lodestack.operators import chunker

ALPHA = "# Alpha notes\nIntro line with words.\n\n## Installation\nRun the thing.\n```sh\n# a comment\n```\n\n## Troubleshooting\n### First\nTry again.\n### Second\nWait.\n"
LONG = "# Book\n## Part\n" + "\n\n".join(" ".join(f"p{i}w{j}" for j in range(120)) for i in range(12)) + "\n"
FIXED = [
    None, "", "\n", " \n\t\n", "one line", "two\nlines\n", ALPHA, "# Beta\nshort\n## More\nalso short\n", "plain text\nno heading\n", LONG,
    '---\nname: gamma\ndescription: "A quoted fact"\nmetadata:\n  name: nested\n---\nThe fact itself.\n', "---\nname: x\nno end", "---\n---\n# T\nx", "---\nname: \ntitle: 'T'\n---\n\n\n", "---\nname: a\nname: b\ndescription: " + "d" * 200 + "\n---\nbody",
    "~~~\n# a\n```\n# b\n```\n# never", "# C#\ntext\n# #\n####### seven\n#no\n # indented\n", "# Top\n### Deep\nx\n## Mid\ny\n###### Six\nz\n# Next\n", "   ```\n# in\n   ~~~\n# out", "    ```\n# four spaces",
    "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h i\r\n", "# É x \n　 \nwort wort", "# Tiny\na\n## Large\n" + "w " * 900 + "\n## Tail\nx\n", "## S\n" + "\n".join("w " * 10 for _ in range(100)) + "\n\nend words here\n\n" + "v " * 700, "w " * 2000,
    "#  \nempty heading\n", "pre\n# One\n" + "a " * 59 + "\n# Two\nb\n# Three\n" + "c " * 480, "x\x1fy z\n\n\n\nq", "# T\n\n\n```\n", "🎉 " * 30 + "\n# 漢字\n漢 字\n",
]


def made(rng):
    kinds = [lambda: "#" * rng.randrange(1, 8) + " " + rng.choice(["A", "B c", "D #", "é"]), lambda: rng.choice(["```", "~~~x", " ```", "---"]), lambda: "", lambda: " " * rng.randrange(3), lambda: "w " * rng.randrange(1, 40), lambda: "name: " + rng.choice("xyz"), lambda: "w"]
    lines = [rng.choices(kinds, (4, 1, 4, 1, 8, 1, 3))[0]() for _ in range(rng.randrange(40))]
    return "\n".join((["---", "title: t", "description: it's", "---"] if rng.random() < 0.3 else []) + lines)


@pytest.mark.parametrize("sizes", [(60, 500, 800), (6, 16, 20), (1, 1, 1), (30, 60, 45)])
def test_equals_plain_python(spark, sizes):
    rng = random.Random(sum(sizes))
    texts = [*FIXED, *(made(rng) for _ in range(150))]
    names = ["a/b.md", "plain.txt", "x/.hidden", "two.dots.md", "no_suffix", "dir.d/n"]
    rows = [("c", names[i % len(names)], f"/p/{i}", t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "corpus string, rel string, path string, text string, words int").repartition(4)
    got = {}
    for r in chunker.chunk_files(df, *sizes).collect():
        got.setdefault(int(r.path[3:]), []).append(r)
    for i, t in enumerate(texts):
        meta, parts, want = chunks(t or "", *sizes)
        mine = sorted(got.get(i, []), key=lambda r: r.ordinal)
        assert [r.ordinal for r in mine] == list(range(len(want))), t
        for r, w in zip(mine, want, strict=True):
            assert {k: r[k] for k in w} == w, t
            assert r.title == title(meta, parts, rows[i][1]), t


def test_columns_and_empty_table(spark):
    df = spark.createDataFrame([("c", "a.md", "p", "# T\nx", 7)], "corpus string, rel string, path string, text string, size int")
    assert [f"{n} {t}" for n, t in chunker.chunk_files(df).dtypes] == chunker.CHUNK_SCHEMA.split(", ")
    assert chunker.chunk_files(df, also=("size",)).first()["size"] == 7
    assert chunker.chunk_files(df.where("size = 0")).count() == 0


def test_no_python_and_no_shuffle(spark):
    df = spark.createDataFrame([("c", "a.md", "p", "# T\nx")], "corpus string, rel string, path string, text string").repartition(1).cache()
    plan = chunker.chunk_files(df)._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Exchange" not in plan


def test_long_texts_take_time_in_proportion(spark):
    """Ten times the lines take no hundred times as long: nothing is computed anew for each line."""
    import time

    took = []
    for n in (3_000, 30_000):
        text = "\n".join(f"## H{i}\n" + "w " * 9 if i % 50 == 0 else "some words in a line\n" * (i % 3) for i in range(n))
        df = spark.createDataFrame([("c", "a.md", "p", text)], "corpus string, rel string, path string, text string").coalesce(1)
        rows = chunker.chunk_files(df)
        rows.count()
        began = time.time()
        assert rows.selectExpr("sum(length(hash)) s").first().s > 0
        took.append(time.time() - began)
    assert took[1] < 40 * max(took[0], 0.2)

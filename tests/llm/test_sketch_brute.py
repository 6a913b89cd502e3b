"""Every output of the fingerprint comparison against plain Python, and mixing's order."""

import base64
import hashlib
import random
import re

import pytest
import xxhash

from lodestack.llm import scaled_sketch, source_mix

MASK = (1 << 64) - 1


def mix(h):
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & MASK
    h ^= h >> 29
    h = h * 0xC2B2AE3D27D4EB4F & MASK
    return h ^ h >> 32


def word_hash(w):
    h = mix(len(w) * 0x2545F4914F6CDD1D + 0x9E3779B97F4A7C15 & MASK)
    if len(w) > 512:
        return int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    for i in range(0, len(w), 8):
        h = mix((h ^ int.from_bytes(w[i : i + 8], "little")) * 0x9FB21C651E98DF25 & MASK)
    return h


def fingerprint(text):
    words = [word_hash(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode())]
    hashes = []
    for i in range(max(1, len(words) - 4) if words else 0):
        part, h = words[i : i + 5], 0
        for w in part:
            h = (h * 0x9FB21C651E98DF25 + w) & MASK
        hashes.append(mix((h + (len(part) if len(part) < 5 else 0)) & MASK) >> 32)
    return {h for h in hashes if h < int(scaled_sketch.FRACTION * (1 << 32))} or set(sorted(hashes)[:1])


def string(print_):
    return base64.b64encode(b"".join(h.to_bytes(4, "little") for h in sorted(print_))).decode()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    rng = random.Random(12)
    words = ["alpha", "béta", "漢字", "x", "🎉🎉", "supercalifragilistic", "of"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))
    rows = [(i * 3, rng.choice([None, "", " \n", text(3), text(40), text(40), text(200)])) for i in range(80)]
    rows += [(100, text(rng.randrange(40))) for _ in range(90)]  # one id of many texts
    rows += [(None, text(rng.randrange(40))) for _ in range(40)]  # and none
    rows += [(120, "the same row " * 9)] * 60
    rows += [(400, text(60_000)), (401, "y" * 700 + " " + text(10))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [64 << 20, 1500])
def test_all_outputs(spark, monkeypatch, size):
    monkeypatch.setattr(scaled_sketch, "SLOT_BYTES", size)
    monkeypatch.setattr(scaled_sketch, "MAX_SLOTS", 60)
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, slot int, key string").repartition(5)
    got = [tuple(r) for r in scaled_sketch.compare_edited(df).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()]
    tag = lambda t: xxhash.xxh64(t.encode(), seed=42).intdigest()
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, tag(r[1])))
    want = []
    for (d, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + n[:cut]
        a, e, b = fingerprint(t), fingerprint(edited), fingerprint(n)
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), string(a), string(e), alike(a, e), alike(a, b)))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    plain = {(r.doc_id, r.fingerprint) for r in scaled_sketch.fingerprints(df).collect()}
    assert plain == {(w[0], w[3]) for w in want}


def test_slots_hold_a_hot_id_in_parts(spark, monkeypatch):
    monkeypatch.setattr(scaled_sketch, "SLOT_BYTES", 100)
    df = spark.createDataFrame([(1, "a"), *((5, f"text number {i} of one id") for i in range(400)), (9, "b")], "doc_id long, text string")
    slots = scaled_sketch.with_next(df).where("not guest").groupBy("slot").count().collect()
    assert len(slots) > 50 and max(r["count"] for r in slots) < 40


def test_merge_gives_the_fingerprint_of_both():
    a, b = "one two three four five six seven eight", "six seven eight nine ten eleven twelve thirteen"
    import pyarrow as pa

    prints = scaled_sketch.Sketches(*scaled_sketch.V.buffers(pa.array([a, b]))).strings()
    below = int(scaled_sketch.FRACTION * (1 << 32))
    both = fingerprint(a) | fingerprint(b)
    want = {h for h in both if h < below} or {min(both)}
    assert scaled_sketch.merge(*prints) == scaled_sketch.merge(*prints[::-1]) == string(want)


def test_mixed_is_in_order_of_position(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(1, 30), rng.choice(["a", "b", "c", None]), 0) for i in range(300)] + [(None, f"no id {i}", "a", 0) for i in range(30)] + [(7, "twice the id", "b", 0), (8, None, "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, position int").repartition(4)
    cycle = source_mix.ramped((1, 2, 3))
    at = {}
    for r in source_mix.plan_mix(df, cycle).collect():
        for s in r.slots:
            if 2 * s.words >= r["size"]:
                at.setdefault((r.doc_id, r["size"]), []).append(s.position)
    out = source_mix.mixed(df, cycle)
    assert out.columns == df.columns
    parts = [r for p in out.rdd.glom().collect() for r in p]
    assert sorted(len(v) for v in at.values()) and sum(map(len, at.values())) == len(parts)
    size = lambda t: len((t or "").split())
    last = 0.0
    for r in parts:  # each row has a position of its document that isn't before the last one's
        later = [p for p in at[r.doc_id, size(r.text)] if p >= last]
        assert later
        last = min(later)

"""Encoders against the libraries, and the files' contents."""

import hashlib
import random
import zlib

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from lodestack.llm import bpe_transducer as B
from lodestack.llm import token_files as T

TEXTS = [None, "", " ", "\n", "a", "Hello world, it's fine.\nSecond  line \n\n end", " lead and trail ", "x" * 3000, "é ü 漢字 🎉" * 40, "tab\tand\r\nfeeds nbsp ls", "aa\n bb", "a \nb", "<|endoftext|> x", "don't DON'T 123 4567!!! $$ ---- ____", "\x00\x01 \x0b\x0c", "a" * 500 + " b" * 300]


def more(seed, n=60):
    rng = random.Random(seed)
    alphabet = "ab cdé\n\t'ст漢 🎉  0123.,!?ingthe"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(n)]


def test_transducer_equals_tiktoken():
    ranks = B.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces, table = B.coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    import numpy as np

    texts = [t or "" for t in TEXTS] + more(1)
    import pyarrow as pa

    flat, at = pieces.codes(*B.V.buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        ids = flat[at[i] : at[i + 1]].tolist()
        assert ids == enc.encode_ordinary(t), t
        assert "".join(B.decode_stream(ids, dict(enumerate(table)), 3)) == t


def test_transducer_on_a_vocabulary_with_overlaps():
    rng = random.Random(5)
    ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
    for _ in range(40):  # merges of known tokens, so that each is its own encoding
        a, b = rng.choice(list(ranks)), rng.choice(list(ranks))
        fst = B.Transducer(ranks)
        if a + b not in ranks and fst.merge(a + b) == [ranks[a], ranks[b]]:
            ranks[a + b] = len(ranks)
    fst = B.Transducer(ranks)
    for a in ranks:
        for b in ranks:
            if fst.whole(ranks[a]) and fst.whole(ranks[b]):
                assert fst.fits(ranks[a], ranks[b]) == (fst.merge(a + b) == [ranks[a], ranks[b]]), (a, b)
    for _ in range(300):
        s = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40)))
        assert fst.run(s) == fst.merge(s)


def test_utf8_stream_cuts_anywhere():
    rng = random.Random(7)
    data = "aé漢🎉߿￿".encode() * 5 + b"\xff\xc3(\xe2\x82"
    for _ in range(200):
        s, at, out = B.Utf8Stream(), 0, ""
        while at < len(data):
            to = min(len(data), at + rng.randrange(1, 5))
            out += s.feed(data[at:to])
            at = to
        assert (out + s.close()).replace("�", "") == data.decode("utf-8", "replace").replace("�", "")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS + more(2))] + [(None, "null id", "e"), (3, "again", "e")]
    return spark.createDataFrame(rows, "doc_id long, text string, tokens string").repartition(3), rows


def test_round_trip(docs):
    df, rows = docs
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(d, len(ids), sha(" ".join(map(str, ids))), sha(t or "")) for d, t, _ in rows for ids in [enc.encode_ordinary(t or "")]]
    ranks = P.path("byte_bpe_50k.tiktoken")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([tuple(r) for r in B.round_trip(df, ranks, P.PATTERN).collect()], key=key) == sorted(want, key=key)
    back = B.decode(B.encode(df, ranks, P.PATTERN), ranks)
    assert sorted([(r.doc_id, r.text) for r in back.collect()], key=key) == sorted([(d, t or "") for d, t, _ in rows], key=key)


def test_token_files(spark, docs, tmp_path):
    df, rows = docs
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    T.write_tokens(df, P.path("byte_bpe_50k.json"), str(tmp_path / "out"), files=4)
    back = T.with_starts(T.read_tokens(spark, str(tmp_path / "out"))).collect()
    assert len(back) == len(rows)
    back.sort(key=lambda r: r.start)
    assert [r.doc_id for r in back] == sorted((r[0] for r in rows), key=lambda d: (d is None, d))
    start = 0
    for r in back:
        assert r.start == start and r.n_tokens == len(r.tokens)
        start += len(r.tokens)
    by = {}
    for d, t, _ in rows:
        by.setdefault(d, []).append([*tok.encode(t or "", add_special_tokens=False).ids, T.END_ID])
    for r in back:
        assert r.tokens in by[r.doc_id]
    import numpy as np

    crc = T.read_tokens(spark, str(tmp_path / "out")).mapInArrow(T._crc, "shard int, row int, doc_id long, n_tokens long, ids_crc32 long").collect()
    have = {(r.shard, r.row): r.ids_crc32 for r in crc}
    assert all(have[r.shard, r.row] == zlib.crc32(np.array(r.tokens, "<u4").tobytes()) for r in back)
    plan = T.read_tokens(spark, str(tmp_path / "out")).where("doc_id = 5").select("n_tokens")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan and "tokens:array" not in plan.split("ReadSchema")[-1]


def test_added_tokens_as_in_the_library(spark, tmp_path):
    rng = random.Random(11)
    end = "<|endoftext|>"
    texts = ["a b <|endoftext|> x", end, end * 3, f"x{end}y", f"a\n{end}\nb", f"  {end}  x", f"it{end}'s", "<|endof", "text|> a", f"<|endoftext{end}|> <|endoftext|", "plain text", "", None]
    texts += ["".join(rng.choice([end, end[:7], end[7:], " ", "\n", "a", "é", "'s", "!", "\t", " b"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, T.END_ID] for i, t in enumerate(texts)}
    assert want[0] == [64, 275, 220, 50256, 2124, T.END_ID]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    (tmp_path / "sf").mkdir()
    df.coalesce(1).write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    import numpy as np

    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in T.op3(spark, str(tmp_path / "sf")).collect()}
    start = 0
    for i, ids in want.items():
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), texts[i]
        start += len(ids)


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    T.write_tokens(empty, P.path("byte_bpe_50k.json"), str(tmp_path / "none"))
    assert T.with_starts(T.read_tokens(spark, str(tmp_path / "none"))).count() == 0
    assert B.round_trip(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def encoders():
    ranks = P.path("byte_bpe_50k.tiktoken")
    return B.coder(ranks, P.PATTERN)[0], T.coder(P.path("byte_bpe_50k.json"), True)


def test_pieces_are_compared_and_not_only_hashed(monkeypatch):
    """Pieces whose polynomial hashes modulo 2^64 agree, and a hash with four values only."""
    import numpy as np
    import pyarrow as pa

    from lodestack.llm import _pieces

    tm = "a"
    while len(tm) < 2048:
        tm += tm.translate(str.maketrans("ab", "ba"))
    pair = ["a" * 8 + tm, "a" * 8 + tm.translate(str.maketrans("ab", "ba"))]
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for table in encoders():
        ids, at = table.codes(*B.V.buffers(pa.array(pair)))
        assert [ids[at[i] : at[i + 1]].tolist() for i in (0, 1)] == [tok.encode(t, add_special_tokens=False).ids for t in pair]
    real = B.V.span_hashes
    monkeypatch.setattr(B.V, "span_hashes", lambda t, s, e: real(t, s, e) & np.uint64(3))
    monkeypatch.setattr(_pieces, "SLOTS", 1 << 12)
    monkeypatch.setattr(_pieces, "CHUNK", 1 << 10)
    monkeypatch.setattr(_pieces, "RAW_BYTES", 1 << 12)
    table = _pieces.PieceTable(lambda ps: [np.array(tok.encode(p, add_special_tokens=False).ids, np.int32).tobytes() for p in ps])
    texts = [t or "" for t in TEXTS] + more(3, 200)
    ids, at = table.codes(*B.V.buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        if "<|" not in t:
            assert ids[at[i] : at[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_long_pre_token_in_bounded_states(monkeypatch):
    monkeypatch.setattr(B, "MAX_STATES", 5000)
    rng = random.Random(13)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    fst = B.Transducer(B.read_ranks(P.path("byte_bpe_50k.tiktoken")))
    most, make = 0, fst._make

    def watched(state, byte):
        nonlocal most
        got = make(state, byte)
        most = max(most, len(fst._states))
        return got

    monkeypatch.setattr(fst, "_make", watched)
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert fst.run(long.encode()) == tok.encode(long, add_special_tokens=False).ids
    assert 1000 < most <= 5000
    monkeypatch.undo()


def test_long_texts(spark):
    rng = random.Random(17)
    long = " ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(1, 9))) for _ in range(250_000))
    assert len(long) > 1_000_000
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = tok.encode(long, add_special_tokens=False).ids
    df = spark.createDataFrame([(1, long)], "doc_id long, text string")
    (r,) = B.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert r.tokens == want
    (back,) = B.decode(spark.createDataFrame([(1, want)], "doc_id long, tokens array<int>"), P.path("byte_bpe_50k.tiktoken")).collect()
    assert back.text == long

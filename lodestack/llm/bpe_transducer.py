"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

Encoding by merges has a local form: a sequence of tokens is the encoding of its bytes just
if each token beside its neighbour is the encoding of the two together.  So a nondeterministic
transducer reads bytes along the tokens of the vocabulary and may end a token only where it
fits the one before; every prefix of the input has exactly one such path.  A state of the
deterministic transducer is the set of paths that can still win: the bytes each has open, its
last token, and the tokens on which the paths differ so far.  What all paths agree on is
emitted, which happens after a bounded lookahead, as no token is longer than the longest of
the vocabulary.  States and transitions are made when first needed; at ``MAX_STATES``, also
in the midst of a string, all but the state just reached are forgotten and made anew.

Decoding joins the tokens' bytes and turns them into text through a UTF-8 state machine that
keeps a character cut by the end of a block for the next one.

Edge cases: null and empty texts have no tokens (n_tokens 0, hashes of the empty string);
very long texts and pre-tokens take time in proportion; columns other than doc_id and text
are not read; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _vec as V
from ._common import documents, ship, text_of
from ._pieces import PieceTable

#: States held at a time.
MAX_STATES = 40_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Transducer:
    """Encodes byte strings by merge ranks.  ``run`` encodes one string; ``start``, ``step`` and
    ``flush`` do so byte by byte."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.inner = {t[:i] for t in ranks for i in range(1, len(t))}
        self._fits: dict[tuple[int, int], bool] = {}
        self._halves: dict[int, tuple[int, int]] = {}
        self._whole: dict[int, bool] = {}
        self._ids: dict[tuple, int] = {}
        self._states: list[tuple] = []
        self._next: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self._reset()

    def _reset(self) -> None:
        for held in (self._ids, self._states, self._next):
            held.clear()
        self.start = self._id(((b"", -1, ()),))

    def _id(self, state: tuple) -> int:
        n = self._ids.setdefault(state, len(self._states))
        if n == len(self._states):
            self._states.append(state)
            self._next.append({})
        return n

    def merge(self, text: bytes, below: int = 1 << 60) -> list[int]:
        """Plain merging: always the adjacent pair of least rank, the leftmost of equals; ranks
        from ``below`` on don't merge."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, t: int) -> bool:
        """Whether a token is the encoding of its own bytes."""
        got = self._whole.get(t)
        if got is None:
            got = self._whole[t] = self.merge(self.token[t]) == [t]
        return got

    def halves(self, t: int) -> tuple[int, int]:
        """The two tokens whose merge made ``t``; a byte is its own halves."""
        got = self._halves.get(t)
        if got is None:
            parts = self.merge(self.token[t], below=t)
            got = self._halves[t] = (parts[0], parts[1]) if len(parts) == 2 else (t, t)
        return got

    def fits(self, a: int, b: int) -> bool:
        """Whether the tokens a, b side by side are what their bytes merge to.  The merges at
        the border are undone from the last one back; if at some point the two parts beside it
        form a token that merges before what was undone, the border would not have lasted."""
        got = self._fits.get((a, b))
        if got is None:
            if len(self._fits) > 2 * MAX_STATES:
                self._fits.clear()
            got = self._fits[a, b] = self._lasts(a, b)
        return got

    def _lasts(self, a: int, b: int) -> bool:
        left, right, bound = a, b, 1 << 60  # a merge across the border of a rank below bound comes first
        while True:
            across = self.ranks.get(self.token[left] + self.token[right])
            if across is not None and across < bound:
                return False
            (_, l_in), (r_in, _) = self.halves(left), self.halves(right)
            l_whole, r_whole = len(self.token[left]) == 1, len(self.token[right]) == 1
            if l_whole and r_whole:
                return True
            if r_whole or (not l_whole and left > right):
                left, bound = l_in, left  # merges left of the border win ties
            else:
                right, bound = r_in, right + 1

    def _make(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        paths = []
        for open_, last, tail in self._states[state]:
            x = open_ + bytes((byte,))
            t = self.ranks.get(x)
            if t is not None and (last < 0 or self.fits(last, t)) and self.whole(t):
                paths.append((b"", t, (*tail, t)))
            if x in self.inner:
                paths.append((x, last, tail))
        tails = [p[2] for p in paths]
        n = 0
        while all(len(t) > n for t in tails) and len({t[n] for t in tails}) == 1:
            n += 1
        out = tails[0][:n]
        new = tuple(sorted((o, la, t[n:]) for o, la, t in paths))
        if len(self._states) >= MAX_STATES and new not in self._ids:
            self._reset()  # only the state just reached goes on
            return self._id(new), out
        made = self._id(new)
        self._next[state][byte] = made, out
        return made, out

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Next state, and the tokens that are now certain.  A state holds until the next step;
        when the bound on states is reached all others are forgotten."""
        return self._next[state].get(byte) or self._make(state, byte)

    def flush(self, state: int) -> tuple[int, ...]:
        """The tokens still open when the input ends."""
        return next(tail for open_, _, tail in self._states[state] if not open_)

    def run(self, text: bytes) -> list[int]:
        out: list[int] = []
        state, table = self.start, self._next
        for byte in text:
            state, new = table[state].get(byte) or self._make(state, byte)
            if new:
                out += new
        out += self.flush(state)
        return out


class Utf8Stream:
    """Incremental UTF-8: ``feed`` returns the text of all whole characters so far, a character
    cut by a block's end waits.  States are the continuation bytes still due; a byte that no
    state accepts becomes U+FFFD."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def due(lead: int) -> int:
        """Continuation bytes that a lead byte announces; -1 if it leads nothing."""
        return 0 if lead < 0x80 else 1 if 0xC2 <= lead < 0xE0 else 2 if 0xE0 <= lead < 0xF0 else 3 if 0xF0 <= lead < 0xF5 else -1

    def feed(self, block: bytes) -> str:
        data = self.held + block
        cut = len(data)
        for back in range(1, min(3, cut) + 1):  # the last character's lead byte, if it is near
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                if self.due(byte) >= back:
                    cut -= back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def decode_stream(tokens: Iterable[int], table: dict[int, bytes], block: int = 4096) -> Iterator[str]:
    """Text of a stream of ids, block by block."""
    out, now = Utf8Stream(), []
    for t in tokens:
        now.append(table[t])
        if len(now) == block:
            yield out.feed(b"".join(now))
            now = []
    yield out.feed(b"".join(now))
    yield out.close()


_CODERS: dict[tuple[str, str], tuple[PieceTable, list[bytes]]] = {}


def coder(path: str, pattern: str) -> tuple[PieceTable, list[bytes]]:
    """A worker's table of pieces over the transducer, and the bytes of each token."""
    if (path, pattern) not in _CODERS:
        fst, split = Transducer(read_ranks(path)), regex.compile(pattern)

        def encode(pieces: list[str]) -> list[bytes]:
            return [array("i", [i for p in split.findall(piece) for i in fst.run(p.encode())]).tobytes() for piece in pieces]

        _CODERS[path, pattern] = PieceTable(encode), [fst.token.get(i, b"") for i in range(max(fst.token) + 1)]
    return _CODERS[path, pattern]


def _rows(path: str, pattern: str, digest: bool, keep: tuple[str, ...] = ()) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, table = coder(path, pattern)
        names = [str(i).encode() for i in range(len(table))] if digest else []
        for rb in batches:
            text, off = V.buffers(rb.column("text"))
            for a, b in V.slices(off):
                all_ids, at = pieces.codes(text[off[a] : off[b]], off[a : b + 1] - off[a])
                doc = rb.column("doc_id").slice(a, b - a)
                if not digest:
                    tokens = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(all_ids))
                    yield pa.RecordBatch.from_arrays([*(rb.column(c).slice(a, b - a) for c in keep), doc, tokens], [*keep, "doc_id", "tokens"])
                    continue
                n, ids_sha, text_sha = [], [], []
                for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    ids = all_ids[lo:hi].tolist()
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(b" ".join(map(names.__getitem__, ids))).hexdigest())
                    sha, stream = hashlib.sha256(), Utf8Stream()
                    for i in range(0, len(ids), 4096):
                        sha.update(stream.feed(b"".join(map(table.__getitem__, ids[i : i + 4096]))).encode())
                    sha.update(stream.close().encode())
                    text_sha.append(sha.hexdigest())
                yield pa.RecordBatch.from_arrays([doc, pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, ranks: str, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and tokens (array<int>) for every row of ``docs`` (doc_id, text), after the columns
    ``keep``.  The rank file must be at that path on every executor."""
    ship(docs.sparkSession)
    rows = docs.select(*keep, F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    kept = docs.select(*keep).schema.add("doc_id", T.LongType()).add("tokens", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(_rows(ranks, pattern, False, tuple(keep)), kept)


def _decode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {r: t for t, r in read_ranks(path).items()}
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(["".join(decode_stream(x or (), table)) for x in rb.column("tokens").to_pylist()], pa.string())], ["doc_id", "text"])

    return run


def decode(tokens: DataFrame, ranks: str) -> DataFrame:
    """doc_id and text for every row of ``tokens`` (doc_id, tokens)."""
    ship(tokens.sparkSession)
    return tokens.select("doc_id", "tokens").mapInArrow(_decode(ranks), "doc_id long, text string")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs``."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_rows(ranks, pattern, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

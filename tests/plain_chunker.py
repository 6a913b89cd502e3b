"""The chunker in plain Python, one text at a time: what the DataFrame functions must equal."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from lodestack.operators.sections import Line, Section, n_words, sections, title


def grouped(parts: list[Section], least: int, target: int) -> list[list[Section]]:
    """Neighbours that are merged: a group below ``least`` words takes what follows under its
    heading, otherwise a small one is taken while the group stays within ``target``."""
    out: list[list[Section]] = []
    size = 0
    for s in parts:
        own = n_words(s.lines)
        if out and out[-1][0].takes(s) and (size < least or (own < least and size + own <= target)):
            out[-1].append(s)
            size += own
        else:
            out.append([s])
            size = own
    return out


def _packed(units: Iterable[list[Line]], most: int) -> Iterator[list[Line]]:
    """Units in order, as many together as stay within ``most`` words."""
    held: list[Line] = []
    size = 0
    for u in units:
        own = n_words(u)
        if held and size + own > most:
            yield held
            held, size = [], 0
        held = held + u
        size += own
    if held:
        yield held


def split_long(lines: list[Line], most: int) -> list[list[Line]]:
    """Paragraphs packed together; one that is too long alone is cut between lines.  Blank
    lines between paragraphs go."""
    paragraphs: list[list[Line]] = [[]]
    for line in lines:
        if line[1].strip():
            paragraphs[-1].append(line)
        elif paragraphs[-1]:
            paragraphs.append([])
    out: list[list[Line]] = []
    run: list[list[Line]] = []
    for p in filter(None, paragraphs):
        if n_words(p) > most:
            out += [*_packed(run, most), *_packed([[x] for x in p], most)]
            run = []
        else:
            run.append(p)
    return out + list(_packed(run, most))


def chunks(text: str, min_words: int = 60, target_words: int = 500, max_words: int = 800) -> tuple[dict[str, str], list[Section], list[dict]]:
    """(frontmatter, sections, chunks with heading, line_start, line_end, words, body, hash)."""
    meta, parts = sections(text)
    out = []
    for group in grouped(parts, min_words, target_words):
        name = " > ".join(next((s for s in group if s.has_text()), group[0]).path) or meta.get("description", "")[:160]
        lines = [x for s in group for x in s.lines]
        for piece in [lines] if n_words(lines) <= max_words else split_long(lines, max_words):
            body = "\n".join(t for _, t in piece).strip()
            if body:
                used = [n for n, t in piece if t.strip()]
                digest = hashlib.sha256(f"{name}\n{body}".encode()).hexdigest()
                out.append({"heading": name, "line_start": used[0], "line_end": used[-1], "words": len(body.split()), "body": body, "hash": digest})
    return meta, parts, out


__all__ = ["chunks", "title"]

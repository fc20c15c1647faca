"""Text units and their packing into chunks, for one text at a time.

A text's kind decides what its units are and how large chunks grow. Units are
packed in order. A chunk that is full closes before the unit that would exceed
the target, and the next one opens with the units just before that fit the
overlap. Overlaps depend on a unit's place alone, so prefix sums of token
counts settle where each begins. A chunk over the limit is split again, code by
lines, other text by windows of words.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

from quarry.functions import text as T


def _python(pattern: str) -> str:
    """A pattern of ``functions.text`` in Python's syntax."""
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: "\\u%04x" % int(m[1], 16), pattern).replace("\\z", "\\Z")


_TOKEN = re.compile(_python(T.TOKEN))
_FIELD = re.compile(_python(T.FIELD))
_SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(_python(f"[{T.SPACE}]"), c))
_END = re.compile(_python(T.SENTENCE_END))
_BREAK = re.compile(T.CODE_BREAK)
_WIDE = re.compile(_python(T.WIDE_GAP))

#: By kind: growth of the target, growth of the overlap, what joins units.
SHAPES = {"code": (1.5, 1.2, "\n"), "structured": (1.0, 0.8, "\n"), "prose": (1.25, 1.0, " "), "text": (1.0, 1.0, " ")}
CONSTRUCTS = ["function", "class", "def ", "interface", "type ", "struct"]  # fixed values: what code overlaps keep
SMALL_TEXT = 100  # up to so many tokens a text is one chunk


def trim(text: str) -> str:
    return text.strip(_SPACES)


def tokens(text: str) -> int:
    # bytes are split at the same characters and at one more
    return len(text.encode("utf-8", "replace").split()) if "\v" not in text else len(_TOKEN.findall(text))


def fields(text: str) -> list[str]:
    return _FIELD.findall(text)


def kind_of(text: str) -> str:
    if any(m in text for m in T.CODE_MARKS):
        return "code"
    if sum(m in text for m in T.STRUCTURE_MARKS) > 2:
        return "structured"
    return "prose" if text.count("\n\n") > len(text.encode()) // 500 else "text"


def _kept(parts: list[str]) -> list[str]:
    return [x for x in map(trim, parts) if x]


def paragraphs(text: str) -> list[str]:
    parts = _kept(text.split("\n\n"))
    return [trim(p[:-1]) if p.endswith(".") else p for p in parts[:-1]] + parts[-1:]


def sentences(text: str) -> list[str]:
    marks = list(_END.finditer(text))
    if not marks:
        return _kept([text])
    starts = [0] + [m.end() for m in marks[:-1]]
    stops = [m.start() for m in marks[:-1]] + [marks[-1].end()]
    return _kept([text[a:b] for a, b in zip(starts, stops)])


def code_blocks(text: str) -> list[str]:
    return [b for b in _kept(_BREAK.split(text)) if len(b.encode()) > T.LEAST_BLOCK_BYTES]


def wide_parts(text: str) -> list[str]:
    parts = _kept(_WIDE.split(text))
    return parts if len(parts) > 1 else [trim(text)]


def sentence_units(text: str) -> list[str]:
    for split in (paragraphs, sentences, code_blocks):
        units = split(text)
        if len(units) > 1:
            return units
    return wide_parts(text)


UNITS = {"code": code_blocks, "prose": paragraphs, "structured": sentence_units, "text": sentence_units}


@dataclass(frozen=True)
class Chunk:
    text: str
    token_count: int
    kind: str
    start: int = 0
    end: int | None = None

    @property
    def end_pos(self) -> int:
        return len(self.text.encode()) if self.end is None else self.end


class Chunker:
    """Chunks of at most ``max_tokens`` tokens, of which ``overlap`` may repeat the chunk before."""

    def __init__(self, max_tokens: int = 256, overlap: int = 38):
        if max_tokens < 1 or overlap < 0 or overlap >= max_tokens:
            raise ValueError("max_tokens must be positive and larger than overlap, which must not be negative")
        self.max_tokens, self.overlap = max_tokens, overlap

    def chunk(self, text: str | None) -> list[Chunk]:
        text = trim(text or "")
        if not text:
            return []
        kind, n = kind_of(text), tokens(text)
        if n <= SMALL_TEXT <= self.max_tokens:
            return [Chunk(text, n, kind)]
        return [part for c in self.pack(UNITS[kind](text), kind) for part in self.fit(c)]

    def overlap_of(self, units: list[str], sizes: list[int], kind: str) -> Callable[[int], list[int]]:
        """Gives for a unit the places of the units before it that an overlap would repeat.

        Prose repeats the longest run that fits the budget. Code repeats, nearest first, what still fits and every
        construct, until the budget is used up: runs that fit are found by sums, and what stops a run is a construct
        to be taken or a unit to be left out.
        """
        budget = int(self.overlap * SHAPES[kind][1])
        if not budget:
            return lambda at: []
        if kind != "code":
            upto = [0, *accumulate(sizes)]
            return lambda at: list(range(bisect_left(upto, upto[at] - budget, 0, at + 1), at))
        marked = [any(c in u.lower() for c in CONSTRUCTS) for u in units]
        usable = [i for i, n in enumerate(sizes) if n <= budget or marked[i]]
        sums = [0, *accumulate(sizes[i] for i in usable)]

        def of(at: int) -> list[int]:
            runs, end, left = [], bisect_left(usable, at), budget
            while end > 0 and left > 0:
                edge = sums[end] - left
                start = bisect_left(sums, edge, 0, end + 1)
                if sums[start] == edge:  # the budget is used up exactly, and empty units before that stay out
                    start = bisect_right(sums, edge, start, end + 1) - 1
                runs.append(usable[start:end])
                left, end = sums[start] - edge, start - 1
                if left > 0 and end >= 0 and marked[usable[end]]:
                    runs.append([usable[end]])
                    left -= sizes[usable[end]]
            return [i for run in reversed(runs) for i in run]

        return of

    def overlaps(self, units: list[str], sizes: list[int], kind: str) -> Iterator[list[int]]:
        """``overlap_of`` every unit."""
        return map(self.overlap_of(units, sizes, kind), range(len(units)))

    def pack(self, units: list[str], kind: str) -> list[Chunk]:
        growth, _, joint = SHAPES[kind]
        target, sizes = int(self.max_tokens * growth), [tokens(u) for u in units]
        before = self.overlap_of(units, sizes, kind)
        # (tokens, first unit, overlap) of the open chunk; a chunk ends where the next one starts
        spans, held, first, repeated = [], 0, 0, []
        for i, n in enumerate(sizes):
            if held and held + n > target:
                spans.append((held, first, i, repeated))
                first, repeated = i, before(i)
                held = sum(sizes[j] for j in repeated)
            held += n
        if units:
            spans.append((held, first, len(units), repeated))
        out = []
        for held, a, b, repeated in spans:
            head = joint.join(units[j] for j in repeated)
            body = trim((head + "\n" + joint if head else "") + joint.join(units[a:b]))
            if body:
                out.append(Chunk(body, held, kind))
        return out

    def fit(self, chunk: Chunk) -> list[Chunk]:
        """The chunk, or the parts of one that is too large."""
        if chunk.token_count <= self.max_tokens:
            return [chunk]
        return self.by_lines(chunk) if chunk.kind == "code" else self.by_words(chunk)

    def by_lines(self, chunk: Chunk) -> list[Chunk]:
        groups: list[tuple[int, list[str]]] = []
        for line in chunk.text.split("\n"):
            n = tokens(line)
            if not groups or groups[-1][0] and groups[-1][0] + n > self.max_tokens:
                groups.append((0, []))
            held, lines = groups[-1]
            lines.append(line)
            groups[-1] = held + n, lines
        return [Chunk(trim("\n".join(lines)), held, "code", 0, 0) for held, lines in groups if trim("\n".join(lines))]

    def by_words(self, chunk: Chunk) -> list[Chunk]:
        words = fields(chunk.text)
        if len(words) <= self.max_tokens:
            return [chunk]
        stride = self.max_tokens - self.overlap
        out = []
        for at in range(0, max(len(words) - self.overlap, 1), stride):
            text = " ".join(words[at : at + self.max_tokens])
            out.append(Chunk(text, len(words[at : at + self.max_tokens]), "text", chunk.start + at, chunk.start + at + len(text.encode())))
        return out


def pack_rows(rows: Iterable[tuple[str, str]], budget: int) -> Iterator[tuple[str, int, str, int]]:
    """``(table, index, text, tokens)`` from rendered rows ``(table, row)`` that come table by table.

    Rows are gathered in order up to ``budget`` tokens, never split, and never
    across tables; only the open chunk is held.
    """
    table, index, held, part = None, 0, 0, []
    for own, row in rows:
        n = tokens(row)
        if part and (own != table or held + n > budget):
            yield table, index, "".join(part), held
            index, held, part = index + 1, 0, []
        if own != table:
            table, index = own, 0
        part.append(row)
        held += n
    if part:
        yield table, index, "".join(part), held

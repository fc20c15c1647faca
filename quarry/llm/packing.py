"""Sequence packing: sum-of-squares online packing of token ids into windows of a fixed length.

Each input partition is a stream of documents. A document's full windows are
cut off its front; what remains goes, in order of arrival, to the fill level
(or a new window) that leaves the smallest sum of squared counts of partially
filled windows by level. The counts are one array with a place for each level.
When the stream ends, the fullest open windows are topped up with cuts from the
emptiest, and what is left at the very end is cut at powers of two, which need no
padding. So documents are cut only where they exceed a window or where the last
windows are filled up. However many windows are open, none is closed early; they
hold ids in two bytes where the vocabulary allows, at most those of one partition.

No text is shuffled and no partition sees another's windows. Sequence ids are
the partition's number times 2**33 plus the window's number, unique as they stand.

Cases: a null or empty text is a document of the end id alone; repeated rows
and null ids are packed like others; an empty table gives an empty result;
very long texts fill windows of their own; of levels that do alike the fullest is
taken; other columns are not read. Which rows make a stream depends on how the input
is split, so sequences (never the tokens they hold) differ between clusters.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import small_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


LONG = 64  # words of so many bytes are not kept in the caches


class _Bounded(dict):
    """A cache of two generations: a full one becomes the old one, and what is asked for again moves up."""

    def __init__(self, most: int):
        self.most, self.old = most, {}

    def __missing__(self, key):
        v = self.old.get(key)
        if v is None:
            v = self.made(key)
        if len(key) < LONG:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = v
        return v


class _Cores(_Bounded):
    """Ids of a lower-cased run of letters (as UTF-8), by the tokenizer's own model."""

    def __init__(self, tokenizer, most: int):
        super().__init__(most)
        self.split, self.pre, self.letters = tokenizer.model.tokenize, tokenizer.pre_tokenizer, {}

    def _letter(self, c: str) -> str:
        v = self.letters.get(c)
        if v is None:
            v = self.letters[c] = self.pre.pre_tokenize_str(c)[0][0]
        return v

    def made(self, core: bytes) -> bytes:
        plain = core.decode("utf-8")
        if not plain.isascii():
            plain = "".join(map(self._letter, plain))
        return array("I", [t.id for t in self.split(plain)]).tobytes()


class Encoder(_Bounded):
    """Ids of a whole text, word by word through bounded caches.

    The tokenizer lower-cases, drops white space and never joins across it, so
    the ids of a text are those of its words in turn. A word of letters with
    punctuation after it skips the tokenizer's splitter; any other goes through
    the tokenizer whole.
    """

    #: Letters whose lower case and class do not depend on the Unicode version, then ASCII punctuation.
    SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@[-`{-~]*)")

    def __init__(self, path: str, most: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(most)
        self.tokenizer = Tokenizer.from_file(path)
        self.cores, self.after = _Cores(self.tokenizer, most), {"": b""}

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def made(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        m = self.SIMPLE.fullmatch(text)
        if not m:
            return self._whole(text)
        tail = self.after.get(m[2])
        if tail is None:
            tail = self._whole(m[2])
            if len(self.after) < 10_000:
                self.after[m[2]] = tail
        core = m[1].lower().encode("utf-8")
        return self.cores[word if core == word else core] + tail  # a word that is its own core shares key and ids

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split())), dtype="<u4")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens)


@dataclass
class Packer:
    """The windows of one stream. ``levels[h]`` counts the open windows with ``h`` tokens."""

    capacity: int = 2048
    levels: np.ndarray = field(init=False)
    open: dict[int, list[list[Piece]]] = field(init=False, default_factory=dict)

    def __post_init__(self):
        self.levels = np.zeros(self.capacity + 1, dtype=np.int64)

    def level_for(self, size: int) -> int:
        """The fill level to add ``size`` tokens to (0: a new window), of equal ones the fullest."""
        n, cap = self.levels, self.capacity
        change = 2 * (n[size:cap] - n[: cap - size]) + 2  # of the sum of squares, for levels 0 .. cap - size - 1
        change[n[: cap - size] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * n[size] + 1
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        full = cap - size
        if n[full] and 1 - 2 * n[full] <= change[best]:
            return full
        return best

    def add(self, piece: Piece) -> list[list[Piece]]:
        """Take in a document; what comes back are the windows that this filled."""
        done = []
        while len(piece.ids) >= self.capacity:
            whole, piece = piece.cut(self.capacity)
            done.append([whole])
        if done:
            piece.ids = piece.ids.copy()  # an open window must not hold the whole of a long document
        size = len(piece.ids)
        if size:
            if int(piece.ids.max()) < 1 << 16:
                piece.ids = piece.ids.astype("<u2")
            at = self.level_for(size)
            window = self._take(at) if at else []
            window.append(piece)
            if at + size == self.capacity:
                done.append(window)
            else:
                self._put(at + size, window)
        return done

    def _take(self, level: int) -> list[Piece]:
        self.levels[level] -= 1
        return self.open[level].pop()

    def _put(self, level: int, window: list[Piece]) -> None:
        self.levels[level] += 1
        self.open.setdefault(level, []).append(window)

    def _top_up(self) -> list[list[Piece]]:
        """Fill the fullest open windows from the emptiest until one at most is open."""
        left = [(h, w) for h in sorted(self.open, reverse=True) for w in self.open[h]]
        self.open, done = {}, []
        self.levels[:] = 0
        i, j = 0, len(left) - 1
        while i < j:
            (h, window), (low, source) = left[i], left[j]
            move = min(self.capacity - h, low)
            left[i] = h + move, window
            left[j] = low - move, source
            while move:
                piece = source.pop()
                if len(piece.ids) > move:
                    piece, rest = piece.cut(move)
                    source.append(rest)
                window.append(piece)
                move -= len(piece.ids)
            if left[i][0] == self.capacity:
                done.append(window)
                i += 1
            if not left[j][0]:
                j -= 1
        if i == j and left[i][0]:
            self._put(*left[i])
        return done

    def finish(self) -> list[list[Piece]]:
        done = self._top_up()
        for windows in self.open.values():
            for window in windows:
                total = sum(len(p.ids) for p in window)
                while total:
                    want = 1 << (total.bit_length() - 1)
                    total -= want
                    part: list[Piece] = []
                    while want:
                        piece = window.pop(0)
                        if len(piece.ids) > want:
                            piece, rest = piece.cut(want)
                            window.insert(0, rest)
                        part.append(piece)
                        want -= len(piece.ids)
                    done.append(part)
        self.open = {}
        return done


def rows(windows: list[list[Piece]], first: int) -> pa.RecordBatch:
    """The pieces of finished windows, numbered from ``first``."""
    out: dict[str, list] = {n.split()[0]: [] for n in SCHEMA.split(", ")}
    for k, window in enumerate(windows):
        at = 0
        for p in window:
            for name, v in zip(out, (p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4", copy=False).tobytes()), p.doc_tokens, first + k, at)):
                out[name].append(v)
            at += len(p.ids)
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``; the schema is ``SCHEMA``. Each partition of the input is one stream."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer_path), Packer(capacity)
        number = TaskContext.get().partitionId() << 33
        end = np.array([end_id], dtype="<u4")
        for b in batches:
            done: list[list[Piece]] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.concatenate([enc.ids(text or ""), end])
                done += packer.add(Piece(doc_id, 0, ids, len(ids)))
            if done:
                yield rows(done, number)
                number += len(done)
        yield rows(packer.finish(), number)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(packed, SCHEMA)

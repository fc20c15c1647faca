"""Words of many texts at once: boundaries and 64-bit hashes by numpy, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACES = b" \t\n\x0b\x0c\r"
SPACE = np.zeros(256, dtype=bool)
SPACE[list(_SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)
_BLOCK = CHUNK_BYTES = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_R, _BLOCK + 1), _powers(_R_INV, _BLOCK + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``data``, by differences of one running polynomial sum.

    Equal spans have equal hashes wherever they lie. Blocks of at most ``_BLOCK``
    bytes bound the memory; a longer span is hashed alone.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _BLOCK, side="right")))
        width = int(ends[j - 1]) - base
        up, down = (_UP, _DOWN) if width <= _BLOCK else (_powers(_R, width + 1), _powers(_R_INV, width + 1))
        sums = np.zeros(width + 1, dtype=np.uint64)
        np.cumsum((data[base : base + width].astype(np.uint64) + np.uint64(1)) * up[:width], out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[b] - sums[a]) * down[a]
        i = j
    return mix(out)


class Words:
    """The words of a run of texts: ``doc`` of each word, its span in ``data``, and its hash."""

    def __init__(self, texts: list[bytes]):
        self.n_docs = len(texts)
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.raw, self.data = raw, LOWER[raw]
        space = SPACE[raw]
        before = np.empty_like(space)
        before[0] = True
        before[1:] = space[:-1]
        self.starts = np.flatnonzero(before & ~space)
        self.ends = np.flatnonzero(space & ~before)
        offsets = np.cumsum([len(t) + 1 for t in texts])
        self.doc = np.searchsorted(offsets, self.starts, side="right")
        self.hash = span_hashes(self.data, self.starts, self.ends)


def chunks(texts: list[str | None]) -> Iterator[tuple[int, Words]]:
    """Texts in runs of about a quarter of a megabyte, with the place of each run's first text."""
    run: list[bytes] = []
    first = size = 0
    for i, t in enumerate(texts):
        run.append((t or "").encode("utf-8", "replace"))
        size += len(run[-1])
        if size >= CHUNK_BYTES:
            yield first, Words(run)
            run, first, size = [], i + 1, 0
    if run:
        yield first, Words(run)

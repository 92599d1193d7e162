"""Vectorised word handling over Arrow batches of texts.

Every helper works on whole texts.  A batch is cut into runs of whole
documents of about ``CHUNK_BYTES`` of UTF-8, so that numpy's temporaries stay
small; one longer document is a run by itself.

Words are maximal runs of bytes other than space and ``\\x09-\\x0D``; in UTF-8
that is the same as over code points.  A null text is an empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2_000_000
POWER_STEP = 1 << 19  # the tables of powers grow in steps of so many entries
U64 = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LETTER = np.ones(256, bool)  # ASCII letters and every byte of a longer code point
_LETTER[:128] = [chr(i).isalpha() for i in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-dependent hash of two hashes."""
    return mix(a * U64(0x9E3779B97F4A7C15) + b)


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_BASE = 0x5851F42D4C957F2D
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n (kept and grown as needed)."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = -(-n // POWER_STEP) * POWER_STEP
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            step = np.full(size, base, U64)
            step[0] = 1
            _powers[name] = np.cumprod(step, dtype=U64)
    return _powers["up"], _powers["down"]


class ByteSums:
    """Prefix sums that give the hash of any byte range of one run."""

    def __init__(self, data: np.ndarray, lower: bool) -> None:
        up, self.down = _power(len(data) + 1)
        terms = (_BYTE[_LOWER] if lower else _BYTE)[data] * up[: len(data)]
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(terms, dtype=U64)])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))


@dataclass
class Run:
    """Whole documents of one batch: rows ``lo`` to ``hi``; ``offs`` are byte offsets into ``data``."""

    lo: int
    hi: int
    data: np.ndarray
    offs: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo

    def words(self, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start byte, end byte and document (0-based in the run) of every word, or of every run of letters."""
        word = _LETTER[self.data] if letters else ~_SPACE[self.data]
        if not word.any():
            none = np.zeros(0, np.int64)
            return none, none, none
        cut = np.zeros(len(word) + 1, bool)
        cut[self.offs] = True
        before = np.concatenate([[False], word[:-1]])
        after = np.concatenate([word[1:], [False]])
        start = np.flatnonzero(word & (~before | cut[:-1]))
        end = np.flatnonzero(word & (~after | cut[1:])) + 1
        return start, end, np.searchsorted(self.offs, start, "right") - 1


def runs(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[Run]:
    """The runs of a batch's text column; they cover every row, once."""
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        hi = min(hi, len(texts))
        yield Run(lo, hi, raw[offs[lo]: offs[hi]], offs[lo: hi + 1] - offs[lo])
        lo = hi


def shingles(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every window of ``k`` consecutive words of a document."""
    if len(words) < k:
        return words[:0], doc[:0]
    h = words[: len(words) - k + 1]
    for j in range(1, k):
        h = combine(h, words[j: len(words) - k + 1 + j])
    same = doc[: len(doc) - k + 1] == doc[k - 1:]
    return h[same], doc[: len(doc) - k + 1][same]


def counts(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; at its end the tables and buffers of the worker are given back, since idle workers live on."""
    yield from batches
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; else it keeps what lies below a block in use
    if trim:
        trim(0)


def take(batch: pa.RecordBatch, column: str, lo: int, hi: int) -> pa.Array:
    return batch.column(column).slice(lo, hi - lo)

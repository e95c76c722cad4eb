"""Texts as byte blocks: the words, lines and hashes of many texts at once.

An Arrow batch is cut into blocks of whole texts of about ``BLOCK_BYTES`` (a
longer text is a block of its own), and each block is handled by a few numpy
calls over its UTF-8 bytes. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random-looking 64-bit value for each byte.
BYTE_VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))

#: The ASCII white space that parts words: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes that begin a code point.
IS_FIRST = (np.arange(256) & 0xC0) != 0x80

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        size = max(n, 2 * BLOCK_BYTES)
        have = np.full(size, _BASE if kind == "up" else _INVERSE, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * BLOCK_BYTES:
            _powers[kind] = have
    return have[:n]


class Hasher:
    """Hashes of any byte ranges of ``data``, from one pass over it."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * _power("up", len(data)), out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * _power("down", len(self.sums))[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Block:
    """Some whole texts: ``data`` holds their bytes, text i is ``at[i]:at[i + 1]``."""

    def __init__(self, data: np.ndarray, at: np.ndarray, first: int):
        self.data, self.at, self.first = data, at, first
        self.n = len(at) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of ``flags``, one for each byte, over each text."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.at[1:]] - sums[self.at[:-1]]

    def n_chars(self) -> np.ndarray:
        return self.per_text(IS_FIRST[self.data])

    def text(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()

    def pieces(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of bytes where ``inside`` holds, never across texts.

        Returns their starts and ends, and for each text the number of runs
        before it (``n + 1`` values).
        """
        if not len(inside):
            empty = np.zeros(0, np.int64)
            return empty, empty, np.zeros(self.n + 1, np.int64)
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = self.at[(self.at > 0) & (self.at < len(inside))]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, self.at)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs without white space: starts, ends, words before each text."""
        return self.pieces(~IS_SPACE[self.data])


def as_bytes(column: pa.Array) -> pa.Array:
    """A text column as large binary without nulls."""
    return pc.fill_null(column.cast(pa.large_string()).cast(pa.large_binary()), b"")


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of an Arrow column, in order, as blocks."""
    texts = as_bytes(column)
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield Block(data[at[i] : at[j]], at[i : j + 1] - at[i], i)
        i = j


def shingles(hashes: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``k`` words of each text.

    A text of fewer words, but at least one, has its whole sequence as the only
    window. Returns the hashes and, for each text, the windows before it.
    """
    n_words = np.diff(before)
    full = np.maximum(n_words - k + 1, 0)
    short = (n_words > 0) & (n_words < k)
    counts = full + short
    out_before = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(out_before[-1], np.uint64)
    if full.any():
        last = len(hashes) - k + 1
        total = np.zeros(last, np.uint64)
        for j in range(k):
            total = total * np.uint64(_BASE) + hashes[j : j + last]
        of = np.repeat(np.arange(len(n_words)), full)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(full) - full, full)
        out[out_before[of] + inner] = mix(total[before[of] + inner])
    for i in np.flatnonzero(short):
        total = np.uint64(n_words[i])
        for h in hashes[before[i] : before[i + 1]]:
            total = np.uint64((int(total) * _BASE + int(h)) & _MASK)
        out[out_before[i]] = mix(np.array([total]))[0]
    return out, out_before


def text_array(values: list) -> pa.Array:
    return pa.array(values, pa.string())

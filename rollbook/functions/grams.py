"""Grams (runs of a few characters) in Arrow batches of texts, found with numpy.

Tasks get this module with the plan. Grams asked for are marked in a bitmap of fixed size by their hashes,
so what is found may hold others, too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BITS = 20  # of a bucket's number
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 18  # bytes of whole texts looked at together


def buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number, from 1, of the bit of each gram of at most three characters."""
    for batch in batches:
        out = [int(_buckets(_keys(_codes(g), len(g)))[0]) + 1 if g else 1 for g in batch.column(0).to_pylist()]
        yield pa.record_batch([pa.array(out, pa.int64())], ["bucket"])


def finder(bitmaps: dict[int, bytes], sizes: Sequence[int]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Finds marked grams of the given sizes in batches of key and text; each gram once a row.

    ``bitmaps`` holds Spark's bitmaps of ``buckets`` by their number.
    """

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(bitmaps.get(n + 1, bytes(4096)), np.uint8) for n in range((1 << _BITS) // 32768)]
        marks = np.unpackbits(np.concatenate(bits), bitorder="little").view(bool)
        for batch in batches:
            size = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // _BLOCK)) + 1
            for first, last in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                block = batch.slice(first, last - first)
                for n in sizes:
                    yield from _found(block, n, marks)

    return find


def _found(block: pa.RecordBatch, n: int, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
    texts = block.column(1).to_pylist()
    if n == 0:
        yield _postings(block.column(0), [""] * len(texts))
        return
    codes, ends = _codes("".join(texts)), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    if len(codes) < n:
        return
    keys = _keys(codes, n)
    at = np.flatnonzero(marks[_buckets(keys)])
    row = np.searchsorted(ends, at, side="right")
    whole = at + n <= ends[row]  # within one text
    held, row = keys[at[whole]], row[whole]
    if not len(held):
        return
    grams = np.unique(held)
    names = [np.array([(int(g) >> 21 * i) & 0x1FFFFF for i in range(n)], "<u4").tobytes().decode("utf-32-le") for g in grams]
    pairs = np.unique(row * len(grams) + np.searchsorted(grams, held))
    yield _postings(
        block.column(0).take(pa.array(pairs // len(grams))),
        pa.array(names, pa.string()).take(pa.array(pairs % len(grams))),
    )


def _postings(keys: pa.Array, grams: pa.Array | list[str]) -> pa.RecordBatch:
    return pa.record_batch([keys, pa.array(grams, pa.string()) if isinstance(grams, list) else grams], ["_key", "_gram"])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _keys(codes: np.ndarray, n: int) -> np.ndarray:
    """Each run of ``n`` code points as one number."""
    out = np.zeros(len(codes) - n + 1, np.uint64)
    for i in range(n):
        out |= codes[i : len(out) + i].astype(np.uint64) << np.uint64(21 * i)
    return out


def _buckets(keys: np.ndarray) -> np.ndarray:
    return (keys * _MIX) >> np.uint64(64 - _BITS)

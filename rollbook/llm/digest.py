"""Document fingerprints of improbable features.

Every window of 64 bytes of a text is a feature. Its rank is how rare its
entropy is among all windows of the corpus (windows of hardly any information
have none). Of 64 neighbouring features the one of the lowest rank, leftmost of
equals, gains a point; features with 16 points or more are selected, or if none has as many, those with the
most points. Selected
features go, in order and once each, into chained Bloom filters of 2,048 bits,
160 features and 5 bits a feature. Two fingerprints are compared filter by filter: bits in
common beyond those expected by chance, as a share of the most possible; each
filter of the shorter chain counts with its best match.

A text of 1 to 63 bytes is one feature by itself. A null or empty text has no
features: it is like another one with likeness 1 and like any other text with
likeness 0. A text without informative windows has its first window as feature.
``next`` in descending ``doc_id`` order, ties by text, null ids last; after the
last row comes the first. Repeated rows follow each other. Columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.blocks import Block, Hasher, blocks
from rollbook.llm.carry import named, per_block
from rollbook.llm.tables import stage

WINDOW = 64
NEIGHBOURS = 64
POINTS = 16
FILTER_BITS = 2048
FILTER_FEATURES = 160
BITS_PER_FEATURE = 5
#: Steps of entropy; below ``LOW`` a window has no information worth keeping.
STEPS, LOW = 1000, 100

#: Texts that are compared at a time, and what a row of a range is.
ROWS = 512
INNER, FIRST, LAST = 0, 1, 2

_COUNTS = np.arange(WINDOW + 1, dtype=np.float64)
_PHI = np.rint(_COUNTS * np.log2(np.maximum(_COUNTS, 1)) * (1 << 20)).astype(np.int64)
_GAIN = np.diff(_PHI)
_TOP = int(_PHI[-1])
_NONE = np.int64(STEPS + 1)  # the rank of windows that can't be selected


def entropies(data: np.ndarray) -> np.ndarray:
    """The entropy, in steps, of the window at each byte of ``data`` (only where one fits).

    The sum of c log c over byte counts c changes by what one byte leaves and
    one byte joins; both counts come from comparing ``data`` with itself shifted.
    """
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ahead, behind = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for shift in range(1, WINDOW):
        same = (data[:-shift] == data[shift:]).view(np.uint8)
        ahead[:-shift] += same
        behind[shift:] += same
    change = _GAIN[behind[WINDOW:]] - _GAIN[ahead[: n - 1]]
    sums = np.empty(n, np.int64)
    sums[0] = _PHI[np.bincount(data[:WINDOW], minlength=256)].sum()
    np.cumsum(change, out=sums[1:])
    sums[1:] += sums[0]
    return (_TOP - sums) * STEPS // _TOP


def _fitting(block: Block) -> np.ndarray:
    """For each byte with a window in the block: whether the window lies in one text."""
    n = len(block.data) - WINDOW + 1
    fits = np.ones(max(n, 0), bool)
    for edge in block.at[1:-1].tolist():
        fits[max(0, edge - WINDOW + 1) : edge] = False
    return fits


def entropy_histogram(docs: DataFrame) -> np.ndarray:
    """Windows of each entropy over all texts; at most 1,001 sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(STEPS + 1, np.int64)
        for batch in batches:
            for block in blocks(batch.column("text")):
                counts += np.bincount(entropies(block.data)[_fitting(block)], minlength=STEPS + 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["step", "n"])

    out = np.zeros(STEPS + 1, np.int64)
    for step, n in docs.select("text").mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n")).collect():
        out[step] = n
    return out


def rarity_ranks(histogram: np.ndarray) -> np.ndarray:
    """The rank of each entropy, rarest first; none below ``LOW``."""
    ranks = np.empty(len(histogram), np.int64)
    ranks[np.lexsort((np.arange(len(histogram)), histogram))] = np.arange(len(histogram))
    ranks[:LOW] = _NONE
    return ranks


def selected(block: Block, ranks: np.ndarray) -> list[np.ndarray]:
    """The places of each text's selected windows, in order."""
    fits = _fitting(block)
    rank = np.where(fits, ranks[entropies(block.data)], _NONE) if len(fits) else np.zeros(0, np.int64)
    width = np.int64(len(rank) + 1)
    least = rank * width + np.arange(len(rank))  # compares ranks, then places
    whole = least
    for step in (1, 2, 4, 8, 16, 32):
        whole = np.minimum(whole[:-step], whole[step:]) if len(whole) > step else whole[:0]
    out = []
    for i in range(block.n):
        a, b = int(block.at[i]), int(block.at[i + 1])
        last = b - WINDOW  # the last place of a window
        if last < a:
            out.append(np.zeros(0, np.int64))
            continue
        runs = whole[a : last - NEIGHBOURS + 2] if last - a + 1 >= NEIGHBOURS else least[a : last + 1].min(keepdims=True)
        spots = runs % width
        spots = spots[rank[spots] < _NONE]
        where, points = np.unique(spots, return_counts=True)
        if len(where):
            out.append(where[points >= min(POINTS, points.max())])
        else:
            out.append(np.array([a]))
    return out


def filters(block: Block, ranks: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each text the number of its features and its filters, as rows of bytes."""
    hasher = Hasher(block.data)
    out = []
    for i, places in enumerate(selected(block, ranks)):
        a, b = int(block.at[i]), int(block.at[i + 1])
        if a == b:
            out.append((0, np.zeros((0, FILTER_BITS // 8), np.uint8)))
            continue
        features = hasher(places, places + WINDOW) if len(places) else hasher(np.array([a]), np.array([b]))
        _, first = np.unique(features, return_index=True)
        features = features[np.sort(first)]
        n = len(features)
        bits = np.zeros((-(-n // FILTER_FEATURES), FILTER_BITS), bool)
        row = np.arange(n) // FILTER_FEATURES
        for k in range(BITS_PER_FEATURE):
            bits[row, ((features >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
        out.append((n, np.packbits(bits, axis=1)))
    return out


def written(n: int, rows: np.ndarray) -> str:
    """A fingerprint as text: the number of features and the filters."""
    return f"{n}:{base64.b64encode(rows.tobytes()).decode()}"


def read(fingerprint: str) -> np.ndarray:
    """The filters of a fingerprint as rows of bytes."""
    return np.frombuffer(base64.b64decode(fingerprint.split(":", 1)[1]), np.uint8).reshape(-1, FILTER_BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 (no more bits in common than by chance) to 1 (equal)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    a, b = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    n_b = np.bitwise_count(b).sum(1, dtype=np.int64)
    total = 0.0
    for row in a:
        n_a = int(np.bitwise_count(row).sum(dtype=np.int64))
        both = np.bitwise_count(row & b).sum(1, dtype=np.int64)
        chance = n_a * n_b / FILTER_BITS
        most = np.minimum(n_a, n_b)
        total += float(np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
    return total / len(a)


def _texts_filters(texts: list[bytes], ranks: np.ndarray) -> list[tuple[int, np.ndarray]]:
    out = []
    for block in blocks(pa.array([t.decode("utf-8", "replace") for t in texts], pa.large_string())):
        out += filters(block, ranks)
    return out


def fingerprints(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """``doc_id, fingerprint`` of each document, by the corpus's own ranks if none are given."""
    ranks = rarity_ranks(entropy_histogram(docs)) if ranks is None else ranks
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(block: Block) -> dict:
        return {"fingerprint": pa.array([written(*f) for f in filters(block, sent.value)], pa.string())}

    return named(per_block(docs, "text", ["doc_id"], "fingerprint string", run), ["doc_id"], ["fingerprint"])


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``, or all of it."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _compared(ids: pa.Array, texts: list[str], prints: list, index: list[int], ranks: np.ndarray) -> list[pa.Array]:
    """The result columns of the rows ``index``, each followed by the next row of the lists."""
    changed = [edited(texts[i], texts[i + 1]) for i in index]
    raw = [c.encode() for c in changed]
    changed_prints = _texts_filters(raw, ranks)
    return [
        ids.take(pa.array(index, pa.int64())),
        pa.array([len(texts[i]) for i in index], pa.int64()),
        pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
        pa.array([written(*prints[i]) for i in index], pa.string()),
        pa.array([written(*p) for p in changed_prints], pa.string()),
        pa.array([likeness(prints[i][1], p[1]) for i, p in zip(index, changed_prints, strict=True)], pa.float64()),
        pa.array([likeness(prints[i][1], prints[i + 1][1]) for i in index], pa.float64()),
    ]


def with_edits(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness and that of the next document's.

    One shuffle deals the texts into ranges of ``doc_id``. A range's rows but its
    last are compared there; its first and last texts are kept as well, and the last of each
    range is compared with the first of the next one in a small second step.
    """
    ranks = rarity_ranks(entropy_histogram(docs)) if ranks is None else ranks
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(ranks)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        held: tuple | None = None  # the last row and its filters

        def edge(ids: pa.Array, text: str, role: int) -> pa.RecordBatch:
            blank = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([ids, *blank, pa.array([role], pa.int32()), pa.array([here], pa.int32()), pa.array([text], pa.string())], [*names, "role", "range", "text"])

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
                if held is None:
                    yield edge(ids.slice(0, 1), texts[0], FIRST)
                prints = _texts_filters([t.encode() for t in texts], sent.value)
                if held:
                    ids, texts, prints = pa.concat_arrays([held[0], ids]), [held[1], *texts], [held[2], *prints]
                n = len(texts) - 1
                extra = [pa.array([INNER] * n, pa.int32()), pa.array([here] * n, pa.int32()), pa.nulls(n, pa.string())]
                yield pa.RecordBatch.from_arrays([*_compared(ids, texts, prints, list(range(n)), sent.value), *extra], [*names, "role", "range", "text"])
                held = (ids.slice(n), texts[n], prints[n])
        if held:
            yield edge(held[0], held[1], LAST)

    def join_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("text").to_pylist(), batch.column("following").to_pylist(), strict=True)
            for i, texts in enumerate(pairs):
                prints = _texts_filters([t.encode() for t in texts], sent.value)
                yield pa.RecordBatch.from_arrays(_compared(batch.column("doc_id").slice(i, 1), list(texts), prints, [0], sent.value), names)

    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    ranges = keyed.repartitionByRange(n, order[0]).sortWithinPartitions(*order)
    done = stage(ranges.mapInArrow(compare, f"{schema}, role int, range int, text string"), "ranges")
    used = sorted(r["range"] for r in done.where(F.col("role") == FIRST).select("range").collect())  # numbers of ranges
    following = spark.createDataFrame(list(zip(used, [*used[1:], *used[:1]], strict=True)), "range int, after int")
    firsts = done.where(F.col("role") == FIRST).select(F.col("range").alias("after"), F.col("text").alias("following"))
    lasts = done.where(F.col("role") == LAST).select("range", "doc_id", "text")
    met = lasts.join(following, "range").join(firsts, "after").select("doc_id", "text", "following").mapInArrow(join_ranges, schema)
    return done.where(F.col("role") == INNER).select(*names).unionByName(met)

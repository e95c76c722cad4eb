"""A quality classifier of supervised subword embeddings.

A text's features are its words, its pairs of neighbouring words, and the runs of 3 to 5 bytes of its words
with the white space beside them, each hashed to a learned vector. The text is the
mean of its vectors, and a softmax layer gives the chance of label 1. Vectors
and layer are trained by stochastic gradient descent on labelled documents
outside the held-out fold, at most ``LABEL_SAMPLE`` of them, chosen by a hash of
the id. For scoring, each vector is folded with the layer into one whole number of small
units, so a text's score is exact and does not depend on batches.

Null and empty texts have no features and get the score of the layer's bias.
Labels without an id or a mark are not used; a document labelled twice counts as
1 if any label says so. Without usable labels every score is 0.5. Repeated rows
are scored one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.blocks import IS_SPACE, Block, Hasher, blocks
from rollbook.llm.carry import per_block

ORDERS = (3, 4, 5)
#: Buckets of words, of pairs of words, and of each order's runs.
BUCKETS = 1 << 16
DIMENSIONS = 8
LABEL_SAMPLE = 3_000
EPOCHS = 6
RATE = 2.0
THRESHOLD = 0.7
UNIT = 1 << 24


def held_out(doc_id: Column) -> Column:
    """The fold whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For words, pairs of words and each order: buckets, and those before each text."""
    starts, ends, before = block.words()
    words = Hasher(block.data)(starts, ends)
    yield (words >> np.uint64(48)).astype(np.int64), before
    inside = np.ones(max(len(words) - 1, 0), bool)
    edges = before[1:-1]
    inside[edges[(edges > 0) & (edges < len(words))] - 1] = False
    place = np.flatnonzero(inside)
    # The exclusive or is the same for all words that follow themselves.
    yield ((words[place] ^ words[place + 1]) >> np.uint64(48)).astype(np.int64) + BUCKETS, np.searchsorted(place, before)
    space = IS_SPACE[block.data]
    data = np.where(space, np.uint8(0x20), block.data).astype(np.uint64)
    spaces = np.concatenate([[0], np.cumsum(space)])
    for k, order in enumerate(ORDERS):
        n = len(data) - order + 1
        if n <= 0:
            yield np.zeros(0, np.int64), np.zeros(block.n + 1, np.int64)
            continue
        key = np.zeros(n, np.uint64)
        for j in range(order):
            key = (key << np.uint64(8)) | data[j : j + n]
        whole = spaces[order - 1 : order - 1 + n] == spaces[1 : 1 + n]  # no white space inside
        for edge in range(1, order):
            at = block.at[1:-1] - edge
            whole[at[(at >= 0) & (at < n)]] = False
        place = np.flatnonzero(whole)
        bucket = ((key[place] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
        yield bucket + (k + 2) * BUCKETS, np.searchsorted(place, block.at)


class Model:
    """``fold[feature]`` in units, summed over a text's features, and the bias."""

    def __init__(self, fold: np.ndarray, bias: float):
        self.fold, self.bias = fold, bias

    def scores(self, block: Block) -> np.ndarray:
        total, n = np.zeros(block.n, np.int64), np.zeros(block.n, np.int64)
        for bucket, before in features(block):
            sums = np.concatenate([[0], np.cumsum(self.fold[bucket])])
            total += sums[before[1:]] - sums[before[:-1]]
            n += np.diff(before)
        return 1 / (1 + np.exp(-(total / np.maximum(n, 1) / UNIT + self.bias)))


def labelled_features(docs: DataFrame, labels: DataFrame, limit: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Different features with their shares, and the label, of the sampled documents; at most ``limit`` ids come to the driver."""
    sample = (
        labels.where("doc_id is not null and quality is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                parts = list(features(block))
                ids, shares = [], []
                for i in range(block.n):
                    own = np.concatenate([b[a[i] : a[i + 1]] for b, a in parts])
                    which, times = np.unique(own, return_counts=True)
                    ids.append(which.astype("<i4").tobytes())
                    shares.append((times / max(len(own), 1)).astype("<f4").tobytes())
                mine = batch.slice(block.first, block.n)
                yield pa.RecordBatch.from_arrays(
                    [mine.column("doc_id"), mine.column("quality"), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], ["doc_id", "quality", "ids", "shares"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = known.mapInArrow(run, f"doc_id {kind}, quality int, ids binary, shares binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [(np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["shares"], "<f4"), int(r["quality"] == 1)) for r in rows]


def train(data: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Stochastic gradient descent with a falling rate, in an order that a fixed seed draws."""
    size = (2 + len(ORDERS)) * BUCKETS
    if len({y for _, _, y in data}) < 2:
        return Model(np.zeros(size, np.int64), 0.0)
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (size, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    steps, step = epochs * len(data), 0
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            ids, shares, y = data[i]
            pace = rate * (1 - step / steps)
            step += 1
            mean = shares @ vectors[ids]
            scores = layer @ mean + bias
            chance = np.exp(scores - scores.max())
            chance /= chance.sum()
            chance[y] -= 1
            pull = chance @ layer
            layer -= pace * np.outer(chance, mean)
            bias -= 0.1 * pace * chance
            vectors[ids] -= (pace * 20) * np.outer(shares, pull)
    lean = layer[1] - layer[0]
    return Model(np.rint((vectors @ lean).astype(np.float64) * UNIT).astype(np.int64), float(bias[1] - bias[0]))


def classified(docs: DataFrame, labels: DataFrame, limit: int = LABEL_SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each document."""
    model = train(labelled_features(docs, labels, limit))
    sent = docs.sparkSession.sparkContext.broadcast((model.fold, model.bias))

    def run(block: Block) -> dict:
        return {"score": Model(*sent.value).scores(block)}

    out = per_block(docs, "text", ["doc_id"], "score double", run)
    doc_id = F.col("__0")
    return out.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

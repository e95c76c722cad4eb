"""Quality rules with a log-likelihood ratio of hashed byte n-grams.

Two multinomials over hashed n-grams (3 and 4 bytes of UTF-8) are counted: one
over every document (the raw corpus) and one over trusted documents, all that
are labelled good. A document's verdict is
the mean over its n-grams of ``log(p_trusted / p_raw)``. The log ratios are
rounded to whole units, so a document's sum is exact and its verdict does not
depend on partitions, batches or the order of rows. The threshold is the cut that best parts
good from bad labelled documents, over all of them.

Nulls, empty texts: no words, so the word count rule rejects them. Repeated
rows, and rows without an id, are judged one by one; labels without an id or a
mark are not used; a document labelled twice counts as good if any label says
so. Without usable labels every ratio is 0 and the base rules alone decide.
Extra columns of the input are ignored by ``judge`` and kept by ``passing``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.blocks import IS_FIRST, IS_SPACE, Block, Hasher, blocks, shingles
from rollbook.llm.carry import named, per_block
from rollbook.llm.tables import stage
from rollbook.plans.sizing import hint_by_size

ORDERS = (3, 4)
#: Hash buckets of one order.
BUCKETS = 1 << 15
#: Units of a log ratio of 1.
UNIT = 1 << 16
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
SYMBOLS = b"[#*$%&|<>]"

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True

_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_grams long, ratio double, base_failed boolean, kept boolean"


def labelled(labels: DataFrame) -> DataFrame:
    """Every labelled id with ``good``."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))


#: Its name while it took a part of the labels.
labelled_sample = labelled


def gram_buckets(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the bucket of each n-gram and the n-grams before each text."""
    data = block.data.astype(np.uint32)
    for k, order in enumerate(ORDERS):
        size = len(data) - order + 1
        if size <= 0:
            yield np.zeros(0, np.int64), np.zeros(block.n + 1, np.int64)
            continue
        key = np.zeros(size, np.uint32)
        for j in range(order):
            key = (key << np.uint32(8)) | data[j : j + size]
        key = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)
        counts = np.maximum(np.diff(block.at) - order + 1, 0)
        inside = np.ones(size, bool)
        for edge in range(1, order):  # windows that begin so near a text's end cross it
            at = block.at[1:-1] - edge
            inside[at[(at >= 0) & (at < size)]] = False
        if counts.sum() != inside.sum():  # texts shorter than the order overlap their neighbours' edges
            start = np.repeat(block.at[:-1], counts)
            start += np.arange(len(start)) - np.repeat(np.cumsum(counts) - counts, counts)
            key = key[start]
        else:
            key = key[inside]
        yield key.astype(np.int64) + k * BUCKETS, np.concatenate([[0], np.cumsum(counts)])


def ngram_counts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``(bucket, raw, trusted)`` counts over all ``docs``; ``known`` is as ``labelled`` gives it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, trusted = (np.zeros(len(ORDERS) * BUCKETS, np.int64) for _ in range(2))
        for batch in batches:
            good = batch.column("good").fill_null(False).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column("text")):
                mine = good[block.first : block.first + block.n]
                for key, before in gram_buckets(block):
                    raw += np.bincount(key, minlength=len(raw))
                    if mine.any():
                        trusted += np.bincount(key[np.repeat(mine, np.diff(before))], minlength=len(raw))
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(trusted[used])], ["bucket", "raw", "trusted"])

    good = known.where("good")
    marked = docs.select("doc_id", "text").join(hint_by_size(good)(good), "doc_id", "left").select("text", "good")
    counted = marked.mapInArrow(count, "bucket long, raw long, trusted long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """Whole units of ``log(p_trusted / p_raw)`` for each bucket, add-one smoothed in each order.

    The collected table has a row for each bucket at most: 65,536.
    """
    raw, trusted = (np.zeros(len(ORDERS) * BUCKETS) for _ in range(2))
    for bucket, r, t in counts.collect():
        raw[bucket], trusted[bucket] = r, t
    if not trusted.any():
        return np.zeros(len(raw), np.int64)
    out = np.zeros(len(raw))
    for k in range(len(ORDERS)):
        own = slice(k * BUCKETS, (k + 1) * BUCKETS)
        out[own] = np.log((trusted[own] + 1) / (trusted[own].sum() + BUCKETS)) - np.log((raw[own] + 1) / (raw[own].sum() + BUCKETS))
    return np.rint(out * UNIT).astype(np.int64)


def base_counts(block: Block) -> dict[str, np.ndarray]:
    """The counts of the fixed rules for each text of a block."""
    starts, ends, before = block.words()
    hasher = Hasher(block.data)
    space = IS_SPACE[block.data]
    line_starts, line_ends, line_before = block.pieces(block.data != 0x0A)
    sums = np.concatenate([[0], np.cumsum(~space)])
    with_word = sums[line_ends] > sums[line_starts]
    line_hash = hasher(line_starts, line_ends)
    windows, window_before = shingles(hasher(starts, ends), before, 3)
    n_words = np.diff(before)
    dup, repeated = np.zeros(block.n, np.int64), np.zeros(block.n, np.int64)
    for i in range(block.n):
        lines = line_hash[line_before[i] : line_before[i + 1]][with_word[line_before[i] : line_before[i + 1]]]
        if len(lines) > 1:
            dup[i] = len(lines) - len(np.unique(lines))
        if n_words[i] > 3:
            own = windows[window_before[i] : window_before[i + 1]]
            order = np.argsort(own)
            ranked = own[order]
            same = ranked[1:] == ranked[:-1]
            if same.any():
                twice = np.zeros(len(own), bool)
                twice[1:] = same
                twice[:-1] |= same
                hit = np.zeros(len(own), bool)
                hit[order] = twice
                covered = np.zeros(n_words[i], bool)
                for j in range(3):
                    covered[j : j + len(hit)] |= hit
                repeated[i] = covered.sum()
    return {
        "n_words": n_words,
        "word_chars": block.per_text(IS_FIRST[block.data] & ~space),
        "n_symbols": block.per_text(IS_SYMBOL[block.data]),
        "n_dup_lines": dup,
        "n_repeat_words": repeated,
    }


def block_ratio(block: Block, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's number of n-grams and the mean of their log ratios (0 without any)."""
    total, n = np.zeros(block.n, np.int64), np.zeros(block.n, np.int64)
    for key, before in gram_buckets(block):
        sums = np.concatenate([[0], np.cumsum(ratios[key])])
        total += sums[before[1:]] - sums[before[:-1]]
        n += np.diff(before)
    return n, total / np.maximum(n, 1) / UNIT


def judge(docs: DataFrame, ratios: np.ndarray, threshold: float, columns: list[str]) -> DataFrame:
    """Each document's counts, ``ratio``, ``base_failed`` and ``kept``, with ``columns`` as ``__0``, ``__1``, ..."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(block: Block) -> dict[str, np.ndarray]:
        out = base_counts(block)
        out["n_grams"], out["ratio"] = block_ratio(block, sent.value)
        out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEATED * out["n_words"])
        out["kept"] = ~out["base_failed"] & (out["ratio"] >= threshold)
        return out

    return per_block(docs, "text", columns, _SCHEMA, run)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, DataFrame]:
    """The log ratios, the threshold, and each document as ``judge`` gives it without a threshold, written.

    Labels meet the written rows, not the texts.
    """
    known = stage(labelled(labels), "labelled")
    ratios = log_ratios(ngram_counts(docs, known))
    judged = stage(judge(docs, ratios, -np.inf, ["doc_id"]), "judged")
    scored = judged.where("not base_failed").select(F.col("__0").alias("doc_id"), "ratio")
    return ratios, threshold(scored.join(hint_by_size(known)(known), "doc_id").select("ratio", "good")), judged


def threshold(scored: DataFrame) -> float:
    """``best_cut`` of a table of ``ratio`` and ``good`` of any size.

    Marks are counted for each ratio, ratios are sorted in ranges, and each range begins with
    the counts of those below it. Shares are compared as whole numbers.
    """
    mark = F.col("good").cast("long")
    cuts = scored.groupBy("ratio").agg(F.sum(mark).alias("good"), F.sum(1 - mark).alias("bad"))
    cuts = stage(cuts.repartitionByRange("ratio").sortWithinPartitions("ratio").withColumn("range", F.spark_partition_id()), "cuts")
    ranges = cuts.groupBy("range").agg(F.sum("good").alias("in_good"), F.sum("bad").alias("in_bad"), F.max("ratio").alias("highest"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ranges = ranges.select(
        "range",
        *(F.coalesce(F.sum(f"in_{c}").over(earlier), F.lit(0)).alias(f"before_{c}") for c in ("good", "bad")),
        F.max("highest").over(earlier).alias("last"),
    )
    n_good, n_bad = cuts.agg(F.sum("good"), F.sum("bad")).first()
    if not n_good or not n_bad:
        return -np.inf
    inside = Window.partitionBy("range").orderBy("ratio")
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)

    def below(c: str) -> Column:
        return (F.coalesce(F.sum(c).over(ahead), F.lit(0)) + F.col(f"before_{c}")).cast("decimal(18,0)")

    gain = below("bad") * F.lit(n_good).cast("decimal(18,0)") - below("good") * F.lit(n_bad).cast("decimal(18,0)")
    lower = F.coalesce(F.lag("ratio").over(inside), F.col("last"))
    rated = cuts.join(F.broadcast(ranges), "range").select("ratio", gain.alias("gain"), lower.alias("lower"))
    best = rated.agg(F.max(F.struct("gain", (-F.col("ratio")).alias("low"), "lower")).alias("best")).first()["best"]
    return -np.inf if best["lower"] is None else (best["lower"] - best["low"]) / 2


def best_cut(scored: list[tuple[float, bool]]) -> float:
    """The cut with the largest share of good at or above it less that of bad, lowest first.

    It lies midway between two scores; without both marks everything passes. For scores at hand; ``threshold`` takes tables.
    """
    values = np.array([s for s, _ in scored])
    good = np.array([g for _, g in scored], bool)
    if not good.any() or good.all():
        return -np.inf
    cuts = np.unique(values)
    kept_good = 1 - np.searchsorted(np.sort(values[good]), cuts) / good.sum()
    kept_bad = 1 - np.searchsorted(np.sort(values[~good]), cuts) / (~good).sum()
    best = int(np.argmax(kept_good - kept_bad))
    return float((cuts[best - 1] + cuts[best]) / 2) if best else -np.inf


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, the counts, the ratio and the verdict of each document."""
    _, cut, judged = fit(docs, labels)
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= F.lit(cut)))
    return named(judged, ["doc_id"], [f.split()[0] for f in _SCHEMA.split(", ")])


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    ratios, cut, _ = fit(docs, labels)
    return named(judge(docs, ratios, cut, docs.columns).where("kept"), docs.columns, [])

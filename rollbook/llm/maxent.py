"""Scoring texts by a hashed maximum-entropy language model.

A text's tokens are its ASCII-lowered words and one end. The model's chance of a
token is that of its class given the words before it, times that of its member
of the class, times the token's share of that member's smoothed count:

    p(token | before) = p(class | before) * p(member | class, before) * (c + 0.1) / mass(member)

The first two are softmaxes of sums of weights, one row for each feature of the
words before: the last word, the last two (hashed), and, skipping, the second
and the third last. The most frequent words are members of their own; others share the
members of their last bytes. Weights are trained in rounds over all training
documents: every task makes gradient steps on its texts from the weights of
the round before, and the tasks' weights are averaged by the tokens they saw.

Token counts of the whole training part are exact. Those of the ``FREQUENT``
most frequent words are broadcast; counts of the others are joined by the hash
of the word, in rows of (text, rare word). ``base_score`` is the smoothed unigram score from the same counts.

Null and empty texts are one end token. Documents without an id count as
training documents. Repeated rows are counted and scored one by one; other
columns are ignored. Words are 64-bit hashes. Without training documents V and N
are 0 and every word is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.blocks import LOWER, Block, Hasher, blocks, mix
from rollbook.llm.tables import stage

SMOOTHING = 0.1
#: Words whose counts are broadcast, at most.
FREQUENT = 1 << 19
#: Different words that a task counts before it passes counts on.
COUNTED = 1 << 20
ROUNDS = 2
RATE = 0.4

CLASSES, MEMBERS = 16, 16
SLOTS = CLASSES * MEMBERS
#: Words with a member of their own; the other members are shared.
OWN = SLOTS // 2
#: Words that are told apart as context; others go by their last bytes.
CONTEXT = 2048
CONTEXTS = 2 * CONTEXT
PAIRS = 1 << 14
#: Rows of each feature: last word, last two, second last, third last.
ROWS = (CONTEXTS, PAIRS, CONTEXTS, CONTEXTS)
#: Hashed rows of each feature and class.
MEMBER_ROWS = 1 << 14
#: Bytes of one row of weights that are sent between tasks.
PART_BYTES = 1 << 13

END = int(mix(np.array([0x456E64], np.uint64))[0])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(_remainder(doc_id) == 0, F.lit(False))


def _remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 10


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, their endings (less than ``OWN``), and the tokens before each text."""
    low = Block(LOWER[block.data], block.at, block.first)
    starts, ends, before = low.words()
    n = np.diff(before) + 1
    at = np.concatenate([[0], np.cumsum(n)])
    word = np.ones(at[-1], bool)
    word[at[1:] - 1] = False
    hashes, ending = np.full(at[-1], END, np.uint64), np.zeros(at[-1], np.int64)
    hashes[word] = Hasher(low.data)(starts, ends)
    two = low.data[ends - 1].astype(np.uint64) << np.uint64(8)
    two |= np.where(ends - starts > 1, low.data[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    ending[word] = (mix(two) >> np.uint64(57)).astype(np.int64)
    return hashes, ending, at


def token_counts(training: DataFrame) -> DataFrame:
    """``word, ending, n`` of all tokens of all texts."""

    def merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, endings, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(words)
        words, endings, n = words[order], endings[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        return words[first], endings[first], np.add.reduceat(n, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(words: np.ndarray, endings: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(endings.astype(np.int32)), pa.array(n)], ["word", "ending", "n"])

        parts: list[tuple] = []
        for batch in batches:
            for block in blocks(batch.column("text")):
                hashes, ending, _ = tokens(block)
                parts.append(merged([(hashes, ending, np.ones(len(hashes), np.int64))]))
                if sum(len(p[0]) for p in parts) > 2 * COUNTED:
                    parts = [merged(parts)]
                    if len(parts[0][0]) > COUNTED:
                        yield out(*parts.pop())
        if parts:
            yield out(*merged(parts))

    return training.select("text").mapInArrow(run, "word long, ending int, n long").groupBy("word", "ending").agg(F.sum("n").alias("n"))


class Counts:
    """Counts of frequent words, and what the model's tokens are made of."""

    def __init__(self, words: np.ndarray, n: np.ndarray, total: int, different: int, mass: np.ndarray, all_known: bool):
        order = np.argsort(words)
        self.words, self.n = words[order], n[order]
        self.total, self.different, self.all_known = total, different, all_known
        top = np.lexsort((self.words, -self.n))
        self.rank = np.full(len(words), CONTEXTS, np.int32)
        self.rank[top[:CONTEXT]] = np.arange(min(CONTEXT, len(top)))
        self.bits = max(1, int(len(words)).bit_length())
        edges = np.arange((1 << self.bits) + 1, dtype=object) << (64 - self.bits)
        edges[-1] -= 1
        self.starts = np.searchsorted(self.words, edges.astype(np.uint64)).astype(np.int32)
        self.starts[-1] = len(words)
        own = top[:OWN]
        weight = np.zeros(SLOTS)
        weight[: len(own)] = self.n[own] + SMOOTHING
        self.mass = mass + SMOOTHING  # of each ending: known words and an unknown one
        weight[OWN:] = self.mass
        weight += 1e-9
        share = weight.reshape(CLASSES, MEMBERS) / weight.sum()
        self.class_bias = np.log(share.sum(1)).astype(np.float32)
        self.member_bias = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
        self.floor = np.log10(total + SMOOTHING * (different + 1))

    @classmethod
    def of(cls, parts: dict) -> Counts:
        """From ``vars`` of one: broadcasts hold plain values, so that tasks need no class to read them."""
        out = cls.__new__(cls)
        vars(out).update(parts)
        return out

    def spots(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word among the frequent ones, -1 for others."""
        bucket = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        at, last = self.starts[bucket].astype(np.int64), self.starts[bucket + 1]
        out = np.full(len(hashes), -1, np.int64)
        live = np.flatnonzero(at < last)
        while len(live):
            hit = self.words[at[live]] == hashes[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < last[live]]
        return out


def gather(training: DataFrame, limit: int = FREQUENT) -> tuple[Counts, DataFrame]:
    """The frequent words' counts, and the table of the others."""
    counts = stage(token_counts(training).withColumn("size", F.floor(F.log2("n") * 16).cast("int")), "counts")
    sizes = counts.groupBy("size").agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()  # at most 1,024 rows
    least, kept = 1 << 30, 0
    for size, words, _ in sorted(sizes, reverse=True):
        if kept + words > limit:
            break
        least, kept = size, kept + words
    frequent = counts.where(F.col("size") >= least).select("word", "n", "ending").toArrow()
    words, n, ending = (frequent.column(c).to_numpy() for c in ("word", "n", "ending"))
    words = words.view(np.uint64)
    different, total = sum(s[1] for s in sizes), sum(s[2] for s in sizes)
    mass = np.zeros(OWN)
    for e, m in counts.groupBy("ending").agg(F.sum(F.col("n") + F.lit(SMOOTHING))).collect():
        mass[e] = m
    own = np.lexsort((words, -n))[:OWN]
    np.subtract.at(mass, ending[own], n[own] + SMOOTHING)
    return Counts(words, n, total, different, np.maximum(mass, 0.0), kept == different), counts.where(F.col("size") < least).select("word", "n")


class Model:
    """Weights of classes by feature row, and of members by hashed row of feature and class."""

    def __init__(self, classes: list[np.ndarray] | None = None, members: list[np.ndarray] | None = None):
        self.classes = classes or [np.zeros((r, CLASSES), np.float32) for r in ROWS]
        self.members = members or [np.zeros((MEMBER_ROWS, MEMBERS), np.float32) for _ in ROWS]

    def arrays(self) -> list[np.ndarray]:
        return [*self.classes, *self.members]

    def to_bytes(self) -> bytes:
        return b"".join(a.astype("<f4").tobytes() for a in self.arrays())

    @classmethod
    def from_bytes(cls, raw: bytes) -> Model:
        flat, at, out = np.frombuffer(raw, "<f4"), 0, []
        for like in cls().arrays():
            out.append(flat[at : at + like.size].reshape(like.shape).copy())
            at += like.size
        return cls(out[: len(ROWS)], out[len(ROWS) :])


class Tokens:
    """The tokens of a block as the model sees them."""

    def __init__(self, block: Block, counts: Counts):
        self.hashes, ending, self.at = tokens(block)
        self.spots = counts.spots(self.hashes)
        rank = np.where(self.spots >= 0, counts.rank[self.spots], CONTEXTS) if len(counts.words) else np.full(len(self.spots), CONTEXTS)
        self.ending = ending
        self.slot = np.where(rank < OWN, rank, OWN + ending).astype(np.int64)
        context = np.where(rank < CONTEXT, rank, CONTEXT + (ending * 16 + (self.hashes & np.uint64(15)).astype(np.int64)) % CONTEXT)
        before = []
        for back in (1, 2, 3):  # nothing before a text's start: the end's context
            x = np.zeros(len(context), np.int64)
            x[back:] = context[:-back]
            for j in range(back):
                edge = self.at[:-1] + j
                x[edge[edge < self.at[1:]]] = CONTEXTS - 1
            before.append(x)
        one, two, three = before
        pair = (one * CONTEXTS + two).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 14)
        self.rows = (one, pair.astype(np.int64), two, three)
        self.group = self.slot // MEMBERS
        self.member_rows = tuple(((r * CLASSES + self.group).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - 14)).astype(np.int64) for r in self.rows)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    """Over the first axis, in place: a row for each outcome is quicker than a row for each token."""
    x -= x.max(0)
    x -= np.log(np.exp(x).sum(0))
    return x


def log_chances(model: Model, counts: Counts, t: Tokens, part: slice) -> tuple[np.ndarray, np.ndarray]:
    """Natural logs of the chances of all classes, and of all members of the token's class; a column for each token."""
    group = model.classes[0].take(t.rows[0][part], 0)
    own = np.empty_like(group)
    for table, rows in zip(model.classes[1:], t.rows[1:], strict=True):
        group += table.take(rows[part], 0, own, "clip")  # rows are in range; to check them takes a copy
    member = counts.member_bias.take(t.group[part], 0)
    own = np.empty_like(member)
    for table, rows in zip(model.members, t.member_rows, strict=True):
        member += table.take(rows[part], 0, own, "clip")
    group = np.ascontiguousarray(group.T)
    group += counts.class_bias[:, None]
    return _log_softmax(group), _log_softmax(np.ascontiguousarray(member.T))


def parts_of(n: int, size: int = 1 << 13) -> Iterator[slice]:
    """Slices that fit a processor's cache."""
    return (slice(i, min(i + size, n)) for i in range(0, n, size))


def steps(model: Model, counts: Counts, block: Block, squares: list[np.ndarray], rate: float) -> int:
    """One gradient step on a block's tokens, scaled by the squares of the gradients so far."""
    t = Tokens(block, counts)
    n = len(t.slot)
    group, member = np.empty((CLASSES, n)), np.empty((MEMBERS, n))
    for part in parts_of(n):
        group[:, part], member[:, part] = (np.exp(x) for x in log_chances(model, counts, t, part))
    place = np.arange(n)
    group[t.group, place] -= 1
    member[t.slot % MEMBERS, place] -= 1
    tables = model.arrays()
    for table, square, rows, miss in zip(tables, squares, (*t.rows, *t.member_rows), [group] * len(ROWS) + [member] * len(ROWS), strict=True):
        turned = np.empty(table.shape[::-1], np.float32)
        for k, own in enumerate(miss):
            turned[k] = np.bincount(rows, own, len(table))
        g = np.ascontiguousarray(turned.T)
        square += g * g
        g *= rate
        g /= np.sqrt(square)
        table -= g
    return n


def trained(training: DataFrame, counts: Counts, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """All training texts, dealt into ``rounds`` by a hash of the id; each round ends with the tasks' mean."""
    context = training.sparkSession.sparkContext
    known, raw = context.broadcast(vars(counts)), Model().to_bytes()
    for r in range(rounds):
        start = context.broadcast(raw)

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            model, own_counts = Model.from_bytes(start.value), Counts.of(known.value)
            squares = [np.full(a.shape, 1.0, np.float32) for a in model.arrays()]
            seen = 0
            for batch in batches:
                for block in blocks(batch.column("text")):
                    seen += steps(model, own_counts, block, squares, rate)
            if seen:
                weights = np.concatenate([a.ravel() for a in model.arrays()]).astype("<f2").tobytes()
                parts = [weights[i : i + PART_BYTES] for i in range(0, len(weights), PART_BYTES)]
                for i in range(0, len(parts), 64):
                    own = parts[i : i + 64]
                    yield pa.RecordBatch.from_arrays([pa.array(range(i, i + len(own)), pa.int32()), pa.array([seen] * len(own), pa.int64()), pa.array(own, pa.binary())], ["part", "seen", "weights"])

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, tuple[int, np.ndarray]] = {}  # as many as the model has parts
            for batch in batches:
                for part, seen, weights in zip(*(batch.column(c).to_pylist() for c in ("part", "seen", "weights")), strict=True):
                    n, x = sums.get(part, (0, 0.0))
                    sums[part] = (n + seen, x + seen * np.frombuffer(weights, "<f2").astype(np.float64))
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(x / n).astype("<f4").tobytes() for n, x in sums.values()], pa.binary())], ["part", "weights"])

        own = training.where(F.coalesce(F.crc32(F.concat(F.lit("round"), F.col("doc_id").cast("string")).cast("binary")) % rounds, F.lit(0)) == r)
        parts = own.select("text").mapInArrow(run, "part int, seen long, weights binary")
        means = parts.repartition("part").mapInArrow(mean, "part int, weights binary").collect()  # one model
        if means:
            raw = b"".join(w for _, w in sorted(means))
    return Model.from_bytes(raw)


def rare_words(t: Tokens, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different words of each text that aren't ``counted``, in order, how often each occurs in its text, and those before each text."""
    other = np.flatnonzero(~counted)
    words, text = t.hashes[other], np.repeat(np.arange(len(t.at) - 1), np.diff(t.at))[other]
    order = np.lexsort((words, text))
    words, text = words[order], text[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    at = np.searchsorted(text[first], np.arange(len(t.at))).astype(np.int32)
    return words[first], np.diff(np.append(first, len(words))), at


def scored(docs: DataFrame, limit: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each document."""
    own = docs.select("doc_id", "text")
    training = own.where(~held_out(F.col("doc_id")))
    counts, rare = gather(training, limit)
    model = trained(training, counts, rounds)
    context = docs.sparkSession.sparkContext
    known, sent = context.broadcast(vars(counts)), context.broadcast(model.to_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, c, m = TaskContext.get().partitionId() << 33, Counts.of(known.value), Model.from_bytes(sent.value)
        log_n = np.log10(c.n + SMOOTHING)
        log_mass = np.concatenate([np.zeros(OWN), np.log10(c.mass)])
        for batch in batches:
            for block in blocks(batch.column("text")):
                t = Tokens(block, c)
                chance = np.empty(len(t.slot))
                for part in parts_of(len(chance)):
                    group, member = log_chances(m, c, t, part)
                    place = np.arange(group.shape[1])
                    chance[part] = group[t.group[part], place] + member[t.slot[part] % MEMBERS, place]
                chance = chance / np.log(10) - log_mass[t.slot]
                is_known = t.spots >= 0
                if len(log_n):
                    count = np.where(is_known, log_n[t.spots], 0.0 if not c.all_known else np.log10(SMOOTHING))
                else:
                    count = np.full(len(t.slot), np.log10(SMOOTHING) if c.all_known else 0.0)
                first = t.at[:-1]
                shared = np.where(t.slot < OWN, 0.0, count)
                n = np.diff(t.at)
                words, times, at = rare_words(t, is_known | c.all_known)
                mine = batch.slice(block.first, block.n)
                yield pa.RecordBatch.from_arrays(
                    [
                        mine.column("doc_id"),
                        pa.array(np.arange(row, row + block.n)),
                        pa.array(n),
                        pa.array(np.add.reduceat(is_known.astype(np.int64), first)),
                        pa.array(np.add.reduceat(count, first) - n * c.floor),
                        pa.array(np.add.reduceat(chance + shared, first)),
                        pa.ListArray.from_arrays(at, pa.array(words.view(np.int64))),
                        pa.ListArray.from_arrays(at, pa.array(times)),
                    ],
                    ["doc_id", "row", "n_tokens", "known", "base", "model", "words", "times"],
                )
                row += block.n

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = stage(own.mapInArrow(run, f"doc_id {kind}, row long, n_tokens long, known long, base double, model double, words array<long>, times array<long>"), "texts")
    each = texts.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    found = each.join(rare, "word", "left")
    more = found.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTHING))).alias("add"),
    )
    whole = texts.select("doc_id", "row", "n_tokens", "known", "base", "model").join(more, "row", "left")
    add = F.coalesce("add", F.lit(0.0))
    return whole.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(counts.total)).cast("long").alias("train_tokens"), (F.col("base") + add).alias("base_score"), (F.col("model") + add).alias("score"),
    )

"""Exact Jaccard self-join of documents on word shingles, by a count-vector R-tree.

Documents link when ``den * |A and B| >= num * |A or B|`` for their sets of
``k``-word shingles (words of ASCII-lowered text). Equal sets are one node, so
copies are never expanded into pairs.

1. *Cells.* A set's shingles are hashed into groups. Sets that are similar
   enough differ in at most r shingles, where r follows from their sizes; with
   more than r groups, some group is equal in both. Its content is their common
   key, so every link lies in some cell of equal keys, at about 0.2 keys a word
   for 0.9. Sizes come in classes, and a set is keyed for its own class and, if
   it can be the larger of a pair, for the class below. A set with so many empty
   groups that all equal ones might be empty also has its lowest shingles as
   keys (a prefix filter, complete for the similarity).
2. *R-tree.* In a cell the sets are points of group counts in an R-tree; the
   sums of coordinate minima bound overlaps. The first pass takes a spanning
   forest of the pairs that the bound allows, so that a cell of thousands of
   near copies gives thousands of pairs, not millions.
3. *Verify.* Pairs are compared on their whole sets; links give components.
4. Cells in which more than one component is left are searched again, for all
   pairs between components that the bound allows; those are verified too. After
   that every link has been verified or lies within a component.

Shingles are 64-bit hashes. Null and empty texts, and texts without words, have
empty sets and link with nothing. Repeated rows are copies. A null ``doc_id``
takes part and never is a component's id unless no other is in it. Columns
other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.blocks import LOWER, Block, Hasher, blocks, mix, shingles
from rollbook.llm.carry import per_block
from rollbook.llm.components import components
from rollbook.llm.rtree import RTree
from rollbook.llm.tables import stage

#: Coordinates of a point: the more, the fewer differences cancel in a coordinate.
GROUPS = 256
#: Members of a cell that are searched together.
SLAB = 4096
#: Sets that a task remembers in order to key each only once.
REMEMBERED = 1 << 18


def block_sets(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text, end to end, and those before each text."""
    low = Block(LOWER[block.data], block.at, block.first)
    starts, ends, before = low.words()
    hashes, at = shingles(Hasher(low.data)(starts, ends), before, k)
    own = [np.unique(hashes[at[i] : at[i + 1]]) for i in range(block.n)]
    sizes = np.array([len(x) for x in own], np.int64)
    return (np.concatenate(own) if own else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def set_ids(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set, equal for equal sets."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes), out=sums[1:])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def document_sets(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n_shingles, set_id`` of each document; no set id for an empty set."""

    def run(block: Block) -> dict:
        hashes, at = block_sets(block, k)
        n = np.diff(at)
        return {"n_shingles": n, "set_id": pa.array(set_ids(hashes, at), mask=n == 0)}

    out = per_block(docs, "text", ["doc_id"], "n_shingles long, set_id long", run)
    return out.select(F.col("__0").alias("doc_id"), "n_shingles", "set_id")


class SizeClasses:
    """Classes of set sizes, each as wide as the similarity allows."""

    def __init__(self, num: int, den: int, largest: int):
        self.num, self.den = num, den
        low, high = [1], [den // num]
        while high[-1] < largest:
            low.append(high[-1] + 1)
            high.append(low[-1] * den // num)
        self.high = np.array(high, np.int64)
        self.differ = (den - num) * self.high // num
        self.groups = self.differ + 2 + self.differ // 8

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.high, sizes)


def cell_keys(hashes: np.ndarray, at: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of sets laid end to end: the set each belongs to, and the key."""
    sizes = np.diff(at)
    classes = SizeClasses(num, den, int(sizes.max(initial=1)))
    own_class = classes.of(sizes)
    values, spread = mix(hashes), hashes >> np.uint64(20)
    owners, keys = [], []
    sparse = np.zeros(len(sizes), bool)
    for down in (0, 1):
        kind = own_class - down
        use = (sizes > 0) & (kind >= 0)
        at_kind = np.maximum(kind, 0)
        if down:
            use &= classes.high[at_kind] * den >= num * sizes
        use &= classes.differ[at_kind] > 0  # otherwise only equal sets are similar
        chosen = np.flatnonzero(use)
        if not len(chosen):
            continue
        m = classes.groups[kind[chosen]]
        first = np.concatenate([[0], np.cumsum(m)])
        mine = np.repeat(use, sizes)
        group = (spread[mine] % np.repeat(m, sizes[chosen]).astype(np.uint64)).astype(np.int64) + np.repeat(first[:-1], sizes[chosen])
        total = np.zeros(first[-1], np.uint64)
        np.add.at(total, group, values[mine])
        filled = np.bincount(group, minlength=first[-1]) > 0
        owner = np.repeat(chosen, m)
        label = (np.arange(first[-1]) - np.repeat(first[:-1], m) + (np.repeat(kind[chosen], m) << 32)).astype(np.uint64)
        keys.append(mix(total + mix(label))[filled])
        owners.append(owner[filled])
        empty = m - np.add.reduceat(filled.astype(np.int64), first[:-1])
        sparse[chosen] |= empty >= m - classes.differ[kind[chosen]]
    for i in np.flatnonzero(sparse):
        n = int(sizes[i])
        prefix = hashes[at[i] : at[i] + n + (-num * n // den) + 1]
        keys.append(mix(prefix ^ np.uint64(0x5851F42D4C957F2D)))
        owners.append(np.full(len(prefix), i))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(keys).view(np.int64)


def keyed_sets(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``(key, set_id)`` for all keys of all sets; a task keys a copy once, if it remembers it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for block in blocks(batch.column("text")):
                hashes, at = block_sets(block, k)
                ids = set_ids(hashes, at)
                fresh = np.zeros(block.n, bool)
                for i, x in enumerate(ids.tolist()):
                    if x not in seen:
                        fresh[i] = True
                        seen.add(x)
                if len(seen) > REMEMBERED:
                    seen.clear()
                sizes = np.diff(at) * fresh
                hashes = hashes[np.repeat(fresh, np.diff(at))]
                owner, key = cell_keys(hashes, np.concatenate([[0], np.cumsum(sizes)]), num, den)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[owner])], ["key", "set_id"])

    return docs.select("text").mapInArrow(run, "key long, set_id long")


def shared_cells(keyed: DataFrame) -> DataFrame:
    """Members ``(cell, slab, set_id)`` of the cells with two sets or more.

    Read in the order of keys with a carried run, so the memory of a task does
    not grow with a cell. A cell is the hash of its key; members are numbered in slabs.
    """
    ordered = keyed.repartition("key").sortWithinPartitions("key", "set_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int] | None = None  # the last run's only member so far
        last_key, last_id, count = None, None, 0
        for batch in batches:
            key, ids = (batch.column(i).to_numpy() for i in range(2))
            if not len(key):
                continue
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
            fresh[0] = (int(key[0]), int(ids[0])) != (last_key, last_id)
            key, ids = key[fresh], ids[fresh]
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = int(key[0]) != last_key
            start = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            rank = np.arange(len(key)) - start
            head = start < 0  # goes on with the run of the batch before
            rank[head] = np.arange(head.sum()) + count
            more = np.zeros(len(key), bool)  # another member follows here
            more[:-1] = ~new[1:]
            out = more | ~new
            out[-1] &= not new[-1]  # a run's first member waits for the second
            out_key, out_ids, out_rank = key[out], ids[out], rank[out]
            if held and not new[0]:
                out_key, out_ids, out_rank = (np.concatenate([[a], b]) for a, b in zip((*held, 0), (out_key, out_ids, out_rank), strict=True))
            last_key, last_id, count = int(key[-1]), int(ids[-1]), int(rank[-1]) + 1
            held = (last_key, last_id) if new[-1] else None
            yield pa.RecordBatch.from_arrays([pa.array(out_key), pa.array((out_rank // SLAB).astype(np.int32)), pa.array(out_ids)], ["cell", "slab", "set_id"])

    return ordered.mapInArrow(run, "cell long, slab int, set_id long")


def distinct_cells(cells: DataFrame) -> DataFrame:
    """One of the slabs with the same members: near copies share many cells."""
    content = cells.groupBy("cell", "slab").agg(F.bit_xor(F.xxhash64("set_id")).alias("x"), F.count("*").alias("n"))
    first = content.groupBy("x", "n").agg(F.min(F.struct("cell", "slab")).alias("s")).select("s.cell", "s.slab")
    return cells.join(first, ["cell", "slab"], "left_semi")


def points(docs: DataFrame, sets: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """``set_id, n, counts, shingles`` of the ``needed`` sets, from the text of one document each."""
    one = sets.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("id")).join(needed, "set_id", "left_semi")
    ids = one.select("id").distinct()
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")

    def run(block: Block) -> dict:
        hashes, at = block_sets(block, k)
        sizes = np.diff(at)
        group = (hashes % np.uint64(GROUPS)).astype(np.int64) + np.repeat(np.arange(block.n) * GROUPS, sizes)
        counts = np.bincount(group, minlength=block.n * GROUPS).astype("<u4").tobytes()
        whole = hashes.astype("<u8").tobytes()
        return {
            "n": sizes,
            "set_id": pa.array(set_ids(hashes, at), mask=sizes == 0),
            "counts": pa.array([counts[i * 4 * GROUPS : (i + 1) * 4 * GROUPS] for i in range(block.n)], pa.binary()),
            "shingles": pa.array([whole[8 * a : 8 * b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
        }

    out = per_block(texts, "text", [], "n long, set_id long, counts binary, shingles binary", run)
    return out.join(needed, "set_id", "left_semi").dropDuplicates(["set_id"])


def searched(members: DataFrame, num: int, den: int, across: bool) -> DataFrame:
    """Pairs ``(a, b)``, a < b, that the bound allows in each part of ``members``.

    ``members`` has ``part, root, set_id, n, counts``. Without ``across`` a
    spanning forest of each part's pairs; with it all pairs of two roots.
    """
    ordered = members.select("part", "root", "set_id", "n", "counts").repartition("part").sortWithinPartitions("part")

    def pairs_of(root: np.ndarray, ids: np.ndarray, n: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
        tree = RTree(counts, n, num, den)
        if not across:
            return [(min(a, b), max(a, b)) for a, b in ((int(ids[x]), int(ids[y])) for x, y in tree.forest()) if a != b]
        # Of a pair between roots at least one set is outside the root with the most sets.
        _, of, sizes = np.unique(root, return_inverse=True, return_counts=True)
        small = of != int(np.argmax(sizes))
        out = []
        for x in np.flatnonzero(small).tolist():
            rows = tree.near(x)
            rows = rows[(of[rows] != of[x]) & (~small[rows] | (ids[rows] > ids[x]))]
            out += [(min(int(ids[x]), y), max(int(ids[x]), y)) for y in ids[rows].tolist()]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[list[np.ndarray]]:
            held: list[list[np.ndarray]] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                part = batch.column("part").to_numpy()
                counts = np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<u4").reshape(-1, GROUPS).astype(np.int32)
                rows = [part, *(batch.column(c).to_numpy() for c in ("root", "set_id", "n")), counts]
                cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)]
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    if held and held[0][0][0] != part[i]:
                        yield [np.concatenate(x) for x in zip(*held, strict=True)][1:]
                        held = []
                    held.append([x[i:j] for x in rows])
            if held:
                yield [np.concatenate(x) for x in zip(*held, strict=True)][1:]

        for own in parts():
            found = pairs_of(*own)
            for i in range(0, len(found), 10_000):
                a, b = zip(*found[i : i + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return ordered.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, points_of: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose whole sets are similar enough, compared in full."""
    whole = points_of.select("set_id", "shingles")
    left = whole.select(F.col("set_id").alias("a"), F.col("shingles").alias("left"))
    right = whole.select(F.col("set_id").alias("b"), F.col("shingles").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), "<u8") for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def set_links(docs: DataFrame, sets: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links between different sets, enough to connect all that are linked, and the components by them."""
    cells = stage(shared_cells(keyed_sets(docs, k, num, den)), "cells")
    spot = stage(points(docs, sets, cells.select("set_id").distinct(), k), "points")
    place = spot.select("set_id", "n", "counts")
    once = stage(distinct_cells(cells), "once")
    first = once.join(place, "set_id").select(F.xxhash64("cell", "slab").alias("part"), F.lit(0).cast("long").alias("root"), "set_id", "n", "counts")
    tried = stage(searched(first, num, den, False), "tried")
    links = stage(verified(tried, spot, num, den), "verified")
    groups = stage(components(links), "groups")
    # Whole cells, since slabs of one cell may hold a link between them.
    rooted = cells.join(groups.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    left = rooted.groupBy("cell").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("slab").alias("last"),
        F.bit_xor(F.xxhash64("set_id")).alias("x"), F.count("*").alias("n"),
    ).where("lo <> hi")
    open_cells = left.groupBy("x", "n").agg(F.min(F.struct("cell", "last")).alias("s")).select("s.cell", "s.last")
    again = (
        rooted.join(open_cells, "cell")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .select(F.xxhash64("cell", F.least("slab", "other"), F.greatest("slab", "other")).alias("part"), "root", "set_id")
        .join(place, "set_id")
    )
    more = searched(again, num, den, True).join(tried, ["a", "b"], "left_anti")
    more = stage(verified(more, spot, num, den), "verified")
    if more.isEmpty():
        return links, groups
    every = links.union(more)
    return every, stage(components(every), "groups")


def jaccard_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each document.

    ``component_id`` is the smallest ``doc_id`` that links reach, its own included.
    """
    sets = stage(document_sets(docs, k), "sets")
    _, groups = set_links(docs, sets, k, num, den)
    nodes = sets.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("id"))
    rooted = nodes.join(groups.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    of_set = rooted.join(least, "root").select("set_id", "component_id")
    joined = sets.join(of_set, "set_id", "left")
    alone = F.col("set_id").isNull()
    return joined.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The document with the smallest id of each group, with all its columns.

    Rows with the same id stay or go together; of exact repeats one stays.
    """
    groups = jaccard_groups(docs, k, num, den)
    stays = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(stays, docs["doc_id"].eqNullSafe(stays["__id"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])

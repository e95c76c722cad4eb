from collections import Counter

import numpy as np
import pytest

from rollbook.llm import jaccard
from rollbook.llm.components import components
from rollbook.llm.rtree import RTree


def brute(rows, words, k, num, den):
    """Set sizes and components by comparing all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x] if j > i)
        for j, o in shared.items():
            if den * o >= num * (len(s) + len(sets[j]) - o):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    return Counter((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100), (2, 50, 100)])
def test_groups_equal_brute_force(docs, texts, words_of, lowered, k, num, den):
    got = Counter(tuple(r) for r in jaccard.jaccard_groups(docs, k, num, den).collect())
    assert got == brute(list(texts.items()), lambda t: words_of(lowered(t)), k, num, den)


def test_near_copies_at_the_edge(spark, words_of, lowered):
    """Texts that differ in one to many words, in chains, around the threshold."""
    rng = np.random.default_rng(1)
    rows = []
    for n in (8, 12, 30, 90, 200):
        text = [f"w{x}" for x in rng.integers(0, 10_000, n)]
        for _ in range(25):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(rng.integers(0, max(2, n // 25))):
                text[rng.integers(0, len(text))] = f"w{rng.integers(0, 10_000)}"
            if rng.random() < 0.3:
                text = text[: -int(rng.integers(1, max(2, n // 15)))]
    order = rng.permutation(len(rows))
    rows = [(int(order[i]), t) for i, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for k, num, den in ((3, 90, 100), (1, 80, 100)):
        got = Counter(tuple(r) for r in jaccard.jaccard_groups(df, k, num, den).collect())
        assert got == brute(rows, lambda t: words_of(lowered(t)), k, num, den)


def test_odd_rows(odd, odd_rows, words_of, lowered):
    got = Counter(tuple(r) for r in jaccard.jaccard_groups(odd, 3, 90, 100).collect())
    want = brute([(r[0], r[1]) for r in odd_rows], lambda t: words_of(lowered(t)), 3, 90, 100)
    assert got == want


def test_one_of_each_group_stays_with_its_columns(odd):
    # Rows without an id stay together, and the empty one of them is a group by itself.
    kept = jaccard.one_of_each(odd, 3, 90, 100)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in (1, 3, 4, 5, 6, 7, 8, 9, 10)] + [(True, 0)] * 2


def test_empty_table(nothing):
    assert jaccard.jaccard_groups(nothing, 3, 90, 100).collect() == []


def test_cells_hold_every_similar_pair():
    """Any two sets at or above the threshold share a key."""
    rng = np.random.default_rng(2)
    for num, den in ((90, 100), (80, 100), (60, 100)):
        sets, pairs = [], []
        for _ in range(300):
            n = int(rng.integers(1, 120))
            base = rng.integers(0, 1 << 62, n).astype(np.uint64)
            other = base.copy()
            for _ in range(int(rng.integers(0, 1 + n * (den - num) // den))):
                if rng.random() < 0.5 and len(other) > 1:
                    other = np.delete(other, rng.integers(0, len(other)))
                else:
                    other = np.append(other, np.uint64(rng.integers(0, 1 << 62)))
            a, b = np.unique(base), np.unique(other)
            both = len(np.intersect1d(a, b))
            if den * both >= num * (len(a) + len(b) - both) and not np.array_equal(a, b):
                pairs.append((len(sets), len(sets) + 1))
                sets += [a, b]
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        owner, key = jaccard.cell_keys(np.concatenate(sets), at, num, den)
        keys = [set(key[owner == i].tolist()) for i in range(len(sets))]
        assert pairs
        assert all(keys[a] & keys[b] for a, b in pairs)


def test_tree_finds_what_the_bound_allows():
    rng = np.random.default_rng(3)
    counts = rng.poisson(4, (500, 16)).astype(np.int64)
    counts[100:200] = counts[:100] + rng.integers(0, 2, (100, 16))
    sizes = counts.sum(1)
    tree = RTree(counts, sizes, 80, 100)
    for i in range(0, 500, 7):
        overlap = np.minimum(counts, counts[i]).sum(1)
        want = np.flatnonzero(180 * overlap >= 80 * (sizes + sizes[i]))
        assert tree.near(i).tolist() == want.tolist()
    roots = list(range(500))
    for a, b in tree.forest():
        assert b in tree.near(a)
        roots = [roots[a] if r == roots[b] else r for r in roots]
    assert all(len({roots[j] for j in tree.near(i)}) == 1 for i in range(500))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(150, 300), (200, 201)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {i: 0 for i in range(41)} | {i: 100 for i in [*range(100, 160), 300]} | {200: 200, 201: 200}
    assert got == want

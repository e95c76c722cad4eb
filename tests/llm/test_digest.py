import math
from collections import Counter

import numpy as np
import pyarrow as pa

from rollbook.llm import digest
from rollbook.llm.blocks import blocks


def _entropy(window):
    total = sum(digest._PHI[n] for n in Counter(window).values())
    return int((digest._TOP - total) * digest.STEPS // digest._TOP)


def test_entropies_equal_counting():
    rng = np.random.default_rng(0)
    for data in (rng.integers(0, 256, 700), rng.integers(0, 4, 700), np.zeros(200, int), rng.integers(0, 9, 64), rng.integers(0, 9, 63)):
        data = data.astype(np.uint8)
        assert digest.entropies(data).tolist() == [_entropy(data[i : i + 64].tolist()) for i in range(max(len(data) - 63, 0))]
    exact = -sum(n / 64 * math.log2(n / 64) for n in Counter(data[:64].tolist()).values())
    assert abs(_entropy(rng.permutation(64).tolist()) - 1000) <= 1 and exact < 6


def test_selection_equals_brute_force(texts):
    """Also across texts: the places of a text are those it has alone."""
    sample = [*list(texts.values())[:40], "", "short", "y" * 64, "z" * 300]
    ranks = digest.rarity_ranks(np.arange(1001)[::-1].copy())
    for size in (1, 5000, 1 << 19):
        found = []
        for block in blocks(pa.array(sample), size):
            found += [(p - block.at[i]).tolist() for i, p in enumerate(digest.selected(block, ranks))]
        for text, places in zip(sample, found, strict=True):
            raw = text.encode()
            rank = [int(ranks[_entropy(raw[i : i + 64])]) for i in range(len(raw) - 63)]
            if not rank:
                assert places == []
                continue
            points = Counter()
            runs = [range(i, i + 64) for i in range(len(rank) - 63)] or [range(len(rank))]
            for run in runs:
                best = min(run, key=lambda i: (rank[i], i))
                if rank[best] < digest._NONE:
                    points[best] += 1
            want = sorted(i for i, n in points.items() if n >= min(16, len(runs)))
            assert places == (want or [0])


def test_histogram_covers_every_window(docs, texts):
    got = digest.entropy_histogram(docs.repartition(5))
    assert got.sum() == sum(max(len(t.encode()) - 63, 0) for t in texts.values())


def test_edits_follow_the_order_of_ids(docs, texts):
    rows = {r["doc_id"]: r for r in digest.with_edits(docs.repartition(7)).collect()}
    ids = sorted(texts, reverse=True)
    prints = {}
    for i, doc_id in enumerate(ids):
        text, following = texts[doc_id], texts[ids[(i + 1) % len(ids)]]
        third = len(text) // 3
        new = text[: len(text) - third] + following[:third]
        r = rows[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), digest.hashlib.sha256(new.encode()).hexdigest())
        assert r["near_next"] == digest.likeness(digest.read(r["fingerprint"]), digest.read(rows[ids[(i + 1) % len(ids)]]["fingerprint"]))
        assert r["near_edited"] == digest.likeness(digest.read(r["fingerprint"]), digest.read(r["edited_fingerprint"]))
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    long = [r for r in rows.values() if r["n_chars"] > 500]
    assert np.mean([r["near_edited"] for r in long]) > 0.55
    assert np.median([r["near_next"] for r in long]) < 0.1


def test_fingerprints_alone_are_the_same(docs):
    both = digest.fingerprints(docs).collect()
    assert dict(map(tuple, both)) == {r["doc_id"]: r["fingerprint"] for r in digest.with_edits(docs).collect()}


def test_likeness():
    none, full = np.zeros((0, 256), np.uint8), np.full((1, 256), 15, np.uint8)
    assert digest.likeness(none, none) == 1 and digest.likeness(none, full) == 0 and digest.likeness(full, full) == 1


def test_odd_rows(odd, odd_rows):
    rows = digest.with_edits(odd).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in rows) == Counter((r[0], len(r[1] or "")) for r in odd_rows)
    ordered = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in odd_rows), key=lambda x: (not x[0], -x[1], x[2]))
    following = Counter()
    for a, b in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        third = len(a[2]) // 3
        following[digest.hashlib.sha256((a[2][: len(a[2]) - third] + b[2][:third]).encode()).hexdigest()] += 1
    assert Counter(r["edited_sha256"] for r in rows) == following


def test_one_row_follows_itself(spark):
    (r,) = digest.with_edits(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert r["edited_sha256"] == digest.hashlib.sha256(b"abcdab").hexdigest()


def test_empty_table(nothing):
    assert digest.with_edits(nothing).collect() == []


def _cut(texts, low, high):
    raw = [t for t in texts.values() if t.isascii()]
    return [t[: low + i % (high - low)] for i, t in enumerate(raw) if len(t) >= high]


def test_short_texts_have_their_best_windows(docs, texts):
    """Where no window gets the points, those with the most are selected, not the first one."""
    ranks = digest.rarity_ranks(digest.entropy_histogram(docs))
    few = 0
    for block in blocks(pa.array(short := _cut(texts, 127, 201))):
        for text, at, places in zip(short, block.at.tolist(), digest.selected(block, ranks), strict=False):
            rank = [int(ranks[_entropy(text.encode()[i : i + 64])]) for i in range(len(text) - 63)]
            points = Counter(min(range(i, i + 64), key=lambda j: (rank[j], j)) for i in range(len(rank) - 63))
            most = max(points.values())
            few += most < min(16, len(rank) - 63)
            assert (places - at).tolist() == sorted(i for i, n in points.items() if n >= min(16, most))
    assert few > 10


def test_short_texts_with_a_common_opening(docs, texts):
    ranks = digest.rarity_ranks(digest.entropy_histogram(docs))
    short = _cut(texts, 127, 201)
    opening = short[0][:64]
    alike = [opening + t[64:] for t in short]
    prints = [rows for _, rows in digest._texts_filters([t.encode() for t in alike], ranks)]
    pairs = [(i, j) for j in range(len(alike)) for i in range(j) if alike[i][64:127] != alike[j][64:127]]
    assert sum(digest.likeness(prints[i], prints[j]) == 1 for i, j in pairs) < len(pairs) / 1000

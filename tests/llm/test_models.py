import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rollbook.llm import maxent, subwords
from rollbook.llm.blocks import blocks

SF1 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def more(spark):
    return spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/labels.parquet")


def test_classifier_on_held_out_labels(more):
    docs, labels = more
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = subwords.classified(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert np.mean([r["predicted"] == marks[r["doc_id"]] for r in held]) > 0.95


def test_held_out_labels_are_not_learned(more):
    docs, labels = more
    turned = labels.withColumn("quality", subwords.F.when(subwords.held_out(labels["doc_id"]), 1 - labels["quality"]).otherwise(labels["quality"]))
    assert sorted(map(tuple, subwords.classified(docs, turned).collect())) == sorted(map(tuple, subwords.classified(docs.repartition(9), labels).collect()))


def test_features_are_words_pairs_and_runs():
    (block,) = blocks(pa.array(["ab ab c", "", "xyz"]))
    counts = [np.diff(before).tolist() for _, before in subwords.features(block)]
    assert counts[:2] == [[3, 0, 1], [2, 0, 0]]
    assert counts[2] == [sum(" " not in t[i + 1 : i + 2] for i in range(len(t) - 2)) for t in ("ab ab c", "", "xyz")]
    alone = [[b[a[i] : a[i + 1]].tolist() for b, a in subwords.features(block)] for i in (0, 2)]
    for text, own in zip(("ab ab c", "xyz"), alone, strict=True):
        (single,) = blocks(pa.array([text]))
        assert [b.tolist() for b, _ in subwords.features(single)] == own


def test_classifier_of_odd_rows(odd, odd_rows, labels, no_labels, nothing):
    got = subwords.classified(odd, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in odd_rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in subwords.classified(odd, no_labels).collect()} == {0.5}
    assert subwords.classified(nothing, labels).collect() == []


def _tokens(text, words_of, lowered):
    return [*words_of(lowered(text)), None]


def _base(rows, words_of, lowered):
    tokens = [_tokens(t, words_of, lowered) for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    return [
        (i, h, len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        for (i, _), t, h in zip(rows, tokens, held, strict=True)
    ]


def _check(got, want):
    def order(rows):
        return sorted(rows, key=lambda r: (str(r[0]), r[2], r[5]))

    got = order([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got])
    for a, b in zip(got, order(want), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)


@pytest.mark.parametrize("limit", [maxent.FREQUENT, 300, 0])
def test_base_scores_equal_counting(docs, texts, words_of, lowered, limit):
    """With all, some and none of the words broadcast."""
    got = maxent.scored(docs, limit=limit, rounds=1).collect()
    _check(got, _base(list(texts.items()), words_of, lowered))


def test_model_beats_the_unigrams_on_held_out_texts(more):
    rows = [r for r in maxent.scored(more[0]).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > 0.95 * sum(r["base_score"] for r in rows)


def test_model_is_a_distribution(docs):
    """Over all members, and over all words of a member."""
    counts, _ = maxent.gather(docs.select("doc_id", "text"))
    model = maxent.trained(docs.select("doc_id", "text"), counts, 1)
    (block,) = blocks(pa.array(["the of and or to be", "xx yy"]))
    t = maxent.Tokens(block, counts)
    group, _ = maxent.log_chances(model, counts, t, slice(None))
    assert np.exp(group).sum(0) == pytest.approx(1, abs=1e-5)
    chances = []
    for g in range(maxent.CLASSES):  # every class in turn as the token's
        t.group[:] = g
        t.member_rows = tuple(((r * maxent.CLASSES + g).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(50)).astype(np.int64) for r in t.rows)
        group, member = maxent.log_chances(model, counts, t, slice(None))
        chances.append(np.exp(group[g] + member).sum(0))
    assert np.sum(chances, 0) == pytest.approx(1, abs=1e-4)
    known = {}
    for w, n, e in maxent.token_counts(docs).select("word", "n", "ending").collect():
        known[np.uint64(w & ((1 << 64) - 1))] = (n, e)
    words = np.array(list(known), np.uint64)
    top = {int(counts.words[i]) for i in np.flatnonzero(counts.rank < maxent.OWN)}
    mass = np.zeros(maxent.OWN)
    for w in words.tolist():
        n, e = known[np.uint64(w)]
        if w not in top:
            mass[e] += n + maxent.SMOOTHING
    assert counts.mass == pytest.approx(mass + maxent.SMOOTHING)


def _small_counts(texts, frequent):
    """Counts of the most frequent words of texts."""
    (block,) = blocks(pa.array(texts))
    hashes, ending, _ = maxent.tokens(block)
    words, first, n = np.unique(hashes, return_index=True, return_counts=True)
    top = np.argsort(-n, kind="stable")[:frequent]
    mass = np.bincount(ending[first], n, maxent.OWN)
    return block, maxent.Counts(words[top], n[top], int(n.sum()), len(words), mass, False)


def test_rare_words_of_a_block(texts):
    """All texts at once: what a sort for each text gives."""
    block, counts = _small_counts(["", "Once once twice", None, *list(texts.values())[:40], ""], 50)
    t = maxent.Tokens(block, counts)
    words, times, at = maxent.rare_words(t, t.spots >= 0)
    assert len(at) == block.n + 1 and at[-1] == len(words) > 0
    for i in range(block.n):
        span = slice(t.at[i], t.at[i + 1])
        want, n = np.unique(t.hashes[span][t.spots[span] < 0], return_counts=True)
        assert words[at[i] : at[i + 1]].tolist() == want.tolist()
        assert times[at[i] : at[i + 1]].tolist() == n.tolist()
    assert [len(x) for x in maxent.rare_words(t, np.ones(len(t.spots), bool))[:2]] == [0, 0]


def test_chances_are_sums_of_rows(texts):
    block, counts = _small_counts(list(texts.values())[:40], 5000)
    t, rng = maxent.Tokens(block, counts), np.random.default_rng(0)
    model = maxent.Model()
    for a in model.arrays():
        a[:] = rng.normal(size=a.shape)
    assert all(0 <= r.min() and r.max() < len(a) for r, a in zip((*t.rows, *t.member_rows), model.arrays(), strict=True))
    group, member = maxent.log_chances(model, counts, t, slice(3, 900))
    for got, tables, rows, bias in ((group, model.classes, t.rows, counts.class_bias), (member, model.members, t.member_rows, counts.member_bias[t.group[3:900]])):
        x = (bias + sum(a[r[3:900]].astype(float) for a, r in zip(tables, rows, strict=True))).T
        assert got == pytest.approx(x - np.log(np.exp(x).sum(0)), abs=1e-4)


def test_language_model_of_odd_rows(odd, odd_rows, words_of, lowered, nothing):
    got = maxent.scored(odd).collect()
    _check(got, _base([(r[0], r[1]) for r in odd_rows], words_of, lowered))
    assert all(np.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert maxent.scored(nothing).collect() == []


def test_without_training_documents(spark, words_of, lowered):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    df = spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")
    got = maxent.scored(df).collect()
    assert [(r["train_tokens"], r["n_known"], r["n_tokens"]) for r in got] == [(0, 0, 3)] * 3

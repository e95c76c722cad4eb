import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import database, rows_of, rows_of_sql

from rollbook.llm import phrases


def expected(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            ws = re.findall("[^ \t]+", piece)
            totals[lang] += len(ws)
            for size in range(1, 6):
                for i in range(len(ws) - size + 1):
                    counts[lang][tuple(ws[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            inside = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items())
            if not inside:
                score, _, left, right = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["The", "of", "new", "york", "Straße", "ÉTÉ", "日本", "a b", "x-y", "stop"]
    out = []
    for i in range(150):
        text = "".join(rng.choice(words) + rng.choice([" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\r\n"]) for _ in range(60))
        out.append((rng.choice(["en", "de", None, "und"]), text))
    passage = "a passage of eight words that is copied"
    out += [("en", passage)] * 40 + [("de", "hot pair " + f"tail{i} end{i % 3}") for i in range(60)]
    return [*out, ("en", None), ("fr", ""), ("fr", " .,; "), (None, "lone"), ("en", "w " * 9000), ("es", "x" * 70_000)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(n, t, x, "clash", "clash") for n, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, words string, n string").repartition(3)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("least", "top"), [(4, 50), (12, 2000)])
def test_brute_force(table, rows, least, top):
    assert found(phrases.mined(table, least, top)) == expected(rows, least, top)


def test_long_ids(table, rows):
    assert found(phrases.mined(table, 9, 300, max_ids=0)) == expected(rows, 9, 300)


@pytest.mark.parametrize("bins", [64, 1 << 14])
def test_common_pairs_are_routed_by_more_words(table, rows, bins, monkeypatch):
    """With so many slots that most frequent pairs are too common for one."""
    monkeypatch.setattr(phrases, "GATHERED", 500)
    counts = phrases.word_counts(table, 5, bins)
    total = counts.where("key = 0 and not bin").agg({"n": "sum"}).first()[0]
    assert counts.where(f"bin and n > {max(20, 2 * total // 4000)}").count() > 5
    assert found(phrases.collocations(phrases.phrase_counts(table, counts, 5, 4000, bins), counts, 400)) == expected(rows, 5, 400)


def test_partitions():
    rng = np.random.default_rng(2)
    ids = rng.integers(1, 5, (5, 4000)).astype(np.uint32)
    ids[3:, rng.random(4000) < 0.3] = 0
    weight = rng.integers(1, 4, 4000)
    for whole, least in ((2, 60), (3, 60), (5, 10)):
        got = {tuple(ids[:d, r].tolist()): n for d, r, n in phrases.partitions(ids, weight, whole, least)}
        want = Counter()
        for column, n in zip(ids.T.tolist(), weight.tolist(), strict=True):
            for d in range(2, 6):
                if column[d - 1]:
                    want[tuple(column[:d])] += n
        assert got == {p: n for p, n in want.items() if n >= least or len(p) < whole}


def test_suffixes_are_gathered_in_little_memory(monkeypatch):
    """Beside the arrays that are filled, dealing takes less than they do; no batch is much more than its share."""
    rng = np.random.default_rng(5)
    n, room, slots = 1_000_000, 600_000, 300
    ids = np.sort(rng.integers(0, 40, (5, n)).astype(np.uint32), 0)
    hashes = phrases.mix(sum(ids[j].astype(np.uint64) << np.uint64(8 * j) for j in range(5)))
    monkeypatch.setattr(phrases, "_SENT", 50_000)
    tracemalloc.start()
    held = phrases.Gathered(np.dtype(np.uint32), slots, room)
    sums, largest, at_first = Counter(), 0, tracemalloc.get_traced_memory()[0]
    peak = 0

    def taken(batches):
        nonlocal peak, largest
        for batch in batches:
            peak = max(peak, tracemalloc.get_traced_memory()[1])
            for slot, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table = np.frombuffer(part, np.uint32).reshape(6, -1)
                sums[slot] += int(table[5].sum())
            largest = max(largest, sum(map(len, batch.column(1).to_pylist())))
            tracemalloc.reset_peak()

    for i in range(0, n, 250_000):
        some = slice(i, i + 250_000)
        taken(held.add(list(ids[:, some]), hashes[some] % np.uint64(slots), hashes[some]))
    taken(held.dealt())
    tracemalloc.stop()
    assert at_first > room * 28 and peak < 2 * at_first
    assert largest <= 2 * 50_000 * 24
    assert sums == Counter((hashes % np.uint64(slots)).tolist())


def test_no_rows(nothing):
    assert found(phrases.mined(nothing)) == []


def test_odd_rows(odd, odd_rows):
    assert found(phrases.mined(odd, 2, 100)) == expected([(r[2], r[1]) for r in odd_rows], 2, 100)


def test_sql(docs):
    assert rows_of(phrases.mined(docs)) == rows_of_sql(database("/root/testdata/sf0.001"), phrases.oracle_sql())

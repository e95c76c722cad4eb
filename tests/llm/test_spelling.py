import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import database, rows_of, rows_of_sql

from rollbook.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def words_of(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(words):
    forms, out = {}, []
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None
        out.append([w, forms[w], None, n, len(others), words[forms[w]] if forms[w] else None])
    for row in out:
        root = row[0]
        while forms[root]:
            root = forms[root]
        row[2] = root
    return sorted(tuple(r) for r in out)


def got(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    stems = ["anchor", "ÉCOLIER", "straße", "thanks", "thankss", "aaaaaaa", "bandage", "x" * 300]
    out = []
    for i in range(300):
        words = []
        for _ in range(30):
            w = rng.choice(stems)
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aesé") + w[at:], w[:at] + rng.choice("aé") + w[at + 1 :]])
            words.append(w)
        out.append((i if i % 9 else None, " ".join(words)))
    return [*out, (7, None), (8, ""), (8, "w" * 70_000), *[(9, "repeated sentence")] * 6, (1, "×÷×÷×÷ " * 7), (2, "日本語日本語日本語 " * 9)]


@pytest.mark.parametrize("tile", [256, 3])
def test_brute_force(spark, rows, tile):
    docs = spark.createDataFrame([(i, t, "clash", 2) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    words = spelling.counted(docs)
    assert {r["word"]: r["n"] for r in words.collect()} == words_of(rows)
    assert got(spelling.variants(words, tile)) == expected(words_of(rows))


def test_chains_and_ties(spark):
    words = {"abcdef": 5, "abcdeg": 25, "abcdegh": 125, "abcdeghi": 624, "abcdew": 25, "éèàùêî": 5, "éèàùêïx": 6, "zzzzzz": 5, "zzzzzy": 24}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    found = got(spelling.variants(table))
    assert found == expected(words)
    assert dict((r[0], r[2]) for r in found)["abcdef"] == "abcdegh"


def test_long_words(spark):
    long = "ab" * 20_000
    words = {long: 50, long + "c": 9, "x" + long: 9, long[:-1]: 9, long[1:]: 9, long[:9] + "z" + long[10:]: 9}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(spelling.variants(table)) == expected(words)


def test_checksums():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 400)
    ends = starts + rng.integers(0, 130, 400)
    heads = np.array([zlib.crc32(str(i).encode()) for i in range(400)], np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(h)) for a, b, h in zip(starts, ends, heads, strict=True)]
    assert spelling.checksums(data, starts, ends, heads).tolist() == want


def test_units_of_large_blocks_are_small(spark):
    table = spark.createDataFrame([(f"common{chr(97 + i % 26)}{chr(97 + i // 26)}", 5) for i in range(600)], "word string, n long")
    sizes = spelling.units(table, 50).groupBy(*spelling._UNIT).count().agg({"count": "max"}).first()[0]
    assert sizes < 200
    assert got(spelling.variants(table, 50)) == expected({r["word"]: r["n"] for r in table.collect()})


def test_odd_rows_and_none(odd, odd_rows, nothing):
    assert got(spelling.spellings(odd)) == expected(words_of([r[:2] for r in odd_rows]))
    assert got(spelling.spellings(nothing)) == []


def test_sql(docs):
    assert rows_of(spelling.spellings(docs)) == rows_of_sql(database("/root/testdata/sf0.001"), spelling.oracle_sql())

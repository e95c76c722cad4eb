import random

import pytest
from pyspark.sql import functions as F
from test_bpe import PATH

from rollbook.llm import bpe, edits


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(bpe.read_vocabulary(PATH)), None)


def test_counts_after_edits_are_those_of_the_whole_text(texts, encoder):
    rng = random.Random(5)
    pieces = ["", "re", "'", "r", "e", " ", "  ", "\n", "x", "<|endoftext|>", "<|endof", "text|>", "12", " the", "é", "日本", " a b c d" * 60]
    for text in [*list(texts.values())[:60], *["", "a", "<|endoftext|>", "it's 'rx 're", "   x  "] * 10]:
        counter = edits.Counter(text, encoder)
        for _ in range(10):
            start = rng.randrange(len(counter.text) + 2)
            counter.edit(start, start + rng.choice([0, 0, 1, 2, 3, 5, 40, 400]), rng.choice(pieces))
            lengths, counts = counter._counted(counter._words(counter.text))
            assert counter.tree.leaves() == (lengths, counts)
            assert (counter.tree.n_chars, counter.tree.n_tokens) == (len(counter.text), sum(counts))


def test_only_the_touched_region_is_encoded_again(encoder):
    counter = edits.Counter("word " * 20_000, encoder)
    counter.edit(50_003, 50_004, "x")
    assert 0 < counter.reencoded < 20


def test_documents(docs, texts, encoder):
    changed = docs.withColumn("edits", edits.example_edits(docs["text"], F.lit(" it's")))
    for r in edits.recounted(changed, PATH).collect():
        text = texts[r["doc_id"]]
        n = len(text)
        new = text[: n // 4] + text[:9] + text[n // 4 + 5 :]
        new = new[: n // 2] + " it's" + new[n // 2 :]
        new = new[: 3 * n // 4] + new[3 * n // 4 + 20 :]
        before, after = (len(encoder.whole(x)) for x in (text, new))
        assert (r["n_tokens"], r["edited_tokens"], r["edited_sha256"]) == (before, after, edits.hashlib.sha256(new.encode()).hexdigest())


def test_edits_of_a_table(spark, odd, encoder):
    rows = [(1, 2, 0, 0, "b"), (1, 1, 0, 5, None), (4, 1, -3, 99, "new"), (99, 1, 0, 0, "x"), (None, 1, 0, 0, "y"), (10, 1, 5, 2, " ")]
    changes = spark.createDataFrame(rows, "doc_id long, position int, start int, stop int, replacement string")
    got = {}
    for r in edits.recounted(edits.gathered(odd, changes), PATH).collect():
        got.setdefault(r["doc_id"], set()).add((r["n_tokens"], r["edited_tokens"], r["n_reencoded"] > 0))
    assert got[4] == {(0, 1, True)}
    assert got[3] == got[4].__class__({(0, 0, False)})
    assert len(got[1]) == 1 and next(iter(got[1]))[2]
    assert not next(iter(got[2]))[2]
    assert len(got[None]) == 2


def test_empty_table(nothing):
    assert edits.recounted(nothing.withColumn("edits", edits.example_edits(nothing["text"], F.lit(""))), PATH).collect() == []


def test_leaves_are_those_of_the_whole_text(texts, encoder):
    odd = ["x" * 70 + " b", "é" * 61 + " a " + "日" * 59, "", " ", "a  b", " a", "a ", "a \n b", "a<|endoftext|> b c", "日本 語 x", "it's 'rx 're", "\ta b"]
    every = [*list(texts.values())[:80], *odd]
    for text, own in zip(every, edits.Leaves(encoder).of(every), strict=True):
        counter = edits.Counter("", encoder)
        assert tuple(x.tolist() for x in own) == counter._counted(counter._words(text))

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rollbook.llm import bpe
from rollbook.llm.blocks import blocks
from rollbook.llm.lexicon import Lexicon, compile_lexicon

PATH = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_vocabulary(PATH))


def _digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_ids_equal_the_library(docs, texts, library):
    got = {r[0]: tuple(r)[1:] for r in bpe.digests(docs, PATH).collect()}
    assert got == {i: _digests(library, t) for i, t in texts.items()}


def test_odd_rows(odd, odd_rows, library):
    got = Counter(tuple(r) for r in bpe.digests(odd, PATH).collect())
    assert got == Counter((r[0], *_digests(library, r[1])) for r in odd_rows)


def test_round_trip_of_ids(odd, odd_rows):
    back = bpe.decode(bpe.encode(odd, PATH), PATH)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((r[0], r[1] or "") for r in odd_rows)


def test_empty_table(nothing):
    assert bpe.digests(nothing, PATH).collect() == []


def test_words_missing_from_the_lexicon_are_merged(docs, texts, library):
    few = bpe.named(bpe.encoded(docs, PATH, ["doc_id"], with_ids=False, limit=5), ["doc_id"], ["n_tokens", "ids_sha256", "decoded_sha256"])
    assert {r[0]: tuple(r)[1:] for r in few.collect()} == {i: _digests(library, t) for i, t in texts.items()}


def test_random_texts(vocabulary, library):
    rng = random.Random(1)
    pools = ["abcdefgh '", "  \n\t   x", "0123 ½²٣", "’'sS'll've ", "日本語テキスト。", "éßñÀ ", "<|endoftext|>", "!!..?? ##", "🎉👩‍👩 "]
    texts = []
    for _ in range(800):
        parts = ["".join(rng.choice(p) for _ in range(rng.randrange(1, 12))) for p in rng.choices(pools, k=rng.randrange(1, 6))]
        texts.append("".join(parts) + rng.choice(["", "<|endoftext|>", " "]))
    texts += ["", "a" * 3000, "ab" * 700 + " " + "é" * 900, "".join(map(chr, range(1, 0xD800, 37)))]
    texts += [a + b + c for a in ("a", "", " ", "\n") for b in (" ", "  ", " \n", "\u00a0 ", " \u3000", "\x85 ", "\x1f ") for c in ("b", "", "\t", " c")]
    encoder = bpe.Encoder(vocabulary, None)
    got = [ids for _ in range(2) for block in blocks(pa.array(texts), 5000) for ids in encoder.block(block)]
    want = library.encode_batch(texts, add_special_tokens=False)
    for text, ids, b in zip(texts * 2, got, want * 2, strict=True):
        assert ids.tolist() == b.ids, text
        assert vocabulary.decoded(ids).decode() == text


def _rare_texts(pools, seed):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 14))) for _ in range(60)) for _ in range(120)]


PLAIN = ["abcdefghijklmnopqrstuvwxyz", "ABCDE", "0123456789", ".,;:!?#&()-_", "éèñçßÀÿĀȿЀѿдж"]


@pytest.mark.parametrize("limit", [0, 400])
def test_rare_pieces_of_plain_runs_are_cut_together(vocabulary, library, monkeypatch, limit):
    """No call for each piece: that was most of the time of a table with many rare words."""
    texts = _rare_texts(PLAIN, 5) + ["a\nb c.\n\n\nD\t1 e", "\n\nx y\r\nz"]
    words = sorted({" " + w for t in texts for w in t.split(" ")[1:]} | {" ", "ab"})[:limit]
    ids = bpe.Encoder(vocabulary, None).spelled(words)
    lexicon = Lexicon(np.frombuffer(compile_lexicon((w.encode(), np.frombuffer(i, "<u4").tolist()) for w, i in zip(words, ids, strict=True)), np.uint8))

    def one_by_one(self, text):
        raise AssertionError(text)

    monkeypatch.setattr(bpe.Vocabulary, "words", one_by_one)
    encoder = bpe.Encoder(vocabulary, lexicon)
    got = [ids.tolist() for _ in range(2) for block in blocks(pa.array(texts), 9000) for ids in encoder.block(block)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)] * 2


def test_other_rare_pieces(vocabulary, library):
    texts = _rare_texts([*PLAIN, "'’", "×÷", "\n\t\x0b\x0c\r", "\x1c\x1f\x7f\x00", "日本٣½\u0301\u0482ǅʰΑ", "🎉"], 6)
    encoder = bpe.Encoder(vocabulary, None)
    got = [ids.tolist() for block in blocks(pa.array(texts), 9000) for ids in encoder.block(block)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_two_byte_letters_are_letters(vocabulary, library):
    letters = [chr(c) for c in [*range(0xC0, 0x240), *range(0x400, 0x480)]]
    texts = [f"a {'a1' + c + '2b' + c + '.' + c}" for c in letters]
    encoder = bpe.Encoder(vocabulary, None)
    got = [ids.tolist() for block in blocks(pa.array(texts)) for ids in encoder.block(block)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert all(bpe.WORDS.findall("a" + c) == ["a" + c] for c in letters if c not in "×÷")


def test_word_counts_hold_every_piece(spark, monkeypatch):
    texts = [*_rare_texts([*PLAIN, "日本", "'"], 7) * 3, ""]
    monkeypatch.setattr(bpe, "COUNTED", 2000)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, " two  spaces "])], "doc_id long, text string").repartition(3)
    got = {w: n for w, n in bpe.word_counts(df, bpe.read_vocabulary(PATH)).collect()}
    want = Counter([" two", " ", " spaces", " "])  # not cut at spaces
    for t in filter(None, texts):
        head, *rest = t.split(" ")
        want.update([head, *(" " + w for w in rest)])
    assert got == want


def test_piece_table_grows():
    rng = np.random.default_rng(0)
    table = bpe.PieceTable()
    hashes = np.unique(rng.integers(1, 1 << 63, 300_000).astype(np.uint64) << np.uint64(1))
    for part in np.array_split(rng.permutation(hashes), 7):
        table.add(part, [np.array([h % 1000, 7][: 1 + h % 2], "<u4").tobytes() for h in part.tolist()])
    slots = table.find(hashes)
    ids, at = table.gather(slots)
    assert (ids[at[:-1]] == hashes % 1000).all()
    assert (np.diff(at) == 1 + hashes % 2).all()
    assert (table.find(hashes + np.uint64(1)) == -1).all()


def test_lexicon_holds_exactly_its_words():
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"abc\xff\x00") for _ in range(rng.randrange(1, 7))) for _ in range(500)})
    kept, others = words[::2], words[1::2]
    lexicon = Lexicon(np.frombuffer(compile_lexicon((w, [i, i + 7]) for i, w in enumerate(kept)), np.uint8))
    assert lexicon.numbers(kept).tolist() == list(range(len(kept)))
    assert lexicon.numbers([*others, b""]).tolist() == [-1] * (len(others) + 1)
    assert [np.frombuffer(x, "<u4").tolist() for x in lexicon.outputs(kept)] == [[i, i + 7] for i in range(len(kept))]


def test_lexicon_is_minimal():
    """As many states as there are different sets of endings."""
    words = [a + b for a in (b"", b"un", b"re") for b in (b"do", b"doing", b"go", b"going", b"see")]
    endings = {}
    for w in words:
        for i in range(len(w) + 1):
            endings.setdefault(w[:i], set()).add(w[i:])
    states = len({frozenset(x) for x in endings.values()})
    assert len(Lexicon(np.frombuffer(compile_lexicon((w, [1]) for w in words), np.uint8)).final) == states


def test_empty_lexicon():
    lexicon = Lexicon(np.frombuffer(compile_lexicon([]), np.uint8))
    assert lexicon.outputs([b"a", b""]) == [None, None]

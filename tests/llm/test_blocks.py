import numpy as np
import pyarrow as pa

from rollbook.llm.blocks import Hasher, blocks, shingles

TEXTS = ["ab  cd", None, "", " x ", "é\nz", "a", "one two three four", "cd"]


def _blocks(size=1 << 19):
    return list(blocks(pa.array(TEXTS), size))


def test_words_stay_in_their_text():
    for size in (1, 8, 1 << 19):
        found = []
        for block in _blocks(size):
            starts, ends, before = block.words()
            for i in range(block.n):
                found.append([block.data[a:b].tobytes().decode() for a, b in zip(starts[before[i] : before[i + 1]], ends[before[i] : before[i + 1]], strict=True)])
        assert found == [(t or "").split() for t in TEXTS]


def test_equal_words_have_equal_hashes_wherever_they_are():
    (block,) = _blocks()
    starts, ends, _ = block.words()
    hashes = Hasher(block.data)(starts, ends)
    words = [block.data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))


def test_shingles_of_short_texts_are_the_whole_sequence():
    hashes = np.arange(1, 8, dtype=np.uint64)
    out, before = shingles(hashes, np.array([0, 2, 2, 7]), 3)
    assert before.tolist() == [0, 1, 1, 4]
    again, _ = shingles(hashes[2:], np.array([0, 5]), 3)
    assert out[1:].tolist() == again.tolist()


def test_characters_are_code_points():
    (block,) = _blocks()
    assert block.n_chars().tolist() == [len(t or "") for t in TEXTS]


def test_sliced_columns():
    (block,) = list(blocks(pa.array(TEXTS).slice(4, 2)))
    assert [block.text(i).decode() for i in range(block.n)] == ["é\nz", "a"]

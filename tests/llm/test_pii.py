import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rollbook.llm import crf, pii
from rollbook.llm.blocks import blocks

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(sum(map(int, str(d))) for d in doubled) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and plain_luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


TRICKY = [
    "a@b.c", "@b.c", "a@b", "a@@b.c", "a@b.c@d.e", "x a.b@c.d.e, f@g.h", "é.a@b.co", "a@b..c", "a@-.-", "..@a.b", "a@b.c.@d.e.f",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4", "1.2.3", "01.02.03.04.", "999999999999.1.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111x", "4111  1111 1111 1111", "41111111111111111111111", "5927243074273351", "1 2",
    "+1 (017) 555-7713", "+12", "+1 2 3", "+1234567890123456", "++1 234 567 890 1", "+1-234-567-8901-", "tel+49.30.1234567 x", "+1(((((((((2",
    "1" * 3000, "+1" * 500, "a@" * 400, "a." * 400 + "@b.c", "%" * 500, "1 " * 900, "1." * 700,
]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_random_texts():
    rng = np.random.default_rng(0)
    for _ in range(3000):
        text = "".join(rng.choice(list("a.@-+1234 05%\né("), rng.integers(1, 40)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_documents(docs, texts):
    for r in pii.find(docs).collect():
        want = plain_spans(texts[r["doc_id"]])
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == pii.hashlib.sha256(joined.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def _plain_viterbi(e, moves):
    best, back = e[0], []
    for row in e[1:]:
        through = best[:, None] + moves
        back.append(through.argmax(0))
        best = through.max(0) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_labels_are_the_best_of_whole_lines(texts):
    model = crf.train()
    kinds = pii.Kinds(model)
    extra = [crf.LABELLED[i].replace("{phone:", "").replace("{secret:", "").replace("}", "") for i in range(len(crf.LABELLED))]
    every = [*list(texts.values())[:60], *extra, "call (212) 555-0100 or (301) 555-0123\n(415) 555-2671"]
    for block in blocks(pa.array(every)):
        added = pii.added_spans(block, kinds)
        for i in range(block.n):
            marked = set()
            for a, kind, b in added.get(i, []):
                marked.update((p, kind) for p in range(a - int(block.at[i]), b - int(block.at[i])))
            raw, at = block.text(i), 0
            for line in raw.split(b"\n"):
                found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", line)]
                if found:
                    e = crf._emissions(model, [line[a:b].decode() for a, b in found])
                    for (a, b), y in zip(found, _plain_viterbi(e, model.moves), strict=True):
                        inner = [p for p in range(a, b) if not pii._STRIP[line[p]]]
                        want = pii.KINDS.index(crf.LABELS[y]) if y else None
                        assert all(((at + p, want) in marked) if want is not None else not any((at + p, k) in marked for k in range(5)) for p in inner[:1] + inner[-1:])
                at += len(line) + 1


def test_training_rows_are_learned():
    model = crf.train()
    for row in crf.LABELLED:
        words = crf.parse(row)
        assert _plain_viterbi(crf._emissions(model, [w for w, _ in words]), model.moves) == [y for _, y in words]


def test_held_out_lines():
    kinds = pii.Kinds(crf.train())

    def found(text):
        (block,) = blocks(pa.array([text]))
        return [(pii.KINDS[k], block.data[a:b].tobytes().decode()) for a, k, b in pii.added_spans(block, kinds).get(0, [])]

    assert found("ring (617) 555-0188, today") == [("phone", "(617) 555-0188")]
    assert found('x token = "0f1e2d3c4b5a69788796a5b4c3d2e1f00f1e2d3c" y') == [("secret", "0f1e2d3c4b5a69788796a5b4c3d2e1f00f1e2d3c")]
    for clean in ("The Apache License, Version 2.0.", "in 1999 (or 2001) 12 of 555 went", "of 5927243074273351 the", "Über (und) so: 3.14"):
        assert found(clean) == []


def test_odd_rows(odd, odd_rows):
    got = Counter((r["doc_id"], r["n_email"] + r["n_ip"] + r["n_phone"]) for r in pii.find(odd).collect())
    assert got == Counter((r[0], 3 if r[0] == 10 else 0) for r in odd_rows)


def test_redaction(odd, odd_rows):
    out = pii.redacted(odd)
    assert out.schema == odd.schema
    got = Counter((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect())
    want = Counter()
    for r in odd_rows:
        text = r[1].replace("+1 (212) 555-0100", "[phone]").replace("a@b.co", "[email]").replace("1.2.3.4", "[ip]") if r[0] == 10 else r[1]
        want[r[0], text, len(text) if r[0] == 10 else r[4]] += 1
    assert got == want


def test_empty_table(nothing):
    assert pii.find(nothing).collect() == []
    assert pii.redacted(nothing).collect() == []


def test_a_word_has_its_own_scores_whatever_came_before():
    model = crf.train()
    words = ["hello!!", "phone!!", "hello", "phone", "?!phone;:", "(phone)", "::", ":", "=:", "==", "!!!", "!", "to\u212aen", "token", "wöken", "...KEY...", "...THE...", "phone!x", "hello!x"]
    for order in (words, words[::-1], sorted(words)):
        (block,) = blocks(pa.array([" ".join(order)]))
        kinds = pii.Kinds(model)
        starts, ends, _ = block.words()
        for word, row in zip(order, kinds.rows(block, starts, ends), strict=True):
            assert (kinds.scores[row] == model.rows(word)).all(), word

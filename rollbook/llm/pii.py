"""Personal data: fixed patterns, and spans that a conditional random field adds.

Base spans (email, ip, card, phone) are found by patterns on every whole text.
The field (``crf``) labels every word of every line with nothing or one of
phone (national forms) and secret; runs of one label are spans, trimmed of
punctuation. A found span that touches a base span is dropped. Lines are decoded by
Viterbi in numpy batches. A word that scores so clearly as no personal data that no
neighbours' labels can outweigh it is no personal data in the best labelling, so
chains are decoded between such words: the labels are those of whole lines.

Null and empty texts have no spans. Repeated rows are handled one by one. Other
columns are ignored by ``find`` and kept by ``redacted``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm import crf
from rollbook.llm.blocks import IS_FIRST, IS_SPACE, LOWER, Block, Hasher
from rollbook.llm.carry import named, per_block

KINDS = ("email", "ip", "card", "phone", "secret")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
# The look-behind only spares starts within a run of digits, which fail as its start does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

IS_DIGIT = np.zeros(256, bool)
IS_DIGIT[48:58] = True

#: Symbol of each byte in a shape.
_SYMBOL = np.arange(256, dtype=np.uint8)
_SYMBOL[48:58] = ord("9")
_SYMBOL[65:91] = ord("A")
_SYMBOL[97:123] = ord("a")
_SYMBOL[128:] = ord("a")

_STRIP = np.zeros(256, bool)
_STRIP[list(b".,;:!?*#%$&\"'|<>[]{}=")] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` by code points, in order of start and kind."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, 0, domain.end()))
            last = domain.end()
        else:
            last = max(last, start)
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


class Kinds:
    """Score rows for each kind of word met so far, by the hash of its shape, length class and cue."""

    LIMIT = 1 << 16

    def __init__(self, model: crf.Model):
        self.model = model
        self.row: dict[int, int] = {}
        self.scores: list[np.ndarray] = []
        cue_bytes = [c.encode() for c in crf.CUES]
        data = np.frombuffer(b"".join(cue_bytes), np.uint8)
        ends = np.cumsum([len(c) for c in cue_bytes])
        self.cue_hash = np.sort(Hasher(data)(np.concatenate([[0], ends[:-1]]), ends))

    def rows(self, block: Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of each word."""
        symbol = _SYMBOL[block.data]
        run = np.ones(len(symbol), bool)
        run[1:] = symbol[1:] != symbol[:-1]
        run[starts] = True
        place = np.arange(len(symbol))
        place -= np.maximum.accumulate(np.where(run, place, 0))
        kept = (place == 0) | ((symbol == ord("9")) & (place < 5))
        before = np.concatenate([[0], np.cumsum(kept)])
        key = Hasher(symbol[kept])(before[starts], before[ends])
        key += np.searchsorted((1, 2, 4, 8, 15, 31), ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        low = LOWER[block.data]
        # A cue may have marks of punctuation before and after it, all of which the features leave out.
        mark, at = _MARKS[block.data], np.arange(len(low))
        a = np.minimum.accumulate(np.where(mark, len(low), at)[::-1])[::-1][starts]
        b = np.maximum.accumulate(np.where(mark, -1, at))[ends - 1] + 1
        a, b = np.where(a < ends, a, starts), np.where(a < ends, b, ends)
        word = Hasher(low)(a, b)
        spot = np.minimum(np.searchsorted(self.cue_hash, word), len(self.cue_hash) - 1)
        key += np.where(self.cue_hash[spot] == word, word | np.uint64(1), np.uint64(0))
        kinds, first, of = np.unique(key, return_index=True, return_inverse=True)
        if len(self.row) > self.LIMIT:
            self.row.clear()
            self.scores.clear()
        rows = np.empty(len(kinds), np.int64)
        for i, (k, f) in enumerate(zip(kinds.tolist(), first.tolist(), strict=True)):
            if k not in self.row:
                text = block.data[starts[f] : ends[f]].tobytes().decode("utf-8", "replace")
                self.row[k] = len(self.scores)
                self.scores.append(self.model.rows(text))
            rows[i] = self.row[k]
        return rows[of]


_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:!?")] = True


def added_spans(block: Block, kinds: Kinds) -> dict[int, list[tuple[int, int, int]]]:
    """For each text with any, the spans ``(start, kind, end)`` of the field, by bytes of the block."""
    starts, ends, before = block.words()
    if not len(starts):
        return {}
    model = kinds.model
    rows = kinds.rows(block, starts, ends)
    table = np.stack(kinds.scores)
    lines = np.cumsum(block.data == 0x0A)[starts]
    lines += np.repeat(np.arange(block.n) * (len(block.data) + 1), np.diff(before))
    same = lines[1:] == lines[:-1]
    e = table[rows, 1] + model.bias
    e[1:][same] += table[rows[:-1][same], 0]
    e[:-1][same] += table[rows[1:][same], 2]
    sure = e[:, 0] - e[:, 1:].max(1) > model.pull
    # A sure word at either end of a chain stays in it, so that its moves count.
    use = ~sure
    wide = use.copy()
    wide[1:] |= use[:-1] & same
    wide[:-1] |= use[1:] & same
    index = np.flatnonzero(wide)
    if not len(index):
        return {}
    new = np.ones(len(index), bool)
    new[1:] = (np.diff(index) > 1) | ~same[index[1:] - 1]
    # Two sure words side by side belong to two chains.
    new[1:] |= sure[index[1:]] & sure[index[:-1]]
    chain = np.flatnonzero(new)
    labels = crf.viterbi(e[index], chain, np.diff(np.append(chain, len(index))), model.moves)
    out: dict[int, list[tuple[int, int, int]]] = {}
    hit = np.flatnonzero(labels)
    if not len(hit):
        return out
    cut = np.flatnonzero((np.diff(hit) > 1) | (labels[hit[1:]] != labels[hit[:-1]]) | new[hit[1:]]) + 1
    for run in np.split(hit, cut):
        a, b = int(starts[index[run[0]]]), int(ends[index[run[-1]]])
        while a < b and _STRIP[block.data[a]]:
            a += 1
        while a < b and _STRIP[block.data[b - 1]]:
            b -= 1
        if a < b:
            text = int(np.searchsorted(block.at, a, "right")) - 1
            out.setdefault(text, []).append((a, KINDS.index(crf.LABELS[labels[run[0]]]), b))
    return out


def block_spans(block: Block, kinds: Kinds) -> Iterator[tuple[list, list]]:
    """The base spans and all spans of each text, by code points."""
    added = added_spans(block, kinds)
    wanted = block.per_text(IS_DIGIT[block.data] | (block.data == ord("@"))) > 0
    for i in range(block.n):
        if not wanted[i] and i not in added:
            yield [], []
            continue
        raw = block.text(i)
        base = base_spans(raw.decode("utf-8", "replace")) if wanted[i] else []
        spans = list(base)
        if i in added:
            places = np.concatenate([[0], np.cumsum(IS_FIRST[np.frombuffer(raw, np.uint8)])])
            for a, kind, b in added[i]:
                a, b = int(places[a - block.at[i]]), int(places[b - block.at[i]])
                if not any(s < b and a < e for s, _, e in base):
                    spans.append((a, kind, b))
            spans.sort()
        yield base, spans


def _per_task(model: crf.Model) -> Callable[[], Kinds]:
    """One table of kinds for each task, made when it is first asked for."""
    held: list[Kinds] = []

    def kinds() -> Kinds:
        if not held:
            held.append(Kinds(model))
        return held[0]

    return kinds


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, base counts, ``base_sha256`` of the base spans and all ``spans`` as text."""
    kinds = _per_task(crf.train())

    def run(block: Block) -> dict:
        counts = np.zeros((4, block.n), np.int64)
        digests, spans = [], []
        for i, (base, every) in enumerate(block_spans(block, kinds())):
            for _, kind, _ in base:
                counts[kind, i] += 1
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            spans.append(_joined(every))
        return {"n_email": counts[0], "n_ip": counts[1], "n_card": counts[2], "n_phone": counts[3], "base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string())}

    fields = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    out = per_block(docs, "text", ["doc_id"], "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", run)
    return named(out, ["doc_id"], fields)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span replaced by its kind; of overlapping spans the union, by the first kind."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind]}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text``, and ``n_chars`` set anew if there is such a column."""
    kinds = _per_task(crf.train())

    def run(block: Block) -> dict:
        texts, changed = [], []
        for i, (_, spans) in enumerate(block_spans(block, kinds())):
            texts.append(redact(block.text(i).decode("utf-8", "replace"), spans) if spans else None)
            changed.append(bool(spans))
        return {"new": pa.array(texts, pa.string()), "changed": pa.array(changed, pa.bool_())}

    out = per_block(docs, "text", docs.columns, "new string, changed boolean", run)
    place = {c: F.col(f"__{i}") for i, c in enumerate(docs.columns)}
    place["text"] = F.when(F.col("changed"), F.col("new")).otherwise(place["text"])
    if "n_chars" in place:
        place["n_chars"] = F.when(F.col("changed"), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(place["n_chars"])
    return out.select(*(v.alias(c) for c, v in place.items()))

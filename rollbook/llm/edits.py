"""Token counts that follow edits.

A document's pre-tokens are the leaves of a segment tree whose nodes sum code
points and tokens. An edit finds the leaves it touches by a descent from the root, pre-tokenizes
the changed region again from a little before it until a boundary falls on one
that was there already, encodes only the new pre-tokens and updates the sums on
the way up. Leaves are kept in runs of about ``RUN``, so that an edit moves few of them; a
run that has grown to four times that is split by building the tree anew.

Counts are those of ``bpe`` for the same vocabulary. Null texts are empty.
Edits of a document are applied in their order, each to the text that the one
before has left; places beyond the text's end mean its end, a stop before its
start means the start, a null replacement is empty. Repeated rows are counted
one by one; documents without edits keep their counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.blocks import blocks
from rollbook.llm.bpe import WORDS, Encoder, Vocabulary, read_vocabulary, split_regular

RUN = 64
#: Pieces between spaces whose numbers a Python worker remembers.
PIECES = 300_000
#: Code points of a piece whose numbers fit into bytes.
SHORT = 60
#: Characters past its end that a pre-token's match may look at.
LOOK = 3


class SegmentTree:
    """Sums of code points and tokens over runs of pre-tokens."""

    def __init__(self, lengths: Sequence[int], counts: Sequence[int]):
        self._build(lengths, counts)

    def _build(self, lengths: Sequence[int], counts: Sequence[int]) -> None:
        """Runs as arrays; a run is made a list when an edit touches it."""
        lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
        starts = range(0, max(len(lengths), 1), RUN)
        self.runs = [(lengths[i : i + RUN], counts[i : i + RUN]) for i in starts]
        self.size = 1 << (len(self.runs) - 1).bit_length()
        level = np.zeros((self.size, 2), np.int64)
        if len(lengths):
            level[: len(self.runs)] = np.stack([np.add.reduceat(x, np.array(starts)) for x in (lengths, counts)], axis=1)
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append(levels[-1][::2] + levels[-1][1::2])
        self.sums = [(0, 0), *(tuple(x) for part in reversed(levels) for x in part.tolist())]

    def _add_up(self, i: int) -> None:
        (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = (a + c, b + d)

    @property
    def n_chars(self) -> int:
        return self.sums[1][0]

    @property
    def n_tokens(self) -> int:
        return self.sums[1][1]

    def leaves(self) -> tuple[list[int], list[int]]:
        return [int(x) for a, _ in self.runs for x in a], [int(x) for _, b in self.runs for x in b]

    def find(self, place: int) -> tuple[int, int, int]:
        """The run and the leaf in it that hold code point ``place`` (the last leaf's end if there is none), and where the leaf starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if start + self.sums[node][0] <= place and self.sums[node + 1][0]:
                start += self.sums[node][0]
                node += 1
        run = node - self.size
        lengths = self._run(run)[0]
        for leaf, n in enumerate(lengths):
            if start + n > place:
                return run, leaf, start
            start += n
        return run, len(lengths), start

    def _run(self, run: int) -> tuple[list[int], list[int]]:
        a, b = self.runs[run]
        if not isinstance(a, list):
            a, b = self.runs[run] = (a.tolist(), b.tolist())
        return a, b

    def after(self, run: int, leaf: int) -> Iterator[tuple[int, int, int]]:
        """Runs, leaves and lengths from a leaf on."""
        while run < len(self.runs):
            lengths = self._run(run)[0]
            while leaf < len(lengths):
                yield run, leaf, lengths[leaf]
                leaf += 1
            run, leaf = run + 1, 0

    def splice(self, first: tuple[int, int], last: tuple[int, int], lengths: list[int], counts: list[int]) -> None:
        """Put leaves in place of those from ``first`` up to but without ``last``."""
        (run, leaf), (end_run, end_leaf) = first, last
        a, b = self._run(run)
        if run == end_run:
            self.runs[run] = (a[:leaf] + lengths + a[end_leaf:], b[:leaf] + counts + b[end_leaf:])
        else:
            self.runs[run] = (a[:leaf] + lengths, b[:leaf] + counts)
            for i in range(run + 1, end_run):
                self.runs[i] = ([], [])
            if end_run < len(self.runs):
                c, d = self._run(end_run)
                self.runs[end_run] = (c[end_leaf:], d[end_leaf:])
        if len(self._run(run)[0]) > 4 * RUN:
            self._build(*self.leaves())
            return
        changed = range(run, min(end_run, len(self.runs) - 1) + 1)
        for i in changed:
            a, b = self.runs[i]
            self.sums[self.size + i] = (sum(a), sum(b))
        nodes = {(self.size + i) // 2 for i in changed}
        while nodes and max(nodes):
            for i in nodes:
                self._add_up(i)
            nodes = {i // 2 for i in nodes if i > 1}


class Leaves:
    """Code points and tokens of the pre-tokens of texts, with the pieces between spaces met lately remembered.

    A piece's numbers are kept as bytes, two for each pre-token, so long pieces go the way of whole pre-tokens.
    """

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.pieces: dict[str, bytes] = {}

    def of(self, texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Two arrays for each text."""
        vocabulary = self.encoder.vocabulary
        words: set[str] = set()
        met: set[str] = set()
        cut = []
        for text in texts:
            parts = []
            for part, special in vocabulary.pieces(text):
                head, rest = ([], []) if special else split_regular(part) or (vocabulary.words(part), [])
                if rest and max(map(len, rest)) > SHORT:
                    head, rest = vocabulary.words(part), []
                words.update(head)
                met.update(rest)
                parts.append((len(part) if special else 0, head, rest))
            cut.append(parts)
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        new = met.difference(self.pieces)
        spelled = {p: WORDS.findall(" " + p) for p in new}
        words.update(chain.from_iterable(spelled.values()))
        self.encoder.learn(words)
        known, pieces = self.encoder.known, self.pieces
        for p, own in spelled.items():
            pieces[p] = bytes([x for w in own for x in (len(w), len(known[w]) >> 2)])
        out = []
        for parts in cut:
            arrays = [np.zeros(0, np.int64)]
            for special, head, rest in parts:
                first = [special, 1] if special else [x for w in head for x in (len(w), len(known[w]) >> 2)]
                arrays.append(np.array(first, np.int64))
                if rest:
                    arrays.append(np.frombuffer(b"".join([pieces[p] for p in rest]), np.uint8))
            pairs = np.concatenate(arrays).reshape(-1, 2)
            out.append((pairs[:, 0], pairs[:, 1]))
        return out


class Counter:
    """A document's text and tree."""

    def __init__(self, text: str, encoder: Encoder, tree: SegmentTree | None = None):
        self.text, self.encoder, self.reencoded = text, encoder, 0
        self.reach = max([LOOK, *(len(s) for s in encoder.vocabulary.added)])
        self.tree = tree or SegmentTree(*self._counted(self._words(text)))

    def _words(self, text: str) -> list[tuple[str, bool]]:
        out = []
        for piece, special in self.encoder.vocabulary.pieces(text):
            out += [(piece, True)] if special else [(w, False) for w in self.encoder.vocabulary.words(piece)]
        return out

    def _counted(self, words: list[tuple[str, bool]]) -> tuple[list[int], list[int]]:
        self.encoder.learn({w for w, special in words if not special})
        known = self.encoder.known
        return [len(w) for w, _ in words], [1 if special else len(known[w]) // 4 for w, special in words]

    def edit(self, start: int, stop: int, replacement: str) -> None:
        """Replace the code points from ``start`` to ``stop``."""
        start = min(max(start, 0), len(self.text))
        stop = min(max(stop, start), len(self.text))
        if start == stop and not replacement:
            return
        text = self.text[:start] + replacement + self.text[stop:]
        moved = len(replacement) - (stop - start)
        run, leaf, begin = self.tree.find(max(start - self.reach, 0))
        width = (start - begin) + len(replacement) + 64
        while True:  # a wider view until a new boundary meets an old one
            to = min(begin + width, len(text))
            sure = to if to == len(text) else to - self.reach
            met = self._meet(text, begin, to, sure, start + len(replacement), moved, run, leaf)
            if met:
                break
            width *= 2
        words, last = met
        self.reencoded += len(words)
        self.tree.splice((run, leaf), last, *self._counted(words))
        self.text = text

    def _meet(self, text: str, begin: int, to: int, sure: int, changed_end: int, moved: int, run: int, leaf: int) -> tuple[list[tuple[str, bool]], tuple[int, int]] | None:
        """New pre-tokens up to the first boundary behind the change that was one before, and the old leaf there."""
        old, old_end = self.tree.after(run, leaf), begin
        at, words = begin, []
        spot = (run, leaf)
        for word, special in self._words(text[begin:to]):
            at += len(word)
            if at > sure:
                return None
            words.append((word, special))
            if at < changed_end:
                continue
            while old_end + moved < at:
                step = next(old, None)
                if step is None:
                    break
                spot = (step[0], step[1] + 1)
                old_end += step[2]
            if old_end + moved == at and old_end >= begin:
                return words, spot
        if to < len(text):
            return None
        return words, (len(self.tree.runs), 0)  # the text's end


_kept: dict[str, Leaves] = {}


def _leaves_of(vocabulary: str) -> Leaves:
    """One table of leaves for all tasks that a Python worker runs for a vocabulary."""
    if vocabulary not in _kept:
        _kept.clear()
        _kept[vocabulary] = Leaves(Encoder(Vocabulary(vocabulary), None))
    return _kept[vocabulary]


def recounted(docs: DataFrame, path: str, edits: str = "edits") -> DataFrame:
    """``doc_id`` with the counts before and after the edits of the column ``edits``.

    That is an array of ``(start, stop, replacement)``. ``n_reencoded`` are the pre-tokens that were encoded again.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = _leaves_of(sent.value)
        encoder = leaves.encoder
        for batch in batches:
            n, pre, after, again, digests = [], [], [], [], []
            changes = batch.column("edits")
            for block in blocks(batch.column("text")):
                texts = [block.text(i).decode("utf-8", "replace") for i in range(block.n)]
                for i, (text, (lengths, counts)) in enumerate(zip(texts, leaves.of(texts), strict=True), block.first):
                    counter = Counter(text, encoder, SegmentTree(lengths, counts))
                    n.append(counter.tree.n_tokens)
                    pre.append(len(lengths))
                    for e in changes[i].as_py() or []:
                        if e is not None:
                            counter.edit(e["start"] or 0, e["stop"] or 0, e["replacement"] or "")
                    after.append(counter.tree.n_tokens)
                    again.append(counter.reencoded)
                    digests.append(hashlib.sha256(counter.text.encode()).hexdigest())
            counts = [pa.array(x, pa.int64()) for x in (pre, n, after, again)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(digests, pa.string())], ["doc_id", "n_pre_tokens", "n_tokens", "edited_tokens", "n_reencoded", "edited_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select("doc_id", "text", F.col(edits).alias("edits"))
    return chosen.mapInArrow(run, f"doc_id {kind}, n_pre_tokens long, n_tokens long, edited_tokens long, n_reencoded long, edited_sha256 string")


def gathered(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """``docs`` with the column ``edits`` from rows ``(doc_id, position, start, stop, replacement)``."""
    own = changes.where("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("position", "start", "stop", "replacement"))).alias("edits"))
    return docs.join(own, "doc_id", "left")


def example_edits(text: Column, note: Column) -> Column:
    """Three edits of a text: a replacement at its first quarter, an insertion of ``note`` at its middle, a removal at its last quarter."""
    n = F.length(F.coalesce(text, F.lit("")))

    def edit(start: Column, stop: Column, replacement: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), replacement.alias("replacement"))

    a, b, c = F.floor(n / 4), F.floor(n / 2), F.floor(3 * n / 4)
    return F.array(edit(a, a + 5, F.substring(text, 1, 9)), edit(b, b, note), edit(c, c + 20, F.lit("")))

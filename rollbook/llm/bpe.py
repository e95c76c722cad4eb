"""Byte-level BPE: a lexicon of frequent words and exact merges for the rest.

The corpus's words (each with the space before it) are counted over all
documents; the most frequent ones are compiled with their ids into a minimal acyclic automaton
(``lexicon``) that every task memory-maps. Words that it lacks are merged by
the vocabulary's ranks, pre-token by pre-token. The ids are those of the ``tokenizers`` library for the
vocabulary file given by path, without added special tokens; an added token's
string in a text is that token, as in the library. Decoding gives the text back.

Null texts are empty, an empty text has no ids. Repeated rows are encoded one
by one; columns other than ``doc_id`` and ``text`` are ignored. An empty corpus
gives an empty lexicon.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.blocks import Block, Hasher, blocks
from rollbook.llm.carry import named, per_block
from rollbook.llm.lexicon import Lexicon, compile_lexicon
from rollbook.llm.tables import put_file, stage

#: Words of the lexicon at most.
LEXICON_WORDS = 100_000
#: Longest word of the lexicon, in bytes.
LEXICON_BYTES = 64
#: Words whose ids are remembered.
REMEMBERED = 100_000
#: Different pieces that a task counts before it passes counts on.
COUNTED = 400_000
#: Pieces between spaces, and words within them, whose ids a Python worker remembers.
TABLE_PIECES = 1_000_000
TABLE_WORDS = 400_000
#: Longer words, and fewer words, are merged one by one.
LONG = 64
FEW = 24

#: Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS = regex.compile(PATTERN)
#: A space beside other white space. Where there is none, each space begins a pre-token,
#: and the pre-tokens of a piece between spaces do not depend on the text around it.
_IRREGULAR = regex.compile(r" \s|\s ")
#: ASCII white space, and the first two bytes of other white space, of the pattern.
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_OTHER_WHITE = ((0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80))
#: Letters (of two bytes from U+00C0 to U+023F and U+0400 to U+047F), digits, other printable ASCII and its
#: white space; 0 for bytes whose pre-tokens are not simply runs of one class.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xC9), 0xD0, 0xD1]] = 1
_KIND[0x30:0x3A] = 2
_KIND[0x09:0x0E] = _WHITE_KIND = 4
_KIND[ord("'")] = 0
#: Told apart from a piece after a space: one at a text's start.
_AT_START = np.uint64(0x5851F42D4C957F2D)
#: Characters whose classes may differ between versions of Unicode tables.
_UNSURE = regex.compile(r"[^\x00-ԯḀ-ỿ‐-‧‰-⁞₠-₿℀-⅏　-〿ぁ-ゖァ-ヺ一-龥가-힣]")


def _byte_symbols() -> dict[str, int]:
    """The byte that each character of a vocabulary entry stands for: printable ones themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranges(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of ranges that begin ``at`` and are ``n`` long, end to end."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at - ends + n, n)


def _edges(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n, dtype=np.int64)])


class Vocabulary:
    """Ids and merge ranks of a vocabulary file."""

    def __init__(self, content: str):
        parsed = json.loads(content)
        self.content = content
        symbols = _byte_symbols()
        vocab = parsed["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.bytes_of = {i: bytes(symbols[c] for c in s) for s, i in vocab.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.byte_id = [0] * 256
        for c, b in symbols.items():
            self.byte_id[b] = vocab[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(parsed["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self._split = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self._library = None
        self.no_rank = len(self.merges)
        self.merged_id = np.array([new for _, new in self.merges.values()])
        lengths = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, b in self.bytes_of.items():
            lengths[i] = len(b)
        self.lengths = lengths
        self._place_pairs(np.array([a * len(lengths) + b for a, b in self.merges], np.int64), np.array([r for r, _ in self.merges.values()], np.int64))
        self.starts = np.cumsum(lengths) - lengths
        self.data = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(lengths))), np.uint8)

    def merged(self, words: Sequence[bytes]) -> list[bytes]:
        """The ids of pre-tokens, as little-endian 32-bit integers."""
        ids, n = self.merged_flat(np.frombuffer(b"".join(words), np.uint8), _edges(np.array([len(w) for w in words], np.int64)))
        raw, ends = ids.astype("<u4").tobytes(), np.cumsum(n).tolist()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []

    def merged_flat(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens end to end, and how many each has; pre-token i is ``data[at[i]:at[i + 1]]``."""
        lengths = np.diff(at)
        short = (lengths > 0) & (lengths <= LONG) & (len(lengths) >= FEW)
        own = np.flatnonzero(short)
        ids, counts = self._merged_short(data[_ranges(at[own], lengths[own])], lengths[own])
        rest = np.flatnonzero(~short & (lengths > 0))
        if not len(rest):
            n = np.zeros(len(lengths), np.int64)
            n[own] = counts
            return ids, n
        others = [self._merged_long([self.byte_id[b] for b in data[at[i] : at[i + 1]].tolist()]) for i in rest.tolist()]
        n, begin = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        n[own], n[rest] = counts, [len(x) for x in others]
        begin[np.concatenate([own, rest])] = _edges(np.concatenate([n[own], n[rest]]))[:-1]
        return np.concatenate([ids, *(np.array(x, np.uint32) for x in others)])[_ranges(begin, n)], n

    def _merged_short(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The adjacent pair of the lowest rank merges first, leftmost of equals.

        All words take a step at a time, each its own next merge.
        """
        if not len(lengths):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids = np.array(self.byte_id)[data]
        word = np.repeat(np.arange(len(lengths)), lengths)
        done_ids, done_word = [], []
        rank = np.full(len(ids), self.no_rank)
        rank[:-1] = self._ranks(ids[:-1], ids[1:])
        last = np.concatenate([word[1:] != word[:-1], [True]])
        rank[last] = self.no_rank
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(rank, first)
            live = least < self.no_rank
            if not live.all():
                ended = np.repeat(~live, size)
                done_ids.append(ids[ended])
                done_word.append(word[ended])
                ids, word, rank = ids[~ended], word[~ended], rank[~ended]
                least, size = least[live], size[live]
                if not len(ids):
                    break
            spot = np.flatnonzero(rank == np.repeat(least, size))
            spot = spot[np.concatenate([[True], word[spot[1:]] != word[spot[:-1]]])]
            ids[spot] = self.merged_id[least]
            kept = np.ones(len(ids), bool)
            kept[spot + 1] = False
            ids, word, rank = ids[kept], word[kept], rank[kept]
            spot -= np.arange(len(spot))  # one symbol has gone from each word before
            for at in (spot, spot[spot > 0] - 1):
                ahead = np.minimum(at + 1, len(ids) - 1)
                fresh = self._ranks(ids[at], ids[ahead])
                fresh[(word[ahead] != word[at]) | (ahead == at)] = self.no_rank
                rank[at] = fresh
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(word, minlength=len(lengths))

    def _place_pairs(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Ranks of pairs in open addressing over flat arrays, at most a quarter full."""
        self.pair_bits = max(4, (4 * len(keys)).bit_length())
        self.pair_key, self.pair_rank = np.full(1 << self.pair_bits, -1, np.int64), np.full(1 << self.pair_bits, self.no_rank, np.int64)
        slot = self._pair_slot(keys)
        while len(keys):
            free = np.flatnonzero(self.pair_key[slot] < 0)
            taken, first = np.unique(slot[free], return_index=True)
            own = free[first]
            self.pair_key[taken], self.pair_rank[taken] = keys[own], ranks[own]
            keys, ranks, slot = (np.delete(x, own) for x in (keys, ranks, slot))
            slot = (slot + 1) & ((1 << self.pair_bits) - 1)

    def _pair_slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.pair_bits)).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * len(self.lengths) + b
        slot = self._pair_slot(key)
        have = self.pair_key[slot]
        out = np.where(have == key, self.pair_rank[slot], self.no_rank)
        live = np.flatnonzero((have != key) & (have >= 0))
        slot = slot[live]
        while len(live):
            slot = (slot + 1) & ((1 << self.pair_bits) - 1)
            have = self.pair_key[slot]
            hit = have == key[live]
            out[live[hit]] = self.pair_rank[slot[hit]]
            more = ~hit & (have >= 0)
            live, slot = live[more], slot[more]
        return out

    def _merged_long(self, ids: list[int]) -> list[int]:
        """One long word in n log n: a heap of pairs over a linked list."""
        merges, n = self.merges, len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
        return [x for x in ids if x >= 0]

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text that holds no added token."""
        if _UNSURE.search(text):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_str(self.content).pre_tokenizer
            return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]
        return WORDS.findall(text)

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at added tokens, and whether a piece is one."""
        if not self._split or not any(s in text for s in self.added):
            return [(text, False)]
        out, at = [], 0
        for m in self._split.finditer(text):
            out += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [*out, (text[at:], False)]

    def decoded(self, ids: np.ndarray) -> bytes:
        """The bytes of ids."""
        return self.data[_ranges(self.starts[ids], self.lengths[ids])].tobytes()


class PieceTable:
    """Ids of pieces of text by the 64-bit hash of their bytes: open addressing over flat arrays."""

    def __init__(self) -> None:
        self.bits, self.count, self.used = 16, 0, 0
        self.key = np.zeros(1 << self.bits, np.uint64)  # 0: free
        self.at, self.n = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, np.int32)
        self.ids = np.empty(1 << 18, np.uint32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 for those that aren't there."""
        out = np.full(len(hashes), -1, np.int64)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        live = np.arange(len(hashes))
        while len(live):
            key = self.key[slot]
            hit = key == hashes[live]
            out[live[hit]] = slot[hit]
            more = ~hit & (key != 0)
            live, slot = live[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        """Different hashes that aren't there, with the ids of their pieces."""
        n = np.array([len(x) >> 2 for x in ids], np.int64)
        self.put(hashes, np.frombuffer(b"".join(ids), "<u4"), np.cumsum(n) - n, n)

    def put(self, hashes: np.ndarray, new: np.ndarray, first: np.ndarray, n: np.ndarray) -> None:
        """Different hashes that aren't there; the ids of each are ``n`` of ``new`` from ``first`` on."""
        if 2 * (self.count + len(hashes)) > 1 << self.bits:
            old = self.key > 0
            kept, at, size = self.key[old], self.at[old], self.n[old]
            while 2 * (self.count + len(hashes)) > 1 << self.bits:
                self.bits += 1
            self.key = np.zeros(1 << self.bits, np.uint64)
            self.at, self.n = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, np.int32)
            self._place(kept, at, size)
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(self.used + 2 * len(new), np.uint32)])
        self.ids[self.used : self.used + len(new)] = new
        self._place(hashes, self.used + first, n.astype(np.int32))
        self.used += len(new)
        self.count += len(hashes)

    def _place(self, hashes: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        live = np.arange(len(hashes))
        while len(live):
            free = np.flatnonzero(self.key[slot] == 0)
            taken, first = np.unique(slot[free], return_index=True)
            own = free[first]
            self.key[taken], self.at[taken], self.n[taken] = hashes[live[own]], at[live[own]], n[live[own]]
            rest = np.ones(len(live), bool)
            rest[own] = False
            live, slot = live[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces end to end, and those before each piece."""
        n = self.n[slots].astype(np.int64)
        return self.ids[_ranges(self.at[slots], n)], _edges(n)


class Tally:
    """Counts of pieces by hash, with the bytes of each."""

    def __init__(self) -> None:
        self.table, self.n = PieceTable(), np.zeros(1 << 16, np.int64)
        self.data: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        slots = self.table.find(hashes)
        new = np.flatnonzero(slots < 0)
        if len(new):
            fresh, first = np.unique(hashes[new], return_index=True)
            own = new[first]
            have, size = self.table.count, ends[own] - starts[own]
            self.table.put(fresh, np.arange(have, have + len(own), dtype=np.uint32), np.arange(len(own)), np.ones(len(own), np.int64))
            self.data.append(data[_ranges(starts[own], size)])
            self.lengths.append(size)
            slots = self.table.find(hashes)
        while len(self.n) < self.table.count:
            self.n = np.concatenate([self.n, np.zeros_like(self.n)])
        np.add.at(self.n, self.table.ids[self.table.at[slots]], 1)

    def rows(self) -> tuple[pa.Array, pa.Array]:
        """All pieces and their counts."""
        at = _edges(np.concatenate([np.zeros(0, np.int64), *self.lengths])).astype(np.int32)
        data = np.concatenate([np.zeros(0, np.uint8), *self.data])
        return pa.StringArray.from_buffers(self.table.count, pa.py_buffer(at), pa.py_buffer(data)), pa.array(self.n[: self.table.count])


def split_regular(text: str) -> tuple[list[str], list[str]] | None:
    """The pre-tokens before the first space and the pieces after each space, if pieces can be cut one by one."""
    if _IRREGULAR.search(text) or _UNSURE.search(text):
        return None
    rest = text.split(" ")
    return WORDS.findall(rest.pop(0)), rest


class Encoder:
    """Ids of texts, with the words and pieces met lately remembered.

    A text is cut at its spaces, unless one stands beside other white space.
    Pieces are looked up by hash; new ones in the lexicon, then word by word.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.known: dict[str, bytes] = {}
        self.table, self.words = PieceTable(), PieceTable()

    def learn(self, words: set[str]) -> None:
        """Look up or merge the words that aren't remembered."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        raw = [w.encode() for w in new]
        found = self.lexicon.outputs(raw) if self.lexicon else [None] * len(raw)
        other = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(other, self.vocabulary.merged([raw[i] for i in other]), strict=True):
            found[i] = ids
        self.known.update(zip(new, found, strict=True))

    def spelled(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces without added tokens, as little-endian 32-bit integers."""
        out = self.lexicon.outputs([p.encode() for p in pieces]) if self.lexicon else [None] * len(pieces)
        words = {i: self.vocabulary.words(pieces[i]) for i, ids in enumerate(out) if ids is None}
        self.learn(set(chain.from_iterable(words.values())))
        known = self.known
        for i, own in words.items():
            out[i] = b"".join([known[w] for w in own])
        return out

    def spelled_flat(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each piece begin and how many it has; piece i, which isn't empty, is ``data[at[i]:at[i + 1]]``."""
        begin, n = np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1, np.int64)
        ids, used = [], 0

        def given(pieces: np.ndarray, own: np.ndarray, counts: np.ndarray) -> None:
            nonlocal used
            n[pieces], begin[pieces] = counts, used + np.cumsum(counts) - counts
            ids.append(own)
            used += len(own)

        numbers = self.lexicon.numbers_flat(data, at) if self.lexicon else np.full(len(n), -1, np.int64)
        if self.lexicon:
            found = np.flatnonzero(numbers >= 0)
            given(found, *self.lexicon.gather(numbers[found]))
        missing = np.flatnonzero(numbers < 0)
        plain = _plain(data, at)[missing]
        if plain.any():
            own = missing[plain]
            given(own, *self._runs(data[_ranges(at[own], at[own + 1] - at[own])], _edges(at[own + 1] - at[own])))
        if not plain.all():
            own = missing[~plain]
            found = self.spelled([data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace") for i in own.tolist()])
            given(own, np.frombuffer(b"".join(found), "<u4"), np.array([len(x) >> 2 for x in found], np.int64))
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), begin, n

    def _runs(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain pieces end to end, and how many each has: their pre-tokens are runs of one class, the first with its space; the last of some white space stands alone."""
        kind, head = _KIND[data], at[:-1]
        spaced = head[data[head] == 0x20]
        kind[spaced] = kind[spaced + 1]
        begins = np.ones(len(data), bool)
        begins[1:] = kind[1:] != kind[:-1]
        white = kind == _WHITE_KIND
        begins[:-1] |= white[:-1] & ~white[1:]
        begins[head] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        hashes = Hasher(data)(starts, ends)
        hashes[hashes == 0] = 1
        if self.words.count > TABLE_WORDS:
            self.words = PieceTable()
        slots = self.words.find(hashes)
        new = np.flatnonzero(slots < 0)
        if len(new):
            fresh, first = np.unique(hashes[new], return_index=True)
            own = new[first]
            size = ends[own] - starts[own]
            raw, edges = data[_ranges(starts[own], size)], _edges(size)
            numbers = np.full(len(own), -1, np.int64)
            if self.lexicon:  # which lacks the whole pieces
                inner = np.flatnonzero(np.bincount(np.searchsorted(at, starts, "right") - 1, minlength=len(head))[np.searchsorted(at, starts[own], "right") - 1] > 1)
                numbers[inner] = self.lexicon.numbers_flat(raw[_ranges(edges[inner], size[inner])], _edges(size[inner]))
            found, other = np.flatnonzero(numbers >= 0), np.flatnonzero(numbers < 0)
            if len(found):
                ids, n = self.lexicon.gather(numbers[found])
                self.words.put(fresh[found], ids, np.cumsum(n) - n, n)
            if len(other):
                ids, n = self.vocabulary.merged_flat(raw[_ranges(edges[other], size[other])], _edges(size[other]))
                self.words.put(fresh[other], ids, np.cumsum(n) - n, n)
            slots = self.words.find(hashes)  # a table that grew has other slots
        ids, edges = self.words.gather(slots)
        return ids, np.diff(edges[np.searchsorted(starts, at)])

    def whole(self, text: str) -> np.ndarray:
        """The ids of one text, pre-token by pre-token."""
        out = []
        for part, special in self.vocabulary.pieces(text):
            if special:
                out.append(self.vocabulary.added[part].to_bytes(4, "little"))
            else:
                words = self.vocabulary.words(part)
                self.learn(set(words))
                out += [self.known[w] for w in words]
        return np.frombuffer(b"".join(out), "<u4")

    def cut(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of texts that can be cut at spaces: starts, ends and hashes, each with the space before it, the pieces before each text, and the texts that can't be cut."""
        data = block.data
        space = data == 0x20
        starts, ends, before = block.pieces(~space)
        text = np.repeat(np.arange(block.n), np.diff(before))
        whole = self._not_cut(block, space)
        hashes = Hasher(data)(starts, ends)
        first = starts == block.at[text]
        hashes[first] ^= _AT_START
        hashes[hashes == 0] = 1
        cut = np.flatnonzero(~whole[text])
        return (starts - ~first)[cut], ends[cut], hashes[cut], np.searchsorted(cut, before), whole

    def block(self, block: Block) -> list[np.ndarray]:
        """The ids of each text."""
        starts, ends, hashes, before, whole = self.cut(block)
        if self.table.count > TABLE_PIECES:
            self.table = PieceTable()
        slots = self.table.find(hashes)
        new = np.flatnonzero(slots < 0)
        if len(new):
            fresh, first = np.unique(hashes[new], return_index=True)
            own = new[first]
            size = ends[own] - starts[own]
            self.table.put(fresh, *self.spelled_flat(block.data[_ranges(starts[own], size)], _edges(size)))
            slots = self.table.find(hashes)
        ids, at = self.table.gather(slots)
        edges = at[before]
        return [self.whole(block.text(i).decode("utf-8", "replace")) if whole[i] else ids[edges[i] : edges[i + 1]] for i in range(block.n)]

    def _not_cut(self, block: Block, space: np.ndarray) -> np.ndarray:
        """Texts in which a space stands beside white space or at the end, or that may hold other white space or an added token."""
        data = block.data
        odd = np.zeros(len(data), bool)
        if len(data) > 1:
            white = _WHITE[data]
            odd[:-1] = space[:-1] & white[1:] | white[:-1] & space[1:]
            for first, second in _OTHER_WHITE:
                odd[:-1] |= (data[:-1] == first) & (data[1:] == second)
        for token in self.vocabulary.added:
            head = np.flatnonzero(data == token.encode()[0])
            odd[head] |= np.array([data[i : i + len(token.encode())].tobytes() == token.encode() for i in head.tolist()], bool)
        last = block.at[1:] - 1
        odd[last[last >= block.at[:-1]]] |= space[last[last >= block.at[:-1]]]
        return block.per_text(odd) > 0


def _plain(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Pieces, after a space or not, of bytes with a class, that end in no white space."""
    kind = _KIND[data]
    odd = kind == 0
    odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # signs amid letters
    head, last = at[:-1], at[1:] - 1
    after = kind[np.minimum(head + 1, last)]
    odd[head] &= (data[head] != 0x20) | (after == 0) | (after == _WHITE_KIND)
    odd[last] |= kind[last] == _WHITE_KIND
    sums = _edges(odd)
    return sums[at[1:]] == sums[head]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def word_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(word, n)`` of all documents: the pieces between spaces, each with the space before it; where texts can't be cut so, what follows each space or pre-tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(sent.value)
        cutter, tally = Encoder(vocab, None), Tally()
        counts: Counter[str] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([*tally.rows()], ["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for block in blocks(batch.column("text")):
                starts, ends, hashes, _, whole = cutter.cut(block)
                tally.count(block.data, starts, ends, hashes)
                for i in np.flatnonzero(whole).tolist():
                    for part, special in vocab.pieces(block.text(i).decode("utf-8", "replace")):
                        if special:
                            continue
                        head, rest = split_regular(part) or (vocab.words(part), [])
                        counts.update(head)
                        counts.update(" " + p for p in rest)
                if len(counts) + tally.table.count > COUNTED:
                    yield from flush()
                    tally = Tally()
                    counts.clear()
        yield from flush()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: str, limit: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of ``docs``; returns the name that tasks open it by.

    Words whose counts are of one size (64 steps to a doubling) go in or stay out together. At most ``limit`` words of at most ``LEXICON_BYTES`` come to the driver.
    """
    counts = word_counts(docs, vocabulary).where(F.octet_length("word").between(1, LEXICON_BYTES))
    counts = stage(counts.withColumn("size", F.floor(F.log2("n") * 64).cast("int")), "words")
    least, kept = 1 << 30, 0
    for size, words in sorted(counts.groupBy("size").count().collect(), reverse=True):  # at most 4,096 rows
        if kept + words > limit:
            break
        least, kept = size, kept + words
    frequent = counts.where(F.col("size") >= least)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(sent.value)
        for batch in batches:
            ids = Encoder(vocab, None).spelled(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.binary())], ["word", "ids"])

    rows = frequent.select("word").mapInArrow(merge, "word string, ids binary").collect()
    return put_file(docs.sparkSession, "lexicon", compile_lexicon((w.encode(), np.frombuffer(ids, "<u4").tolist()) for w, ids in rows))


def _per_worker(sent, lexicon: str | None) -> Callable[[], Encoder]:
    """One encoder for all tasks that a Python worker runs for a lexicon."""

    def encoder() -> Encoder:
        if lexicon not in _encoders:
            _encoders.clear()
            _encoders[lexicon] = Encoder(Vocabulary(sent.value), Lexicon.open(SparkFiles.get(lexicon)) if lexicon else None)
        return _encoders[lexicon]

    return encoder


_encoders: dict[str | None, Encoder] = {}


def encoded(docs: DataFrame, path: str, columns: list[str], with_ids: bool = True, limit: int = LEXICON_WORDS) -> DataFrame:
    """``columns`` with ``n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids``.

    Carried columns are named ``__0``, ``__1`` and so on.
    """
    vocabulary = read_vocabulary(path)
    encoder = _per_worker(docs.sparkSession.sparkContext.broadcast(vocabulary), build_lexicon(docs, vocabulary, limit))

    def run(block: Block) -> dict:
        own = encoder()
        n, digests, decoded, lists = [], [], [], []
        for ids in own.block(block):
            n.append(len(ids))
            digests.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            text = own.vocabulary.decoded(ids).decode("utf-8", "replace")
            decoded.append(hashlib.sha256(text.encode()).hexdigest())
            lists.append(ids)
        out = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
        if with_ids:
            at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            out["ids"] = pa.ListArray.from_arrays(at, pa.array(np.concatenate(lists).astype(np.int32) if lists else [], pa.int32()))
        return out

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return per_block(docs, "text", columns, schema, run)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, the ids and their digests."""
    return named(encoded(docs, path, ["doc_id"]), ["doc_id"], ["n_tokens", "ids_sha256", "decoded_sha256", "ids"])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, the number of ids and the digests."""
    return named(encoded(docs, path, ["doc_id"], with_ids=False), ["doc_id"], ["n_tokens", "ids_sha256", "decoded_sha256"])


def decode(encoded_docs: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """``encoded_docs`` with the ``text`` that its ids stand for, in place of any text it has."""
    sent = encoded_docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    others = [f for f in encoded_docs.schema.fields if f.name != "text"]
    chosen = encoded_docs.select(*(F.col(f"`{f.name}`").alias(f"__{i}") for i, f in enumerate(others)), F.col(column).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(sent.value)
        for batch in batches:
            texts = [vocabulary.decoded(np.array(x.as_py() or [], np.int64)).decode("utf-8", "replace") for x in batch.column("__ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    head = "".join(f"__{i} {f.dataType.simpleString()}, " for i, f in enumerate(others))
    out = chosen.mapInArrow(run, head + "text string")
    return out.select(*(F.col(f"__{i}").alias(f.name) for i, f in enumerate(others)), "text")

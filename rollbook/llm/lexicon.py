"""A minimal acyclic automaton of words, with a list of ids as each word's output.

Words that end alike share states. A word's number is the count of words before
it in byte order, summed along its path (each arc holds the words it skips);
its ids are found by that number. The compiled file holds flat arrays and is
memory-mapped, so the processes of a machine share one copy of its pages.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

import numpy as np

_PARTS = (("arc_key", "<i8"), ("arc_to", "<i4"), ("arc_skip", "<i4"), ("final", "|u1"), ("id_at", "<i8"), ("ids", "<u4"))


def _minimal(words: Sequence[bytes]) -> tuple[list[dict[int, int]], list[bool], int]:
    """Arcs and finality of the states of the minimal automaton of sorted words, and its start."""
    arcs: list[dict[int, int]] = []
    final: list[bool] = []
    known: dict[tuple, int] = {}

    def settle(path: list[tuple[dict[int, int], list[bool]]], depth: int, labels: bytes) -> None:
        """Give numbers to the states of the last word's path below ``depth``, equal ones the same."""
        while len(path) - 1 > depth:
            out, end = path.pop()
            key = (end[0], *out.items())
            state = known.get(key)
            if state is None:
                state = known[key] = len(arcs)
                arcs.append(out)
                final.append(end[0])
            path[-1][0][labels[len(path) - 1]] = state

    path: list[tuple[dict[int, int], list[bool]]] = [({}, [False])]
    last = b""
    for word in words:
        shared = 0
        for a, b in zip(last, word, strict=False):
            if a != b:
                break
            shared += 1
        settle(path, shared, last)
        path += [({}, [False]) for _ in range(len(word) - shared)]
        path[-1][1][0] = True
        last = word
    settle(path, 0, last)
    arcs.append(path[0][0])
    final.append(path[0][1][0])
    return arcs, final, len(arcs) - 1


def compile_lexicon(entries: Iterable[tuple[bytes, Sequence[int]]]) -> bytes:
    """The file of an automaton for different words with their ids, in any order."""
    ordered = sorted(entries)
    arcs, final, start = _minimal([w for w, _ in ordered])
    below = np.zeros(len(arcs), np.int64)  # words that end at or below a state; targets have smaller numbers
    key, to, skip = [], [], []
    for state, out in enumerate(arcs):
        total = int(final[state])
        for label, target in out.items():  # in byte order, as words were sorted
            key.append(state << 8 | label)
            to.append(target)
            skip.append(total)
            total += int(below[target])
        below[state] = total
    lengths = np.array([len(ids) for _, ids in ordered], np.int64)
    parts = {
        "arc_key": key, "arc_to": to, "arc_skip": skip, "final": final,
        "id_at": np.concatenate([[0], np.cumsum(lengths)]), "ids": [i for _, ids in ordered for i in ids],
    }
    arrays = [np.asarray(parts[name], kind) for name, kind in _PARTS]
    head = json.dumps({"start": start, "sizes": [len(a) for a in arrays]}).encode()
    head += b" " * (-len(head) % 8)
    out = len(head).to_bytes(8, "little") + head
    for a in arrays:
        raw = a.tobytes()
        out += raw + b"\0" * (-len(raw) % 8)
    return out


class Lexicon:
    """Look-ups in a compiled file."""

    def __init__(self, content: np.ndarray):
        size = int.from_bytes(content[:8].tobytes(), "little")
        head = json.loads(content[8 : 8 + size].tobytes())
        self.start, at = head["start"], 8 + size
        for (name, kind), n in zip(_PARTS, head["sizes"], strict=True):
            width = n * np.dtype(kind).itemsize
            setattr(self, name, content[at : at + width].view(kind))
            at += width + (-width % 8)

    @classmethod
    def open(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, np.uint8, "r"))

    def numbers(self, words: Sequence[bytes]) -> np.ndarray:
        """The number of each word, -1 for words that aren't in the lexicon."""
        lengths = np.array([len(w) for w in words], np.int64)
        return self.numbers_flat(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum(lengths)]))

    def numbers_flat(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The same for words end to end: word i is ``data[at[i]:at[i + 1]]``."""
        lengths = np.diff(at)
        out = np.full(len(lengths), -1, np.int64)
        if not len(lengths) or not len(self.arc_key):
            return out
        live = np.flatnonzero(lengths > 0)
        state, number = np.full(len(lengths), self.start, np.int64), np.zeros(len(lengths), np.int64)
        depth = 0
        while len(live):
            key = state[live] << 8 | data[at[live] + depth]
            spot = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
            found = self.arc_key[spot] == key
            live, spot = live[found], spot[found]
            state[live] = self.arc_to[spot]
            number[live] += self.arc_skip[spot]
            depth += 1
            done = live[lengths[live] == depth]
            done = done[self.final[state[done]] > 0]
            out[done] = number[done]
            live = live[lengths[live] > depth]
        return out

    def outputs(self, words: Sequence[bytes]) -> list[bytes | None]:
        """The ids of each word as little-endian 32-bit integers, None for words that aren't in the lexicon."""
        numbers = self.numbers(words)
        return [None if i < 0 else self.ids[self.id_at[i] : self.id_at[i + 1]].tobytes() for i in numbers.tolist()]

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in the lexicon end to end, and how many each has."""
        n = self.id_at[numbers + 1] - self.id_at[numbers]
        ends = np.cumsum(n)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.id_at[numbers] - ends + n, n)
        return self.ids[place], n

"""A linear-chain conditional random field over word shapes, in numpy.

A word's features come from its shape (letter runs become one ``a`` or ``A``,
digit runs keep up to five digits, runs of another character become one), its
length class and, for a few cue words, the word itself; the same features of
the words on either side are used as well. Words of one kind share a row of
scores, so a text is scored by table look-ups.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

LABELS = ("O", "phone", "secret")

#: Words that are features by themselves.
CUES = ("token", "secret", "password", "passwd", "key", "apikey", "bearer", "phone", "tel", "call", "fax", "mobile", "=", ":")

#: The labelled table. Marked are national phone numbers and credentials.
LABELLED = (
    "call {phone:(826) 555-4081} now",
    "{phone:(017) 555-7713}",
    "tel {phone:(136) 555-7479} or write",
    "thshand the {phone:(926) 555-2081}, only of",
    "Ring us: {phone:(212) 664-7665}!!",
    "la de {phone:(301) 555-0199}### su",
    "phone: {phone:(415) 555-2671} ext 12",
    "fax {phone:(020) 794-6095}. Then",
    "my number is {phone:415-555-0132} and",
    "call {phone:212-555-7788} today",
    "mobile {phone:650-253-0000}, thanks",
    "{phone:310-555-0170}",
    "tel {phone:555-867-5309}%%% und",
    'token = {secret:"24be64439e3e49cf46b2d7c90f3602a3d0b907ff"}',
    'the ### token = {secret:"b44e15e09fd311c3cf3163b66d5a9875b883d8ce"}### of',
    'secret = {secret:"2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"} that and',
    'TOKEN = {secret:"9233A8ECF7C5B09FE5949719B6B82BC439E9329B"}!! TIINST!!',
    'token = {secret:"04dbebab91ab85687d33eeaaf9ac699e1188f962"} thhantou with.',
    'password = {secret:"d7c9f1a2b3c4e5f60718293a4b5c6d7e"} que de',
    'key = {secret:"3fdf5a35c7b8d733c0b5c7d364eda8ac88d929d1"} und die',
    "token = {secret:ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e} la",
    "apikey = {secret:9c8b45435718dcc700c184a7e303cdc64c6a8f7f}, then",
    "The and attion to thanedble the, anea. Eriner thanea.",
    "it is at the end of the road. At noon",
    "And therhean is the is esndha reedes ha.",
    "Le çon éeau que, dans le. Ér es l'été",
    "Über die straße und zurück. Ä ö ß, ü",
    "Ascirr para osóciónta cióngañ no. El niño",
    "THTHER!! ONERSTAN!! FOR!! ONING!! EDHE.!!",
    "of%%% athe*** erntwh.%%% Thntatwh&&& the$$$ on### (and)",
    "Stster | orblehe | antihe | erheer. | Thtiin | x |",
    "Licensed under the Apache License, Version 2.0.",
    "Licensed under CC BY-NC 4.0.",
    "the GNU General Public License, version 3.",
    "card 5927243074273351 here",
    "of 4929963689861572 hely, innt 3417310086869215 and",
    "host 192.168.0.1 and 43.21.141.162 from, loser",
    "mail from.14@mail9.example.com or par.43@mail4.example.com### now",
    "in 1999 and 2024, on 2024-01-05 at 10:30",
    "costs 1,234.56 or 12.50 in (2019) pages 12-14",
    "section (3) of 12 and 555 items, (100) and 250-300",
    "call the office at 9 or 10, phone the desk",
    "the key is token = value and x = 12",
    "token of the secret: a password is a word = a key",
    "a = b, c = 3, d = 4.5",
    "version 1.2.3-4 build 20240105 of abc123 def4",
    "+1 (826) of 99 and (12) 345-6",
    "He said: \"the end\" and 'this' -- then (so) [ref] {x}; a/b",
    "http://host.example.com/en/825?page=2 and https://m.example.net/x#top",
    "x1 b2 c3d4 A7 mp3 h264 0x1F 3rd 4th",
)


def shape(word: str) -> str:
    """The shape that ``shapes_of`` hashes, of one word."""
    out, run = [], 0
    for ch in word:
        kind = "9" if "0" <= ch <= "9" else "A" if "A" <= ch <= "Z" else "a" if "a" <= ch <= "z" or ord(ch) > 127 else ch
        run = run + 1 if out and last == kind else 0
        last = kind
        if run == 0 or kind == "9" and run < 5:
            out.append(kind)
    return "".join(out)


def length_class(n: int) -> int:
    return int(np.searchsorted((1, 2, 4, 8, 15, 31), n))


def features(word: str) -> list[str]:
    """The features of a word, from its UTF-8 length, shape and cue only."""
    s = shape(word)
    out = [f"len={length_class(len(word.encode()))}", f"head={s[:4]}", f"tail={s[-4:]}"]
    core = s.rstrip(".,;:!?*#%$&)\"'").lstrip("\"'")
    out.append(f"core={core}" if len(core) < 14 else "core=long")
    turns = sum(a != b for a, b in zip(s, s[1:], strict=False) if (a in "aA") != (b in "aA"))
    out += [f"turns={min(turns, 6) // 3}", f"digits={'9' in s}", f"quote={s[:1] == chr(34)}", f"plain={core in ('a', 'A', 'Aa', 'a-a', '')}"]
    cue = word.lower().strip(".,;:!?") if word.isascii() else ""
    if cue in CUES or word in CUES:
        out.append(f"cue={cue or word}")
    return out


def parse(row: str) -> list[tuple[str, int]]:
    """Words with labels of a row of ``LABELLED``."""
    out, label, rest = [], 0, row
    for piece in rest.split(" "):
        if piece.startswith("{") and ":" in piece and piece[1:].split(":")[0] in LABELS:
            name, piece = piece[1:].split(":", 1)
            label = LABELS.index(name)
        ends = "}" in piece and label
        if piece.replace("}", "") if ends else piece:
            out.append((piece.replace("}", "", 1) if ends else piece, label))
        if ends:
            label = 0
    return out


class Model:
    """``weights[feature]`` is a row of scores by label for the word before, the word itself and the word after."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray, bias: np.ndarray):
        self.index, self.weights, self.moves, self.bias = index, weights, moves, bias
        # What a label other than O can gain from the moves on either side of it at most.
        into, out_of = moves[:, 1:] - moves[:, :1], moves[1:] - moves[:1]
        self.pull = max(0.0, into.max()) + max(0.0, out_of.max())

    def rows(self, word: str) -> np.ndarray:
        """Scores (as the word before the scored one, as itself, as the word after) by label."""
        known = [self.index[f] for f in features(word) if f in self.index]
        return self.weights[known].sum(0) if known else np.zeros((3, len(LABELS)))


def _emissions(model: Model, words: list[str]) -> np.ndarray:
    rows = np.stack([model.rows(w) for w in words])
    out = rows[:, 1] + model.bias
    out[1:] += rows[:-1, 0]
    out[:-1] += rows[1:, 2]
    return out


def train(rows: Iterable[str] = LABELLED, epochs: int = 120, rate: float = 0.3, decay: float = 2e-3) -> Model:
    """Maximum likelihood with a quadratic penalty, by AdaGrad over whole rows in order."""
    data = [parse(r) for r in rows]
    index = {f: i for i, f in enumerate(dict.fromkeys(f for row in data for w, _ in row for f in features(w)))}
    k = len(LABELS)
    model = Model(index, np.zeros((len(index), 3, k)), np.zeros((k, k)), np.zeros(k))
    params = [model.weights, model.moves, model.bias]
    seen = [np.full(p.shape, 1e-6) for p in params]
    for _ in range(epochs):
        for row in data:
            words, gold = [w for w, _ in row], np.array([y for _, y in row])
            n = len(words)
            e = _emissions(model, words)
            ahead, back = np.zeros((n, k)), np.zeros((n, k))
            ahead[0] = e[0]
            for t in range(1, n):
                ahead[t] = e[t] + np.logaddexp.reduce(ahead[t - 1][:, None] + model.moves, axis=0)
            for t in range(n - 2, -1, -1):
                back[t] = np.logaddexp.reduce(model.moves + (e[t + 1] + back[t + 1])[None], axis=1)
            total = np.logaddexp.reduce(ahead[-1])
            miss = np.exp(ahead + back - total)
            miss[np.arange(n), gold] -= 1
            grads = [np.zeros_like(p) for p in params]
            for t in range(1, n):
                grads[1] += np.exp(ahead[t - 1][:, None] + model.moves + (e[t] + back[t])[None] - total)
                grads[1][gold[t - 1], gold[t]] -= 1
            grads[2] += miss.sum(0)
            for t, word in enumerate(words):
                known = [index[f] for f in features(word)]
                grads[0][known, 1] += miss[t]
                if t + 1 < n:
                    grads[0][known, 0] += miss[t + 1]
                if t:
                    grads[0][known, 2] += miss[t - 1]
            for p, g, s in zip(params, grads, seen, strict=True):
                g = g + decay * p
                s += g * g
                p -= rate * g / np.sqrt(s)
    return Model(index, *params)


def viterbi(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best labels of many chains: chain i has the rows ``starts[i]`` and the ``lengths[i] - 1`` after it of ``e``."""
    labels = np.zeros(len(e), np.int8)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    if not len(starts):
        return labels
    best = e[starts]
    final = np.zeros_like(best)
    froms = []
    live = np.searchsorted(-lengths, -np.arange(lengths[0] + 1), "right")  # chains with at least so many rows
    for t in range(1, lengths[0]):
        n, was = live[t + 1], live[t]
        final[n:was] = best[n:was]
        through = best[:n, :, None] + moves
        pick = through.argmax(1)
        froms.append(pick.astype(np.int8))
        best = np.take_along_axis(through, pick[:, None, :], 1)[:, 0] + e[starts[:n] + t]
    final[: len(best)] = best
    at = final.argmax(1)
    labels[starts + lengths - 1] = at
    for t in range(lengths[0] - 1, 0, -1):
        n = live[t + 1]
        at[:n] = froms[t - 1][np.arange(n), at[:n]]
        labels[starts[:n] + t - 1] = at[:n]
    return labels

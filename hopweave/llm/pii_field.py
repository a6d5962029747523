"""A linear-chain conditional random field over word shapes.

Tokens are words and single signs; a line break is a token of its own and, like the ends of a text, belongs to no span.
A token's features are its shape, length, spelling and ending (the last two only where the labelled table has them twice)
and those of its two neighbours on either side. Tokens with equal features form a class, so emissions are sums of rows of
small tables. Training maximises the likelihood, less a squared penalty, by full gradients (forward-backward over the
padded table).

Decoding is by Viterbi. A token whose best gain over "outside" is below the most that any two transitions around it can
give is outside on every best path. Such tokens cut the chain, so what is left are short pieces, decoded side by side,
the longest first; the result is that of Viterbi over the whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

TOKEN = re.compile(r"\w+|[^\w\s]|\n")
REACH = (-2, -1, 0, 1, 2)  # neighbours whose features count
BREAK = "\n"


def shape(token: str) -> str:
    """Runs of capitals X, small letters x and digits d with their number; other signs stand for themselves."""
    if token.isalpha():
        if token.islower():
            return "x"
        if token.istitle():
            return "X" if len(token) == 1 else "Xx"
        if token.isupper():
            return "XX"
    if token.isdigit():
        return f"d{min(len(token), 7)}"
    out = "".join("X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c for c in token[:32])
    return re.sub(r"([Xx])\1+", r"\1\1", out)


@dataclass
class Field:
    labels: list[str]  # the first one is "outside"
    spellings: set[str] = field(default_factory=set)
    endings: set[str] = field(default_factory=set)
    names: dict[tuple, int] = field(default_factory=dict)  # feature to row
    weights: np.ndarray | None = None  # REACH x features x labels
    moves: np.ndarray | None = None  # labels x labels

    def features(self, token: str) -> tuple:
        low = token.lower()
        out = [("shape", shape(token)), ("length", min(len(token), 12))]
        if low in self.spellings:
            out.append(("word", low))
        if low[-3:] in self.endings and len(low) > 4:
            out.append(("end", low[-3:]))
        return tuple(out)

    def rows(self, features: tuple) -> list[int]:
        return [self.names[f] for f in features if f in self.names]

    def emissions(self, classes: list[tuple], of: np.ndarray) -> np.ndarray:
        """Scores of labels of a chain of tokens, given as classes; both ends of the chain are breaks."""
        out = np.zeros((len(of), len(self.labels)), np.float32)
        own = [self.rows(c) for c in classes]
        for w, shift in zip(self.weights, REACH):
            table = np.array([w[r].sum(axis=0) for r in own], np.float32)
            if shift == 0:
                out += table[of]
            elif shift < 0:
                out[-shift:] += table[of[:shift]]
            else:
                out[:-shift] += table[of[shift:]]
        return out


def _padded(chains: list[np.ndarray], fill: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(c) for c in chains])
    out = np.full((len(chains), size.max()), fill)
    for i, c in enumerate(chains):
        out[i, : len(c)] = c
    return out, np.arange(size.max())[None, :] < size[:, None]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def train(table: Iterable[tuple[str, list[tuple[int, int, str]]]], penalty: float = 0.02, steps: int = 250, rate: float = 0.15) -> Field:
    """table: texts with their spans (start, end, kind). All rows are used; the gradient runs on the driver, so the table
    is meant to be small (some thousand lines)."""
    texts = [(re.sub(r"[\r\n]", " ", text), spans) for text, spans in table]
    kinds = sorted({k for _, spans in texts for _, _, k in spans})
    model = Field(["", *kinds])
    tokens = [[BREAK, BREAK, *TOKEN.findall(text), BREAK, BREAK] for text, _ in texts]
    words = Counter(t.lower() for line in tokens for t in line)
    model.spellings = {w for w, n in words.items() if n >= 2 and not any(c.isdigit() for c in w)}
    ends = Counter(w[-3:] for w in words if len(w) > 4 and w.isalpha())
    model.endings = {e for e, n in ends.items() if n >= 2}
    for line in tokens:
        for t in line:
            for f in model.features(t):
                model.names.setdefault(f, len(model.names))
    truth = []
    for (text, spans), line in zip(texts, tokens):
        own = [0, 0]
        for m in TOKEN.finditer(text):
            own.append(next((1 + kinds.index(k) for a, b, k in spans if a <= m.start() < b), 0))
        truth.append(np.array([*own, 0, 0]))
    gold, there = _padded(truth, 0)
    n, longest = gold.shape
    k, n_feats = len(model.labels), len(model.names)
    # One sparse row a token and neighbour: (place, feature of that neighbour).
    place, feature, which = [], [], []
    for i, line in enumerate(tokens):
        rows = [model.rows(model.features(t)) for t in line]
        for s, shift in enumerate(REACH):
            for j in range(len(line)):
                if 0 <= j + shift < len(line):
                    for r in rows[j + shift]:
                        place.append(i * longest + j)
                        feature.append(r)
                        which.append(s)
    place, key = np.array(place), np.array(which) * n_feats + np.array(feature)
    order = np.argsort(place, kind="stable")
    place, key = place[order], key[order]
    firsts, starts = np.unique(place, return_index=True)
    by_key = np.argsort(key, kind="stable")
    keys, key_starts = np.unique(key[by_key], return_index=True)
    w, moves = np.zeros((len(REACH) * n_feats, k)), np.zeros((k, k))
    hot = np.eye(k)[gold] * there[:, :, None]
    pairs = there[:, 1:]
    gold_moves = np.einsum("ntk,ntl,nt->kl", np.eye(k)[gold[:, :-1]], np.eye(k)[gold[:, 1:]], pairs.astype(float))
    means, squares = [np.zeros_like(w), np.zeros_like(moves)], [np.zeros_like(w), np.zeros_like(moves)]
    ends_at = there.sum(axis=1) - 1
    for step in range(1, steps + 1):
        emit = np.zeros((n * longest, k))
        emit[firsts] = np.add.reduceat(w[key], starts, axis=0)
        emit = emit.reshape(n, longest, k)
        ahead = np.zeros((n, longest, k))
        ahead[:, 0] = emit[:, 0]
        for t in range(1, longest):
            ahead[:, t] = emit[:, t] + _log_sum(ahead[:, t - 1][:, :, None] + moves[None], 1)
        back = np.zeros((n, longest, k))
        for t in range(longest - 2, -1, -1):
            after = _log_sum(moves[None] + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(there[:, t + 1, None], after, 0.0)
        total = _log_sum(ahead[np.arange(n), ends_at], 1)
        share = np.exp(ahead + back - total[:, None, None]) * there[:, :, None]
        both = np.exp(ahead[:, :-1, :, None] + moves[None, None] + (emit + back)[:, 1:, None, :] - total[:, None, None, None]) * pairs[:, :, None, None]
        wrong = (share - hot).reshape(-1, k)[place]
        grad_w = penalty * w
        grad_w[keys] += np.add.reduceat(wrong[by_key], key_starts, axis=0)
        for i, (value, grad) in enumerate(((w, grad_w), (moves, both.sum(axis=(0, 1)) - gold_moves + penalty * moves))):
            means[i] = 0.9 * means[i] + 0.1 * grad
            squares[i] = 0.99 * squares[i] + 0.01 * grad * grad
            value -= rate * (1 - step / (steps + 1)) * (means[i] / (1 - 0.9**step)) / (np.sqrt(squares[i] / (1 - 0.99**step)) + 1e-8)
    model.weights, model.moves = w.reshape(len(REACH), n_feats, k), moves.astype(np.float32)
    return model


def surely_outside(emit: np.ndarray, moves: np.ndarray, forced: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Tokens that no best path puts inside a span. The bound tightens as neighbours are found to be outside."""
    k = len(moves)
    inside = range(1, k)
    into = {False: [max(moves[a, x] - moves[a, 0] for a in range(k)) for x in inside], True: [moves[0, x] - moves[0, 0] for x in inside]}
    out_of = {False: [max(moves[x, b] - moves[0, b] for b in range(k)) for x in inside], True: [moves[x, 0] - moves[0, 0] for x in inside]}
    # What the transitions can give, by whether the token before and the one after are outside.
    most = np.array([[np.add(into[a], out_of[b]) for b in (False, True)] for a in (False, True)], emit.dtype)
    sure = forced.copy()
    left = np.flatnonzero(~forced)
    for _ in range(rounds):
        before, after = np.where(left > 0, sure[left - 1], True), np.where(left + 1 < len(sure), sure[(left + 1) % len(sure)], True)
        bound = emit[left, 1:] + most[before.astype(int), after.astype(int)]
        out = bound.max(axis=1) < emit[left, 0] - 1e-3
        if not out.any():
            break
        sure[left[out]] = True
        left = left[~out]
    return sure


def viterbi(emit: np.ndarray, moves: np.ndarray, forced: np.ndarray) -> np.ndarray:
    """Best labels of a chain whose forced tokens, the two ends among them, are outside."""
    best = np.zeros(len(emit), np.int8)
    edge = np.diff(np.concatenate(([0], ~surely_outside(emit, moves, forced), [0])).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return best
    order = np.argsort(begin - end, kind="stable")  # the longest first: those still running are a prefix
    begin, size = begin[order], (end - begin)[order]
    score, back = emit[begin] + moves[0], []
    running = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # pieces of at least so many tokens
    for t in range(1, size[0]):
        n = running[t]
        ways = score[:n, :, None] + moves[None]
        back.append(ways.argmax(axis=1).astype(np.int8))
        score[:n] = ways.max(axis=1) + emit[begin[:n] + t]
    now = (score + moves[:, 0]).argmax(axis=1).astype(np.int8)
    for t in range(size[0] - 1, -1, -1):
        n = running[t]
        best[begin[:n] + t] = now[:n]
        if t:
            now[:n] = back[t - 1][np.arange(n), now[:n]]
    return best

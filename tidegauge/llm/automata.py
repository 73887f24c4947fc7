"""Probabilistic automata inferred from labelled strings by merging compatible prefix-tree states.

The strings of a kind make a prefix tree with counts.  It is taken level by
level, largest states first: a state whose ending and continuing frequencies
agree with those of an accepted state of its level, by the Hoeffding bound and
recursively for all continuations, is merged into it; any other is accepted as a
state of its own.  As states of one level only are merged, the automaton keeps
how long the strings are and what stands where.  A state of fewer than ``LEAST``
strings proves nothing and joins the largest of its level.  From ``DEEPEST``
symbols on there is one state for all.

Symbols are character classes; within a class all characters are equally likely,
so what is compared with another model is the string of classes.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np

#: Classes of characters of a candidate: fixed by what the spans may hold.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
_CLASS = {c: i for i, chars in enumerate(CLASSES) for c in chars}
_END = len(CLASSES)
#: The first classes are letters and digits, the others single marks.
ALPHANUMERIC = 5
ALPHA = 0.05
LEAST = 8
DEEPEST = 128
#: Added to every count of a state when probabilities are taken, so that no string is impossible.
SMOOTHING = 0.5

#: Class of every byte, -1 for those outside all classes.
OF_BYTE = np.full(256, -1, np.int8)
for _chars, _number in _CLASS.items():
    OF_BYTE[ord(_chars)] = _number


def classes(text: str) -> list[int]:
    return [_CLASS[c] for c in text]


class Automaton:
    """``logs`` (state, symbol or end) and ``to`` (state, symbol); the last state holds what is deeper than ``DEEPEST``."""

    def __init__(self, logs: np.ndarray, to: np.ndarray):
        self.logs, self.to = logs, to

    def log_likelihood(self, symbols: list[int]) -> float:
        """Natural logarithm of the probability of a string of classes, its end included."""
        at, total = 0, 0.0
        for s in symbols:
            total += self.logs[at, s]
            at = self.to[at, s]
        return float(total + self.logs[at, _END])

    def log_likelihoods(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The same for all strings ``symbols[start:end]``."""
        total = np.zeros(len(starts))
        last = np.zeros(len(starts), np.int64)
        alive, at = np.arange(len(starts)), np.zeros(len(starts), np.int64)
        for depth in range(DEEPEST):
            going = starts[alive] + depth < ends[alive]
            last[alive[~going]] = at[~going]
            alive, at = alive[going], at[going]
            if not len(alive):
                break
            symbol = symbols[starts[alive] + depth]
            total[alive] += self.logs[at, symbol]
            at = self.to[at, symbol]
        if len(alive):
            # Deep symbols leave the last state only to return to it.
            deep = np.concatenate(([0.0], np.cumsum(np.where(symbols >= 0, self.logs[-1, symbols], 0.0))))
            total[alive] += deep[ends[alive]] - deep[starts[alive] + DEEPEST]
            last[alive] = at
        return total + self.logs[last, _END]

    def __len__(self) -> int:
        return len(self.logs)


def _next(strings: list[list[int]], depth: int) -> dict[int, list[list[int]]]:
    """The strings by their symbol at ``depth``, ``_END`` for those that end there."""
    out: dict[int, list[list[int]]] = defaultdict(list)
    for s in strings:
        out[s[depth] if depth < len(s) else _END].append(s)
    return out


def infer(texts: list[str], alpha: float = ALPHA, least: int = LEAST) -> Automaton:
    """The automaton of the given strings (at least one)."""
    slack = math.sqrt(0.5 * math.log(2 / alpha))

    def compatible(a: list[list[int]], b: list[list[int]], depth: int) -> bool:
        bound = slack * (1 / math.sqrt(len(a)) + 1 / math.sqrt(len(b)))
        p, q = _next(a, depth), _next(b, depth)
        for symbol in p.keys() | q.keys():
            if abs(len(p.get(symbol, ())) / len(a) - len(q.get(symbol, ())) / len(b)) > bound:
                return False
        both = [s for s in p.keys() & q.keys() if s != _END and min(len(p[s]), len(q[s])) >= least]
        return depth + 1 >= DEEPEST or all(compatible(p[s], q[s], depth + 1) for s in both)

    level = [sorted(classes(t) for t in texts)]
    logs, moves, numbers, levels = [], [], [0], []
    counted = 1
    for depth in range(DEEPEST):
        children: list[tuple[list[list[int]], list[tuple[int, int]]]] = []
        for number, strings in zip(numbers, level):
            after = _next(strings, depth)
            whole = len(strings) + SMOOTHING * (_END + 1)
            logs.append([math.log((len(after.get(s, ())) + SMOOTHING) / whole) for s in range(_END + 1)])
            moves.append([-1] * _END)
            children += [(group, [(number, s)]) for s, group in sorted(after.items()) if s != _END]
        levels += [depth] * len(level)
        children.sort(key=lambda c: -len(c[0]))
        accepted: list[tuple[list[list[int]], list[tuple[int, int]]]] = []
        for group, sources in children:
            match = next((a for a in accepted if len(group) >= least and compatible(a[0], group, depth + 1)), None)
            if match is None and accepted and len(group) < least:
                match = accepted[0]
            if match is None:
                accepted.append((list(group), list(sources)))
            else:
                match[0].extend(group)
                match[1].extend(sources)
        level, numbers = [], []
        for group, sources in accepted:
            for number, symbol in sources:
                moves[number][symbol] = counted
            level.append(group)
            numbers.append(counted)
            counted += 1
        if not level:
            break
    deep = [s[DEEPEST:] for group in level for s in group]
    whole = sum(len(s) + 1 for s in deep) + SMOOTHING * (_END + 1)
    ended = [math.log((sum(s.count(k) for s in deep) + SMOOTHING) / whole) for k in range(_END)]
    # The states of the level that the loop stopped at are the last one.  An unseen continuation goes to the largest state of the next level.
    final = len(logs)
    largest = [next((i for i in range(final) if levels[i] == level + 1), final) for level in levels]
    to = np.array([[unseen if t < 0 else min(t, final) for t in row] for row, unseen in zip([*moves, [final] * _END], [*largest, final])])
    return Automaton(np.array([*logs, [*ended, math.log((len(deep) + SMOOTHING) / whole)]]), to)


class Background:
    """Strings of classes by their length and by which class follows which, from counts of all candidates."""

    def __init__(self, lengths: np.ndarray, follows: np.ndarray):
        smooth = lengths + SMOOTHING
        self._lengths = np.log(smooth / smooth.sum())
        # Lengths from ``DEEPEST`` on share one count; each further symbol makes a length half as likely.
        rows = follows + SMOOTHING
        self._follows = np.log(rows / rows.sum(axis=1, keepdims=True))

    def log_likelihoods(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = ends - starts
        before = np.append(_END, symbols[:-1]).astype(np.int64)
        step = np.where((symbols >= 0) & (before >= 0), self._follows[before, symbols], 0.0)
        sums = np.concatenate(([0.0], np.cumsum(step)))
        first = self._follows[_END, symbols[starts]] if len(starts) else np.zeros(0)
        return self._lengths[np.minimum(n, DEEPEST)] - np.maximum(n - DEEPEST, 0) * math.log(2) + first + sums[ends] - sums[starts + 1]


def background_counts(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many strings have each length (capped), and how often each class follows each (``_END``: begins)."""
    lengths = np.bincount(np.minimum(ends - starts, DEEPEST), minlength=DEEPEST + 1)
    mine = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(mine, starts, 1)
    np.add.at(mine, ends, -1)
    inside = np.cumsum(mine[:-1]) > 0
    begins = np.zeros(len(symbols), bool)
    begins[starts] = True
    at = np.flatnonzero(inside)
    before = np.where(begins[at], _END, symbols[at - 1]).astype(np.int64)
    follows = np.bincount(before * _END + symbols[at], minlength=(_END + 1) * _END)
    return lengths, follows.reshape(_END + 1, _END)

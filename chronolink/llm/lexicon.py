"""A minimal acyclic word automaton whose words carry token ids.

Sorted words are added one by one; a finished suffix is replaced by an equal
state already registered, so equal suffixes are stored once. Every arc also
holds how many words come before it in its state: summed along a path this
numbers the words, and the number addresses the word's ids. The arrays lie in
one file that workers map into memory.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterable, Sequence

import numpy as np


def build(entries: Iterable[tuple[bytes, Sequence[int]]]) -> bytes:
    """Compile distinct (word, ids) pairs; words are sorted here."""
    entries = sorted((w, tuple(i)) for w, i in entries if w)
    # A state is [final, {label: state number}]; the root is 0.
    states: list[list] = [[False, {}]]
    free: list[int] = []
    register: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (state, label) of the last word's arcs that are not yet registered

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, label = path.pop()
            child = states[parent][1][label]
            key = (states[child][0], tuple(states[child][1].items()))
            same = register.setdefault(key, child)
            if same != child:
                states[parent][1][label] = same
                free.append(child)

    last = b""
    for word, _ in entries:
        if word == last:
            raise ValueError(f"word given twice: {word!r}")
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        settle(common)
        at = states[path[-1][0]][1][path[-1][1]] if path else 0
        for label in word[common:]:
            if free:
                new = free.pop()
                states[new] = [False, {}]
            else:
                new = len(states)
                states.append([False, {}])
            states[at][1][label] = new
            path.append((at, label))
            at = new
        states[at][0] = True
        last = word
    settle(0)

    number, order = {0: 0}, [0]
    for s in order:  # breadth first over the states in use
        for t in states[s][1].values():
            if t not in number:
                number[t] = len(order)
                order.append(t)
    below: dict[int, int] = {}

    def count(root: int) -> int:
        stack = [root]
        while stack:
            s = stack[-1]
            todo = [t for t in states[s][1].values() if t not in below]
            if todo:
                stack.extend(todo)
            else:
                below[s] = states[s][0] + sum(below[t] for t in states[s][1].values())
                stack.pop()
        return below[root]

    count(0)
    first, labels, targets, skips, final = [0], bytearray(), [], [], []
    for s in order:
        before = int(states[s][0])
        final.append(states[s][0])
        for label, t in states[s][1].items():
            labels.append(label)
            targets.append(number[t])
            skips.append(before)
            before += below[t]
        first.append(len(labels))
    offsets = np.cumsum([0, *(len(i) for _, i in entries)])
    ids = [x for _, i in entries for x in i]
    parts = [np.asarray(x, "<u4") for x in (first, targets, skips, offsets, ids)]
    head = np.asarray([len(p) for p in parts] + [len(final)], "<u4")
    return b"".join([head.tobytes(), *(p.tobytes() for p in parts), bytes(final), bytes(labels)])


class Lexicon:
    """Reads what ``build`` made; ``get`` returns a word's ids, or None."""

    def __init__(self, data: bytes | mmap.mmap) -> None:
        head = np.frombuffer(data, "<u4", 6).tolist()
        view, at, parts = memoryview(data), 24, []
        for n in head[:5]:
            parts.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self._first, self._targets, self._skips, self._offsets, self._ids = parts
        self._final, at = view[at : at + head[5]], at + head[5]
        self._labels, self._base = data, at
        self.n_states, self.n_arcs, self.n_words = head[5], head[1], head[3] - 1

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def get(self, word: bytes) -> list[int] | None:
        state, number, base, first, find = 0, 0, self._base, self._first, self._labels.find
        for i in range(len(word)):
            arc = find(word[i : i + 1], base + first[state], base + first[state + 1])
            if arc < 0:
                return None
            arc -= base
            number += self._skips[arc]
            state = self._targets[arc]
        if not word or not self._final[state]:
            return None
        return list(self._ids[self._offsets[number] : self._offsets[number + 1]])

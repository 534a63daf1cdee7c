"""A minimal acyclic transducer from frequent words to token ids, in one file that is memory-mapped."""

from __future__ import annotations

import mmap

import numpy as np


def _minimal(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool], int]:
    """States of the minimal acyclic automaton of sorted distinct words: transitions, finality, start.

    Words are added in order; what a new word no longer shares with the one before is finished, and a
    finished state equal to an earlier one is replaced by it, so common endings are stored once.
    """
    edges, final, register = [{}], [False], {}
    path, before = [0], b""
    free: list[int] = []

    def finish(down_to: int) -> None:
        while len(path) > down_to + 1:
            state = path.pop()
            key = (final[state], tuple(edges[state].items()))
            twin = register.setdefault(key, state)
            if twin != state:
                edges[path[-1]][before[len(path) - 1]] = twin
                free.append(state)

    for word in words:
        shared = 0
        while shared < min(len(word), len(before)) and word[shared] == before[shared]:
            shared += 1
        finish(shared)
        for byte in word[shared:]:
            if free:
                state = free.pop()
                edges[state], final[state] = {}, False
            else:
                state = len(edges)
                edges.append({})
                final.append(False)
            edges[path[-1]][byte] = state
            path.append(state)
        final[path[-1]] = True
        before = word
    finish(0)
    return edges, final, path[0]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The file's content. A transition's output is the number of words that sort before those behind it
    from its state; the outputs along a word add up to its place in the table of id sequences."""
    words = sorted(entries)
    edges, final, start = _minimal(words)
    order, number, stack = [], {}, [start]
    while stack:  # states reachable, numbered
        s = stack.pop()
        if s not in number:
            number[s] = len(order)
            order.append(s)
            stack.extend(edges[s].values())
    size: dict[int, int] = {}
    work = [(start, False)]
    while work:  # words accepted from each state, children first
        s, ready = work.pop()
        if s in size:
            continue
        if ready:
            size[s] = final[s] + sum(size[t] for t in edges[s].values())
        else:
            work.append((s, True))
            work.extend((t, False) for t in edges[s].values() if t not in size)
    keys, targets, outputs = [], [], []
    for s in order:
        ahead = int(final[s])
        for byte, t in sorted(edges[s].items()):
            keys.append(number[s] * 256 + byte)
            targets.append(number[t])
            outputs.append(ahead)
            ahead += size[t]
    ids = [entries[w] for w in words]
    arrays = [
        np.array(keys, np.int64), np.array(targets, np.int64), np.array(outputs, np.int64), np.array([final[s] for s in order], np.int64),
        np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int64), np.array([i for x in ids for i in x], np.int64),
    ]
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """Looks words up in a memory-mapped file of ``compile_lexicon``; many words take each step together."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(data, np.int64, 6)
        parts, at = [], 48
        for n in sizes:
            parts.append(np.frombuffer(data, np.int64, n, at))
            at += 8 * int(n)
        self.keys, self.targets, self.outputs, self.final, self.starts, self.ids = parts

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the table of id sequences, -1 for an unknown one."""
        place = np.full(len(words), -1, np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        if not len(words) or not len(self.keys):
            return place
        starts = np.append(0, np.cumsum(lengths))[:-1]
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        live, state, total = np.flatnonzero(lengths > 0), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            key = state[live] * 256 + text[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at = live[ok], at[ok]
            state[live] = self.targets[at]
            total[live] += self.outputs[at]
            step += 1
            ended = lengths[live] == step
            done = live[ended]
            place[done] = np.where(self.final[state[done]] == 1, total[done], -1)
            live = live[~ended]
        return place

    def sequence(self, place: int) -> list[int]:
        return self.ids[self.starts[place] : self.starts[place + 1]].tolist()

"""Count transducers: acyclic automata whose paths are n-grams of words and whose last arcs hold counts."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np


def flat(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (n of them), one after another."""
    at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    return np.arange(at[-1]) + np.repeat(start - at[:-1], n)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, once each, with the sums of their counts."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first)


def _small(x: np.ndarray) -> bytes:
    """Numbers from 0 in the least of 1, 2, 4 or 8 bytes that holds them all."""
    most = int(x.max()) if len(x) else 0
    code = next(c for c, top in zip("BHIQ", (1 << 8, 1 << 16, 1 << 32, 1 << 64), strict=True) if most < top)
    return struct.pack("<cQ", code.encode(), len(x)) + x.astype(f"<{code}").tobytes()


class Transducer:
    """An automaton of n-grams of one length over ``words`` (in order).

    ``levels[d]`` has the states after d words: where the arcs of each begin, the arcs' words, and the states they lead to
    or, at the last level, their counts. Arcs of a state are in order of their words, so paths are in order.
    """

    def __init__(self, words: list[bytes], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.words, self.levels = words, levels

    @classmethod
    def build(cls, words: list[bytes], grams: np.ndarray, counts: np.ndarray) -> Transducer:
        """From n-grams in order (rows of indices of ``words``), once each.

        A state is closed when the n-grams go on from another prefix; one with the same arcs as
        a state closed before is that state, so what follows many prefixes alike is kept once.
        """
        levels = []
        labels, values, prefix = grams[:, -1], counts, grams[:, :-1]
        for depth in range(grams.shape[1] - 1, -1, -1):
            new = np.ones(len(prefix), bool)
            new[1:] = (prefix[1:] != prefix[:-1]).any(1)
            first = np.flatnonzero(new)
            ends = np.append(first[1:], len(prefix))
            pair = np.stack([labels, values], 1).astype("<i8")
            register: dict[bytes, int] = {}
            state, kept = np.empty(len(first), np.int64), []
            for k, (s, e) in enumerate(zip(first.tolist(), ends.tolist(), strict=True)):
                arcs = pair[s:e].tobytes()
                at = register.get(arcs)
                if at is None:
                    at = register[arcs] = len(register)
                    kept.append(k)
                state[k] = at
            size = (ends - first)[kept]
            own = flat(first[kept], size)
            levels.append((np.concatenate([[0], np.cumsum(size)]).astype(np.int64), labels[own], values[own]))
            if depth:
                labels, values, prefix = prefix[first, -1], state, prefix[first, :-1]
        return cls(words, levels[::-1])

    @classmethod
    def of(cls, words: list[bytes], grams: np.ndarray, counts: np.ndarray) -> Transducer:
        """As ``build``, from n-grams that use some of ``words``."""
        used, own = np.unique(grams, return_inverse=True)
        return cls.build([words[i] for i in used.tolist()], own.reshape(grams.shape).astype(np.int64), counts.astype(np.int64))

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams in order and their counts."""
        state = np.zeros(1 if len(self.levels[0][0]) > 1 else 0, np.int64)
        columns: list[np.ndarray] = []
        for at, labels, values in self.levels:
            n = at[state + 1] - at[state]
            arcs = flat(at[state], n)
            columns = [np.repeat(c, n) for c in columns] + [labels[arcs]]
            state = values[arcs]
        return np.stack(columns, 1), state

    def compose(self, asked: Transducer) -> np.ndarray:
        """The count of each path of ``asked``, in its order, 0 where there is none: both are walked at once, word by word."""
        known = {w: i for i, w in enumerate(self.words)}
        mine = np.array([known.get(w, -1) for w in asked.words], np.int64)
        live = len(self.levels[0][0]) > 1
        at_asked = np.zeros(1 if len(asked.levels[0][0]) > 1 else 0, np.int64)
        at_own = np.full(len(at_asked), 0 if live else -1, np.int64)
        wide = max(1, len(self.words))
        for (at, labels, values), (to_at, to_labels, to_values) in zip(asked.levels, self.levels, strict=True):
            n = at[at_asked + 1] - at[at_asked]
            arcs = flat(at[at_asked], n)
            own, label = np.repeat(at_own, n), mine[labels[arcs]]
            keys = np.repeat(np.arange(len(to_at) - 1), np.diff(to_at)) * wide + to_labels
            want = np.where((own >= 0) & (label >= 0), own * wide + label, -1)
            found = np.searchsorted(keys, want)
            hit = (want >= 0) & (found < len(keys))
            hit[hit] = keys[found[hit]] == want[hit]
            at_asked, at_own = values[arcs], np.full(len(arcs), -1, np.int64)
            at_own[hit] = to_values[found[hit]]
        return np.maximum(at_own, 0)

    def to_bytes(self) -> bytes:
        out = [struct.pack("<B", len(self.levels)), _small(np.array([len(w) for w in self.words], np.int64)), b"".join(self.words)]
        for at, labels, values in self.levels:
            out += [_small(np.diff(at)), _small(labels), _small(values)]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        depth, place = data[0], 1

        def numbers() -> np.ndarray:
            nonlocal place
            code, n = struct.unpack_from("<cQ", data, place)
            kind = np.dtype(f"<{code.decode()}")
            out = np.frombuffer(data, kind, n, place + 9).astype(np.int64)
            place += 9 + n * kind.itemsize
            return out

        sizes = numbers()
        words = []
        for n in sizes.tolist():
            words.append(data[place : place + n])
            place += n
        return cls(words, [(np.concatenate([[0], np.cumsum(numbers())]).astype(np.int64), numbers(), numbers()) for _ in range(depth)])


def union(parts: Sequence[Transducer], least: int = 1) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, n-grams in order, counts): the paths of all, with the sums of their counts, where those are ``least`` or more."""
    words = sorted(set().union(*[p.words for p in parts]))
    place = {w: i for i, w in enumerate(words)}
    bits = max(1, (len(words) - 1).bit_length())
    depth = len(parts[0].levels)
    grams, counts = [], []
    for part in parts:
        own, n = part.paths()
        grams.append(np.array([place[w] for w in part.words], np.int64)[own])
        counts.append(n)
    every, counts = np.concatenate(grams), np.concatenate(counts)
    if bits * depth > 62:
        every, where = np.unique(every, axis=0, return_inverse=True)
        counts = summed(where.ravel(), counts)[1]
    else:
        keys = every[:, 0]
        for d in range(1, depth):
            keys = (keys << bits) | every[:, d]
        keys, counts = summed(keys, counts)
        every = np.stack([(keys >> (bits * (depth - 1 - d))) & ((1 << bits) - 1) for d in range(depth)], 1)
    stays = counts >= least
    return words, every[stays], counts[stays]

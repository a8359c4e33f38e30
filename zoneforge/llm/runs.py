"""Sorted runs that meet by range of key: places to cut them, and a merge by a tree of losers."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame

#: Keys looked at for each part: they only balance the parts.
SAMPLE = 24


def splitters(blocks: DataFrame, columns: Sequence[str], parts: int, seed: int = 11) -> list[tuple]:
    """At most ``parts - 1`` keys that part the first keys of blocks of one size evenly, from about SAMPLE * parts of them."""
    n = blocks.count()
    share = min(1.0, SAMPLE * parts / max(1, n))
    rows = blocks.select(*columns) if share == 1 else blocks.select(*columns).sample(share, seed)
    keys = sorted({tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in rows.collect()})
    return sorted({keys[len(keys) * k // parts] for k in range(1, parts)} - {keys[0]}) if keys else []


class LoserTree:
    """Items of ``k`` sorted runs in order: each inner node keeps the loser of its match, so a new item plays against one
    loser a level on its way up. Equal keys come by number of the run."""

    _END = (1,)

    def __init__(self, runs: Iterable[Iterable], key=lambda item: item):
        self.runs, self.key = [iter(r) for r in runs], key
        k = self.k = len(self.runs)
        self.items: list = [None] * k
        self.heads: list[tuple] = [self._END] * k
        for i in range(k):
            self._advance(i)
        winners = [0] * k + list(range(k))
        self.losers = [0] * max(1, k)
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.heads[a] < self.heads[b] else (b, a)
        self.winner = winners[1] if k > 1 else 0

    def _advance(self, i: int) -> None:
        for item in self.runs[i]:
            self.items[i], self.heads[i] = item, (0, self.key(item), i)
            return
        self.heads[i] = self._END

    def __iter__(self) -> Iterator:
        heads, losers = self.heads, self.losers
        while self.k and heads[self.winner] is not self._END:
            best = self.winner
            yield self.items[best]
            self._advance(best)
            node = (self.k + best) >> 1
            while node:
                if heads[losers[node]] < heads[best]:
                    best, losers[node] = losers[node], best
                node >>= 1
            self.winner = best


def merged(blocks: Iterable[tuple[tuple, list]], key, fan: int = 64) -> Iterator[list]:
    """Items of blocks (first key, sorted items) that come in order of their first keys, in order.

    As no later item is below the first key of the next block, what is below it goes out; so no more is held than the
    blocks that overlap there, however many runs they are from. At least ``fan`` blocks are merged at a time.
    """
    left: list = []
    held: list[list] = []
    waiting = 0
    for first, items in blocks:
        if len(held) >= fan and waiting >= len(left):
            out = list(LoserTree([left, *held], key))
            at = bisect_left(out, first, key=key)
            if at:
                yield out[:at]
            left, held, waiting = out[at:], [], 0
        held.append(items)
        waiting += len(items)
    out = list(LoserTree([left, *held], key))
    if out:
        yield out

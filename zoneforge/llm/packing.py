"""Best-fit packing by bin completion with branch and bound."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zoneforge.llm.common import configure, materialize, restored, texts, trim
from zoneforge.llm.tokens import encoder as encoder_of

#: Tokens of a sequence, id after each document, tokenizer.
CAPACITY, END, TOKENIZER = 2048, 0, "byte_bpe_50k.json"
#: Nodes of the search; steps of an enumeration that count as a node.
NODES, STEPS = 2000, 600

#: A filling: lengths, largest first, and how many bins are filled so.
Pattern = tuple[tuple[int, ...], int]


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit of a histogram of lengths, largest first, for all documents of one length at once."""
    open_bins: dict[int, list[list]] = {}
    rooms: list[int] = []
    full: list[Pattern] = []
    lengths = np.flatnonzero(counts).tolist()
    least = lengths[0] if lengths else 0

    def put(room: int, filling: tuple[int, ...], n: int) -> None:
        if room < least:
            full.append((filling, n))
        elif room in open_bins:
            open_bins[room].append([filling, n])
        else:
            open_bins[room] = [[filling, n]]
            insort(rooms, room)

    for size in reversed(lengths):
        left = int(counts[size])
        while left and (at := bisect_left(rooms, size)) < len(rooms):
            room = rooms.pop(at)
            groups = open_bins.pop(room)
            while groups and left:
                filling, n = groups.pop()
                k = room // size
                whole = min(n, left // k)
                if whole:
                    put(room - k * size, filling + (size,) * k, whole)
                    left, n = left - whole * k, n - whole
                if n and left:
                    put(room - left * size, filling + (size,) * left, 1)
                    left, n = 0, n - 1
                if n:
                    groups.append([filling, n])
            if groups:
                open_bins[room] = groups
                insort(rooms, room)
        if left:
            k = capacity // size
            if left // k:
                put(capacity - k * size, (size,) * k, left // k)
            if left % k:
                put(capacity - left % k * size, (size,) * (left % k), 1)
    return full + [(f, n) for groups in open_bins.values() for f, n in groups]


def bins(patterns: list[Pattern]) -> int:
    return sum(n for _, n in patterns)


def waste_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that no packing goes below: the sum, and what the room beside large documents must waste.

    Documents of over half a bin are walked from the largest; the room each leaves can only
    take documents that are small enough; small ones not yet used fill it, and the rest of it is waste.
    Used up to one is the least of room so far and of what fits, so a running minimum gives it.
    """
    held = counts * np.arange(len(counts))
    total = int(held.sum())
    if not total:
        return 0
    sizes = np.arange(len(counts) - 1, capacity // 2, -1)
    room = np.cumsum((capacity - sizes) * counts[sizes])
    fit = np.cumsum(held)[capacity - sizes]
    waste = max(0, int((room - fit).max())) if len(sizes) else 0
    return -(-(total + waste) // capacity)


def fillings(counts: np.ndarray, room: int, steps: int = STEPS) -> Iterator[tuple[int, ...] | None]:
    """All undominated fillings of ``room``: those of the first ``steps`` steps by least waste, then the others as they are found.

    One is dominated if a document left out could take the place of one or two
    of its documents without leaving the room, or would still fit. None stands for ``steps`` more steps.
    """
    present = np.flatnonzero(counts[: room + 1]).tolist()
    if not present:
        yield ()
        return
    have = {size: int(counts[size]) for size in present}

    def largest(most: int, taken: tuple[int, ...]) -> int:
        at = bisect_right(present, most) - 1
        while at >= 0 and have[present[at]] <= taken.count(present[at]):
            at -= 1
        return present[at] if at >= 0 else 0

    def dominated(taken: tuple[int, ...], slack: int) -> bool:
        if slack and largest(slack, taken):
            return True
        for i, a in enumerate(taken):
            if i and a == taken[i - 1]:
                continue
            if largest(a + slack, taken) > a:
                return True
            for b in sorted(set(taken[i + 1 :])):
                if largest(a + b + slack, taken) >= a + b:
                    return True
        return False

    def walk() -> Iterator[tuple[int, tuple[int, ...]] | None]:
        done, stack = 0, [[room, len(present) - 1, (), False]]
        while stack:
            left, at, taken, moved = top = stack[-1]
            while at >= 0 and have[present[at]] <= taken.count(present[at]):
                at -= 1
            if at < 0:
                stack.pop()
                if not moved and not dominated(taken, left):
                    yield left, taken
                continue
            size = present[at]
            top[1], top[3] = at - 1, True
            stack.append([left - size, bisect_right(present, min(left - size, size)) - 1, (*taken, size), False])
            done += 1
            if done % steps == 0:
                yield None

    more = walk()
    found = list(iter(lambda: next(more, None), None))
    if not found:
        taken, left = (), room
        while size := largest(left, taken):
            taken, left = (*taken, size), left - size
        found.append((left, taken))
    yield from (t for _, t in sorted(found, key=lambda x: (x[0], len(x[1]), x[1])))
    yield from (x and x[1] for x in more)


def pack(counts: np.ndarray, capacity: int, nodes: int = NODES) -> list[Pattern]:
    """Patterns of a packing of a histogram of lengths: (lengths of a bin, number of such bins).

    Depth-first: bins are filled around the largest document left, by each of
    its undominated fillings, used as often as the counts allow and then ever less often (what is left of
    the largest then goes by other fillings); a branch ends when the waste bound says it can't beat
    the incumbent. The best fit of what is left makes an incumbent at each node, the
    first being best fit alone. The search is exact if it ends, and stops at the bound or after
    ``nodes`` nodes; fillings are made as it comes to them, and ``STEPS`` steps of making them count as a node.
    The histogram has ``capacity`` entries, however many documents there are.
    """
    counts = counts.astype(np.int64)
    best = best_fit(counts, capacity)
    most = bins(best)
    floor = waste_bound(counts, capacity)

    def branches(left: np.ndarray, done: list[Pattern], n: int, size: int) -> Iterator[tuple[np.ndarray, list[Pattern], int] | None]:
        rest = left.copy()
        rest[size] -= 1
        for filling in fillings(rest, capacity - size):
            if filling is None:
                yield None
                continue
            pattern = (size, *filling)
            if done and done[-1][0] == pattern:
                continue
            need = Counter(pattern)
            kinds, times = np.array([*need]), np.array([*need.values()])
            for k in range(int((left[kinds] // times).min()), 0, -1):
                after = left.copy()
                after[kinds] -= k * times
                yield after, [*done, (pattern, k)], n + k

    over = object()
    stack = [iter([(counts, [], 0)])]
    while stack and nodes > 0 and most > floor:
        node = next(stack[-1], over)
        if node is over:
            stack.pop()
            continue
        nodes -= 1
        if node is None:
            continue
        left, done, n = node
        here = np.flatnonzero(left)
        if not len(here):
            if n < most:
                best, most = done, n
            continue
        if n + waste_bound(left, capacity) >= most:
            continue
        if done:
            rest = best_fit(left, capacity)
            if n + bins(rest) < most:
                best, most = done + rest, n + bins(rest)
        stack.append(branches(left, done, n, int(here[-1])))
    return best


def places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank from, rank before, first bin, documents of the length in a bin, offset of the first)."""
    out, ranks, first = [], {}, 0
    for filling, n in patterns:
        at = 0
        for size in sorted(set(filling), reverse=True):
            k = filling.count(size)
            low = ranks.get(size, 0)
            ranks[size] = low + k * n
            out.append((size, low, low + k * n, first, k, at))
            at += k * size
        first += n
    return out


def cut(docs: DataFrame, capacity: int, tokenizer: str, end: int) -> DataFrame:
    """Pieces of each document: doc_id, piece, start, length, ids_crc32; and task, rank (of equal lengths in the task).

    A document longer than ``capacity`` is cut into pieces of that length, but for a shorter first one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = encoder_of(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids += tail
                n = len(ids) // 4
                at = 0
                for piece, stop in enumerate(range((n - 1) % capacity + 1, n + 1, capacity)):
                    length = stop - at
                    rows.append((doc, piece, at, length, zlib.crc32(ids[4 * at : 4 * stop]), seen[length]))
                    seen[length] += 1
                    at = stop
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(rows), task, np.int32))], [*names, "task"])
        trim()

    return texts(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, task int")


def placed(ranked: DataFrame, patterns: list[Pattern], capacity: int) -> DataFrame:
    """``ranked`` (doc_id, piece, start, length, ids_crc32, rank) with sequence_id and offset for rank.

    The table of places has a row for each pattern and length: best fit makes at most four
    patterns a length and the search replaces some, a pattern has under 64 different lengths (their sum
    is at most ``capacity``), so it stays under 32 MB whatever the corpus. A piece finds its row by bisection.
    """
    table = np.array(sorted(places(patterns)), np.int64).reshape(-1, 6)
    shared = ranked.sparkSession.sparkContext.broadcast((table[:, 0] << 44 | table[:, 1], table[:, 1:].copy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = shared.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            low, _, first, k, at = rows[np.searchsorted(keys, length << 44 | rank, side="right") - 1].T
            own = rank - low
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(first + own // k), pa.array(at + own % k * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only the histogram of lengths (``capacity`` numbers) reaches the driver,
    where the search runs. A piece takes the place that the packing has for
    (length, rank): ranks are counted within tasks and shifted by the counts of
    earlier tasks, so a length that a third of all pieces share is no hot group. A null text
    is empty and is its end id alone; a null doc_id stays null. An empty table gives no rows; extra columns
    are ignored; each of repeated rows is packed.
    """
    spark = configure(docs.sparkSession)
    rows = materialize(cut(docs, capacity, tokenizer, end), "pieces")
    per_task = rows.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    per_task = materialize(per_task.select("length", "task", "n", F.coalesce(before, F.lit(0)).alias("base")), "ranks")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in per_task.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    ranked = rows.join(per_task.drop("n"), ["length", "task"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    return restored(placed(ranked, pack(counts, capacity), capacity))

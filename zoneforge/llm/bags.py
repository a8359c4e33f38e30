"""Texts as bags of hashed features, and slices of a corpus that a task trains on."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneforge.llm.common import NULL_ID, lean
from zoneforge.llm.words import bounds, mix, raw, word_hashes

#: Bits of a hashed feature; features of a word are itself and its first bytes, for stems that take many endings.
FEATURE_BITS, PREFIXES = 18, (5, 7)
#: Bits of the slots of the table of how often keys occur (16 MB); parts that counts of features are added up in.
SLOT_BITS, PARTS = 22, 16
SIZE = 1 << FEATURE_BITS
#: Bytes of text whose words are hashed at a time: each takes some thirty times as many in between.
PIECE = 1 << 20

_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[0x41:0x5B] = _NOT_LETTER[0x61:0x7B] = _NOT_LETTER[0x80:] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_ORDERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def features(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs of a batch, in order; only ``wanted`` features if given."""
    data, at = raw(column.cast(pa.string()) if pa.types.is_null(column.type) else column)
    found, low = [np.zeros(0, np.int64)], 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(at, at[low] + PIECE, side="right")) - 1)
        found.append(_pairs(_FOLD[data[at[low] : at[high]]], at[low : high + 1] - at[low], wanted) + (low << FEATURE_BITS))
        low = high
    pairs = np.concatenate(found)
    return pairs >> FEATURE_BITS, pairs & (SIZE - 1)


def _pairs(data: np.ndarray, at: np.ndarray, wanted: np.ndarray | None) -> np.ndarray:
    first, end, doc = bounds(data, at, _NOT_LETTER)
    found = []
    for seed, stop in [(0, end)] + [(k, np.minimum(end, first + k)) for k in PREFIXES]:
        feature = (word_hashes(data, first, stop, seed) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
        keep = slice(None) if wanted is None else wanted[feature]
        found.append(doc[keep] << FEATURE_BITS | feature[keep])
    return np.unique(np.concatenate(found))


def keys(doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit keys a document, each of the least features by two orders; texts much alike share one. Zero without features."""
    out = np.zeros((n, 2), np.uint64)
    if len(doc):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        least = [np.minimum.reduceat(mix((feature.astype(np.uint64) + np.uint64(1)) * a), first) for a in _ORDERS]
        out[doc[first]] = np.stack([mix(least[0] + least[1] * _ORDERS[1]), mix(least[2] + least[3] * _ORDERS[3])], axis=1)
    return out


def fresh(found: np.ndarray, seen: set[int]) -> np.ndarray:
    """Rows of keys that share none with an earlier row or with ``seen``, which grows; copies would make chance words look telling."""
    out = np.zeros(len(found), bool)
    for i, (a, b) in enumerate(found.tolist()):
        out[i] = (a or b) and a not in seen and b not in seen
        seen.update((a, b))
    return out


def lists(doc: np.ndarray, feature: np.ndarray, n: int) -> pa.Array:
    cut = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut), pa.array(feature.astype(np.int32)))


def _slots(found: np.ndarray) -> np.ndarray:
    """Places of both keys of each document in the table of how often keys occur."""
    return (mix(found + np.array([0, 1], np.uint64)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _occurrences(rows: DataFrame) -> np.ndarray:
    """How many documents have a key in each slot; the table is of one size for every corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, feature = features(batch.column(0))
            found = keys(doc, feature, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(_slots(found[found.any(1)]).ravel())], ["slot"])

    found = rows.select("text").mapInArrow(lean(run), "slot long").groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1").toArrow()
    table = np.ones(1 << SLOT_BITS, np.uint32)
    table[found["slot"].to_numpy()] = found["n"].to_numpy()
    return table


def frequencies(rows: DataFrame) -> tuple[np.ndarray, float, int]:
    """(documents that each feature is in, documents counted, rows) over all ``rows`` (doc_id, text).

    Texts that are much alike share keys, and a key's documents count as one half, each for its part: so copies don't make chance
    words look telling, and counts hang on the rows alone, not on how they are dealt. How often keys occur is a table of 2^SLOT_BITS
    numbers; keys of one slot share as well. Parts are whole numbers of 2^-20, so sums are exact, in any order.
    """
    shared = rows.sparkSession.sparkContext.broadcast(_occurrences(rows))
    names, width = ["part", "data"], SIZE // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, every, docs = np.zeros(SIZE), 0, 0
        for batch in batches:
            doc, feature = features(batch.column(0))
            found = keys(doc, feature, batch.num_rows)
            share = np.where(found.any(1), np.rint((1 << 19) / shared.value[_slots(found)]).sum(1), 0)
            total += np.bincount(feature, share[doc], SIZE)
            every, docs = every + batch.num_rows, docs + int(share.sum())
        parts = [zlib.compress(x.astype("<i8").tobytes(), 1) for x in [*total.reshape(PARTS, width), np.array([docs, every])]]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS + 1), pa.int32()), pa.array(parts, pa.binary())], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(data), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], names)

    counted = rows.select("text").mapInArrow(lean(count), "part int, data binary").repartition(PARTS, "part").mapInArrow(add, "part int, data binary").toArrow()
    sums = {part: np.frombuffer(data, "<i8") for part, data in zip(counted["part"].to_pylist(), counted["data"].to_pylist(), strict=True)}
    if not sums:
        return np.zeros(SIZE), 0.0, 0
    docs, every = sums.pop(PARTS).tolist()
    return np.concatenate([sums[k] for k in range(PARTS)]) / (1 << 20), docs / (1 << 20), every


def bagged(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text, ...) with keys and all features in place of the text, for a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, feature = features(batch.column(1))
            found = keys(doc, feature, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(list(found), pa.list_(pa.int64())), lists(doc, feature, batch.num_rows)], [batch.schema.names[0], *batch.schema.names[2:], "keys", "features"])

    more = "".join(f", {c} {kind}" for c, kind in rows.dtypes[2:])
    return rows.mapInArrow(lean(run), f"doc_id long{more}, keys array<long>, features array<int>")


def counted(sample: DataFrame, ids: list[int]) -> np.ndarray:
    """How many rows of a bagged sample with one of ``ids`` each feature is in."""
    out = np.zeros(SIZE, np.int64)
    if ids:
        chosen = F.broadcast(sample.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long"))
        found = sample.join(chosen, "doc_id", "left_semi").select(F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).toArrow()
        out[found["f"].to_numpy()] = found["n"].to_numpy()
    return out


def narrowed(sample: DataFrame, place: np.ndarray) -> DataFrame:
    """A bagged sample with its features as places, those of place -1 left out."""
    shared = sample.sparkSession.sparkContext.broadcast(place)
    at = sample.columns.index("features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [found[found >= 0] for x in batch.column(at) for found in [shared.value[np.asarray(x.as_py(), np.int64)]]]
            columns = list(batch.columns)
            columns[at] = pa.array(own, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return sample.mapInArrow(run, sample.schema)


def sliced(rows: DataFrame, total: int, size: int, *values: str) -> DataFrame:
    """(slice, ``values``, n): rows dealt by doc_id to slices of about ``size``, equal ones of a slice as one with their number.

    Rows without an id are dealt by their values, so they are no hot slice unless they are equal, and then they are one row.
    """
    slices = max(1, -(-total // size))
    spread = F.when(F.col("doc_id") == NULL_ID, F.xxhash64(*values)).otherwise(F.xxhash64("doc_id", F.lit(5)))
    return rows.withColumn("slice", F.pmod(spread, F.lit(slices))).groupBy("slice", *values).agg(F.count(F.lit(1)).alias("n"))


def averaged(found: DataFrame) -> np.ndarray:
    """Means by place of ``weights`` (an array of one length, a row a slice)."""
    means = found.select(F.posexplode("weights").alias("at", "w")).groupBy("at").agg(F.avg("w").alias("w")).toArrow().sort_by("at")
    return means["w"].to_numpy()


@dataclass
class Bag:
    """Rows of places, flat: place and row of each entry, number of rows."""

    place: np.ndarray
    row: np.ndarray
    n: int

    @classmethod
    def of(cls, column: pa.ChunkedArray | pa.Array) -> Bag:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        count = np.asarray(column.value_lengths(), np.int64) if len(column) else np.zeros(0, np.int64)
        return cls(np.asarray(column.flatten(), np.int64), np.repeat(np.arange(len(column)), count), len(column))

    def take(self, keep: np.ndarray) -> Bag:
        """The rows that ``keep`` marks."""
        number, own = np.cumsum(keep) - 1, keep[self.row]
        return Bag(self.place[own], number[self.row[own]], int(keep.sum()))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.place], self.n)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.place, g[self.row], width)

"""Near copies by five-word shingles: MinHash candidates, confirmed by their exact similarity."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneforge.llm.common import configure, lean, materialize, sized_lookup, texts
from zoneforge.llm.words import bounds, mix, raw, windows, word_hashes
from zoneforge.operators.graph import components

#: Words of a shingle; least Jaccard similarity of near copies.
WIDTH, SIMILAR = 5, 0.8
#: Two texts at 0.8 share one band of six minima at least with probability 1 - (1 - 0.8^6)^24, over 0.999.
BANDS, ROWS = 24, 6
#: Documents of a block; a group of candidates that holds more is cut into blocks, and every pair of them compared.
BLOCK = 512
_RNG = np.random.default_rng(42)
_FACTORS, _SHIFTS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1), _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def shingles(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles, A-Z as lower case; of all its words if they are fewer; none without a word."""
    data, at = raw(column)
    data = _LOWER[data]
    first, end, doc = bounds(data, at)
    hashed = word_hashes(data, first, end)
    cuts = np.searchsorted(doc, np.arange(len(column) + 1))
    return [np.unique(mix(windows(hashed[a:b], min(width, b - a)))) if b > a else np.zeros(0, np.uint64) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def minima(own: np.ndarray) -> np.ndarray:
    """The least of a text's shingles by each of the orders."""
    with np.errstate(over="ignore"):
        return np.array([(own * a + b).min() for a, b in zip(_FACTORS, _SHIFTS, strict=True)], np.uint64)


def buckets(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of a text's minima."""
    with np.errstate(over="ignore"):
        key = np.arange(BANDS, dtype=np.uint64)
        for row in least.reshape(BANDS, ROWS).T:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def forest(sets: list[np.ndarray], side: list[int] | None, least: float = SIMILAR) -> list[tuple[int, int]]:
    """Links that join all similar texts of one bucket (of different sides, if given): a spanning forest, not all pairs.

    A pair is compared by its shingles only if it isn't joined yet and shares minima enough: of a pair
    at ``least`` the share is below ``least`` - 0.18 once in over a million (five standard errors of 144 draws).
    """
    n = len(sets)
    label, found, links = np.arange(n), defaultdict(list), []
    own = np.array([minima(x) if len(x) else np.zeros(BANDS * ROWS, np.uint64) for x in sets]).reshape(n, BANDS * ROWS)
    for i, x in enumerate(sets):
        if len(x):
            for key in buckets(own[i]).tolist():
                found[key].append(i)
    sides, tried = np.array(side) if side else None, np.zeros((n, n), bool)
    for members in found.values():
        rest = np.array(members)
        while len(rest) > 1:
            i, rest = rest[0], rest[1:]
            open_ = rest[(label[rest] != label[i]) & ~tried[i, rest]]
            if sides is not None:
                open_ = open_[sides[open_] != sides[i]]
            if not len(open_):
                continue
            tried[i, open_] = True
            for j in open_[(own[open_] == own[i]).mean(axis=1) >= least - 0.18].tolist():
                if label[i] != label[j] and similar(sets[i], sets[j], least):
                    label[label == label[j]] = label[i]
                    links.append((int(i), j))
    return links


def near_copies(docs: DataFrame, least: float = SIMILAR, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """doc_id of each document but the least of its component; links are texts of ``least`` Jaccard similarity or more.

    Texts that share a bucket are joined to its first; only documents so joined travel with
    their texts. Each component of these is compared in blocks, all pairs of its blocks by tasks of their own,
    and only pairs of one bucket at that. Texts without words are nobody's copies. An empty table gives no rows;
    extra columns are ignored; a doc_id stands for one text; rows of a null doc_id are left out of the comparison.
    """
    configure(docs.sparkSession)
    bodies = texts(docs.where("doc_id is not null"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [buckets(minima(own)).view(np.int64) if len(own) else [] for own in shingles(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "buckets"])

    rows = bodies.mapInArrow(lean(prints), "doc_id long, buckets array<long>").select("doc_id", F.explode("buckets").alias("bucket"))
    rows = materialize(rows, "buckets")
    groups = rows.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = materialize(groups, "shared")
    edges = sized_lookup(rows, groups, "bucket", "n", max(1, rows.count()))
    edges = materialize(edges.where("first <> doc_id").select(F.col("first").alias("src"), F.col("doc_id").alias("dst")).distinct(), "candidates")
    if edges.isEmpty():
        return edges.select(F.col("src").alias("doc_id"))
    joined = components(edges)
    sizes = joined.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"))
    joined = sized_lookup(joined, materialize(sizes, "sizes"), "root", "n", max(1, joined.count()))
    joined = joined.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    joined = joined.select(F.col("node").alias("doc_id"), "root", "mine", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"))
    pairs = bodies.where("text is not null").join(joined, "doc_id")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        side = frame["mine"].tolist() if frame["a"].iat[0] != frame["b"].iat[0] else None
        ids = frame["doc_id"].to_numpy()
        found = np.array(forest(shingles(pa.array(frame["text"], pa.string()), width), side, least), np.int64).reshape(-1, 2)
        return pd.DataFrame({"src": ids[found[:, 0]], "dst": ids[found[:, 1]]})

    links = materialize(pairs.groupBy("root", "a", "b").applyInPandas(compare, "src long, dst long"), "confirmed")
    if links.isEmpty():
        return links.select(F.col("src").alias("doc_id"))
    labels = components(links)
    kept = labels.groupBy("root").agg(F.min("node").alias("node"))
    return labels.join(kept, "node", "left_anti").select(F.col("node").alias("doc_id"))

"""Connected components as rounds of contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from zoneforge.functions.storage import materialize


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, of edges between nodes 0 to n - 1: ends hook to lesser roots, paths are halved."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, root[a], root[b])
        np.minimum.at(root, root[b], root[a])
        while (again := root[root]).tobytes() != root.tobytes():
            root = again
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _finished(edges: DataFrame) -> DataFrame:
    """(at, to): roots of a graph of few edges, found in one task."""
    schema = StructType().add("at", edges.schema["u"].dataType).add("to", edges.schema["u"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        ends = pa.chunked_array([b.column(k) for k in (0, 1) for b in held]).combine_chunks().dictionary_encode()
        place, half = ends.indices.to_numpy().astype(np.int64), len(ends) // 2
        root = roots(place[:half], place[half:], len(ends.dictionary))
        for k in range(0, len(root), 10_000):
            yield pa.RecordBatch.from_arrays([ends.dictionary[k : k + 10_000], ends.dictionary.take(pa.array(root[k : k + 10_000]))], ["at", "to"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, schema)


def components(edges: DataFrame, src: str = "src", dst: str = "dst", few: int = 0) -> DataFrame:
    """``(node, root)`` for every node that an edge names.

    Each round every node moves to the neighbour (or itself) of least hash,
    edges follow their ends, and edges inside one node vanish. The hash changes
    by round, so ordered chains shrink by a constant factor as well, and the
    number of rounds is logarithmic in the longest path. A node of very many
    edges only meets partial aggregates (the minimum) and joins whose large
    side AQE can split. Nulls name no node; self-loops keep their node.
    Each round is written out, so lineage stays short; once ``few`` edges or fewer
    are left, one task does the rest. ``root`` is some node of the component; callers take the minimum of what they want over it.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    edges = materialize(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    level = 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(level)).alias("h"), c.alias("n"))
        moved = (
            both.groupBy("u")
            .agg(F.min(rank(F.col("v"))).alias("m"))
            .select(F.col("u").alias("at"), F.least("m", rank(F.col("u")))["n"].alias("to"))
        )
        small = few > 0 and edges.count() <= few
        moved = materialize(_finished(edges) if small else moved, "moved")
        if labels is None:
            labels = moved.select(F.col("at").alias("node"), F.col("to").alias("root"))
        else:
            labels = materialize(
                labels.join(moved, labels["root"] == moved["at"], "left").select("node", F.coalesce("to", "root").alias("root")),
                "labels",
            )
        if small:
            return labels
        one = moved.select(F.col("at").alias("u"), F.col("to").alias("a"))
        two = moved.select(F.col("at").alias("v"), F.col("to").alias("b"))
        edges = materialize(
            edges.join(one, "u").join(two, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(),
            "edges",
        )
        level += 1
        if edges.isEmpty():
            return labels

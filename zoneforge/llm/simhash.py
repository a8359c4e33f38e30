"""SimHash near-dedup with a bit-sliced comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneforge.llm.common import configure, lean, materialize, restored, sized_lookup, texts
from zoneforge.operators.graph import components

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
#: Fingerprints of a block; a bucket that holds more is cut into blocks, and every pair of them compared.
BLOCK = 2048
#: Shingles whose hashes are held at a time.
_PIECE = 1 << 16
_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)) + b"\t\n\x0b\x0c\r", bytes(range(0x61, 0x7B)) + b"     ")


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Bit i is set if over half the shingles' XXH64 have it; 0 without a word."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return 0
    body = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - width + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for i in range(0, n, _PIECE):
        hashed = b"".join([digest(body[a:b], SEED) for a, b in zip(first[i : i + _PIECE], last[i : i + _PIECE], strict=True)])
        counts += np.unpackbits(np.frombuffer(hashed, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(lean(run), "doc_id long, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: row i holds bit i of every value, 64 values a word."""
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    pad = -len(values) % 64
    if pad:
        bits = np.concatenate([bits, np.zeros((pad, BITS), np.uint8)])
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def within(block: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, np.ndarray]]:
    """Yield (query's position, positions in the block) of distances up to ``radius``.

    The block lies in bit planes. For each query, plane after plane is added to
    all lanes' distances at once by a carry-save counter (one word-wide digit a
    power of two, and a sticky digit for what passed the radius). Once every
    lane is out, the block is abandoned.
    """
    sliced = planes(block)
    digits = max(1, int(radius).bit_length())
    valid = np.zeros(sliced.shape[1] * 64, np.uint8)
    valid[: len(block)] = 1
    valid = np.packbits(valid, bitorder="little").view(np.uint64)
    every = np.uint64(0xFFFFFFFFFFFFFFFF)
    for q, value in enumerate(queries.tolist()):
        count = [np.zeros_like(valid) for _ in range(digits)]
        out = ~valid
        for bit in range(BITS):
            carry = sliced[bit] ^ every if value >> (BITS - 1 - bit) & 1 else sliced[bit]
            for d in range(digits):
                count[d], carry = count[d] ^ carry, count[d] & carry
            out = out | carry
            if bit % 8 == 7:
                over, equal = np.zeros_like(valid), ~np.zeros_like(valid)
                for d in reversed(range(digits)):
                    if radius >> d & 1:
                        equal &= count[d]
                    else:
                        over |= equal & count[d]
                        equal &= ~count[d]
                if np.all((out | over) == every):
                    break
        else:
            yield q, np.flatnonzero(np.unpackbits((~(out | over)).view(np.uint8), bitorder="little"))


def forest(left: np.ndarray, right: np.ndarray | None = None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join what is within ``radius`` in a block or across two: a spanning forest, not all pairs."""
    nodes = left if right is None else np.concatenate([left, right])
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    shift, links = 0 if right is None else len(left), []
    for q, near in within(left if right is None else right, left, radius):
        for k in near.tolist():
            a, b = root(q), root(k + shift)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(nodes[q]), int(nodes[k + shift])))
    return links


def keys(radius: int) -> list[tuple[int, ...]]:
    """Of radius + 2 parts, two at least are free of differences: the pairs of parts."""
    return list(combinations(range(radius + 2), 2))


def masks(radius: int) -> list[list[int]]:
    """By bucket key its mask, and the masks that cut a bucket further: the rest of the bits in
    radius + 2 parts in turn, of which two at least agree, so each mask has two more parts."""
    parts = radius + 2

    def cuts(bits: list[int]) -> list[list[int]]:
        edges = [round(i * len(bits) / parts) for i in range(parts + 1)]
        own = [bits[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return [own[i] + own[j] for i, j in keys(radius)]

    signed = lambda bits: (m := sum(1 << (BITS - 1 - b) for b in bits)) - (1 << 64 if m >= 1 << 63 else 0)
    out = []
    for own in cuts(list(range(BITS))):
        rest = [b for b in range(BITS) if b not in own]
        out.append([signed(own), *(signed(own + more) for more in cuts(rest))])
    return out


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(src, dst) between distinct fingerprints, joining all that differ in up to ``radius`` bits.

    Bits are cut into radius + 2 parts; two within the radius agree on two parts
    at least. So each pair of parts gives a bucket key. A bucket of more than ``block`` is cut further by
    pairs of parts of its other bits, which costs each print a few rows, not one for every block. What is still
    larger is compared in blocks, all pairs of its blocks by tasks of their own, so a bucket of
    any size stays whole and no task holds more than two blocks.
    """
    table = masks(radius)
    part = lambda no, m: F.struct(F.lit(no).alias("no"), F.col("fp").bitwiseAND(F.lit(m)).alias("part"))
    rows = prints.select("fp", F.explode(F.array(*[part(i, own[0]) for i, own in enumerate(table)])).alias("k")).select("fp", "k.no", "k.part")
    sizes = rows.groupBy("no", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = materialize(rows.join(sizes, ["no", "part"]), "bucketed")
    few = rows.where(F.col("n") <= block).select("no", "part", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("mine"), "fp")
    width = len(table[0])
    more = F.element_at(F.array(*[F.array(*[part((i + 1) * width + j, m) for j, m in enumerate(own[1:])]) for i, own in enumerate(table)]), F.col("no") + 1)
    many = rows.where(F.col("n") > block).select("fp", F.explode(more).alias("k")).select("fp", "k.no", "k.part")
    sizes = many.groupBy("no", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    many = many.join(sizes.select("no", "part", blocks.alias("blocks")), ["no", "part"])
    many = many.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("no", "part", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine", "fp")
    rows = few.unionByName(many)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        fp, mine, a, b = frame["fp"].to_numpy().view(np.uint64), frame["mine"].to_numpy(), frame["a"].iat[0], frame["b"].iat[0]
        order = np.argsort(fp)
        fp, mine = fp[order], mine[order]
        found = forest(fp, None, radius) if a == b else forest(fp[mine == a], fp[mine == b], radius)
        ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"src": ends[:, 0], "dst": ends[:, 1]})

    # small rows, dear groups: as many tasks as the session deals out, which adaptive execution would put together by bytes
    dealt = rows.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "no", "part", "a", "b")
    return dealt.groupBy("no", "part", "a", "b").applyInPandas(compare, "src long, dst long").distinct()


def near_dedup(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Words are runs outside ``[\\x20\\x09-\\x0D]`` after A-Z became lower case;
    shingles are ``width`` words, repeats included, or the whole sequence when
    shorter; a text without words (null, empty, white space) has fingerprint
    zero. Fingerprints link at ``radius`` or fewer differing bits; component_id
    is the least doc_id reachable. Equal fingerprints are one node, so copies
    cost nothing in the comparison. An empty table gives no rows; extra columns
    are ignored; rows that repeat a doc_id count as one document, of the least fingerprint; a null doc_id is an id, the least.
    """
    configure(docs.sparkSession)
    prints = fingerprints(docs, width).groupBy("doc_id").agg(F.min("fp").alias("fp"))
    prints = materialize(prints, "simhash")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
    found = materialize(links(nodes.select("fp"), radius, block), "links")
    if found.isEmpty():
        classes = nodes.select("fp", F.col("first").alias("component_id"), "n")
    else:
        marked = nodes.join(components(found), F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
        least = marked.groupBy("root").agg(F.min("first").alias("component_id"))
        classes = materialize(marked.join(least, "root").select("fp", "component_id", "n"), "classes")
    out = sized_lookup(prints, classes, "fp", "n", max(1, prints.count()))
    return restored(out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"), "doc_id", "component_id")

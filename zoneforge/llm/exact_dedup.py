"""Exact dedup by composable polynomial fingerprints."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneforge.llm.common import configure, lean, materialize, restored, sized_lookup, texts

#: Bytes of a chunk; 2**16 * 2**8 * 2**31 stays below 2**63.
CHUNK = 1 << 16
#: Primes below 2**31 and a base for each: 124 bits of fingerprint.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1566083941, 1812433253, 1664525)
#: Bytes of a text beyond which its parts are hashed by different tasks.
HUGE = 1 << 20
#: Documents that one copy of a representative's chunk is compared with.
PER_COPY = 256
_RUN = re.compile(rb"[\x20\x09-\x0D]+")


class Polynomial:
    """Fingerprints mod some primes: ``hash(a + b) = hash(a) * base**len(b) + hash(b)``."""

    def __init__(self, primes: tuple[int, ...] = PRIMES, bases: tuple[int, ...] = BASES):
        self.primes, self.bases = primes, tuple(b % p for b, p in zip(bases, primes, strict=True))
        self.modulus = np.array(primes, np.uint64)
        table = np.empty((len(primes), CHUNK), np.uint64)
        for row, (p, b) in enumerate(zip(self.primes, self.bases, strict=True)):
            done = np.ones(1, np.uint64)
            while len(done) < CHUNK:
                done = np.concatenate([done, done * np.uint64(pow(b, len(done), p)) % np.uint64(p)])
            table[row] = done[:CHUNK][::-1]
        self.table = table

    def chunk(self, data: bytes) -> tuple[int, ...]:
        x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        sums = self.table[:, CHUNK - len(x) :] @ x
        return tuple(int(v) for v in sums % self.modulus)

    def combine(self, left: tuple[int, ...], right: tuple[int, ...], right_length: int) -> tuple[int, ...]:
        return tuple((a * pow(b, right_length, p) + c) % p for a, c, b, p in zip(left, right, self.bases, self.primes, strict=True))

    def whole(self, data: bytes) -> tuple[int, ...]:
        out = (0,) * len(self.primes)
        for i in range(0, len(data), CHUNK):
            part = data[i : i + CHUNK]
            out = self.combine(out, self.chunk(part), len(part)) if i else self.chunk(part)
        return out

    def pack(self, value: tuple[int, ...]) -> bytes:
        return b"".join(v.to_bytes(4, "big") for v in value)


def normalised(text: str | None) -> bytes:
    return _RUN.sub(b" ", text.encode("utf-8", "surrogatepass")) if text else b""


def fingerprints(docs: DataFrame, primes: tuple[int, ...] = PRIMES, bases: tuple[int, ...] = BASES, huge: int = HUGE) -> DataFrame:
    """doc_id, fingerprint (4 bytes a prime), n_bytes and text_sha256 of each normalised text.

    A text of over ``huge`` bytes is cut into parts of as many, dealt to all tasks, and their hashes are combined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = Polynomial(primes, bases)
        for batch in batches:
            prints, sizes, digests = [], [], []
            for text in batch.column(1):
                data = normalised(text.as_py())
                prints.append(poly.pack(poly.whole(data)))
                sizes.append(len(data))
                digests.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "fingerprint", "n_bytes", "text_sha256"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = normalised(text.as_py())
                digest = hashlib.sha256(data).hexdigest()
                for part, at in enumerate(range(0, len(data), huge)):
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.int64()), "text_sha256": [digest], "part": pa.array([part], pa.int64()), "text": pa.array([data[at : at + huge]], pa.binary())})

    rows, large = texts(docs), F.coalesce(F.octet_length("text") > huge, F.lit(False))
    small = rows.where(~large).mapInArrow(lean(run), "doc_id long, fingerprint binary, n_bytes long, text_sha256 string")
    parts = rows.where(large).mapInArrow(cut, "doc_id long, text_sha256 string, part long, text binary")
    whole = combine_parts(parts.repartition("doc_id", "text_sha256", "part"), primes, bases, ("doc_id", "text_sha256"))
    return small.unionByName(whole.select("doc_id", "fingerprint", "n_bytes", "text_sha256"))


def combine_parts(parts: DataFrame, primes: tuple[int, ...] = PRIMES, bases: tuple[int, ...] = BASES, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(``by``, fingerprint, n_bytes) of documents that are stored in parts: (``by``, part, text), already normalised.

    Parts are hashed wherever they lie; only (hash, length) of each travels, and
    a document's are put together by length-shifted sums in order of ``part``.
    Empty and null parts add nothing; a part that is there twice counts once.
    """
    width = len(by)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = Polynomial(primes, bases)
        for batch in batches:
            data = [t.as_py() or b"" for t in batch.column(width + 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: width + 1], pa.array([list(poly.whole(x)) for x in data], pa.list_(pa.int64())), pa.array([len(x) for x in data], pa.int64())],
                [*by, "part", "hash", "n"],
            )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = Polynomial(primes, bases)
        for batch in batches:
            prints, sizes = [], []
            for group in batch.column(width).to_pylist():
                value, size = (0,) * len(primes), 0
                for x in group:
                    value, size = poly.combine(value, tuple(x["hash"]), x["n"]), size + x["n"]
                prints.append(poly.pack(value))
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(prints, pa.binary()), pa.array(sizes, pa.int64())], [*by, "fingerprint", "n_bytes"])

    rows = parts.select(*by, F.col("part").cast("long"), F.col("text").cast("binary"))
    names = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes if c in by)
    rows = rows.mapInArrow(hashed, f"{names}, part long, hash array<long>, n long")
    rows = rows.groupBy(*by).agg(F.sort_array(F.collect_set(F.struct("part", "hash", "n"))).alias("parts"))
    return rows.mapInArrow(joined, f"{names}, fingerprint binary, n_bytes long")


def _chunks(rows: DataFrame) -> DataFrame:
    """The normalised text of each row in chunks: (doc_id, group, keep_id, copies, chunk_no, chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, numbers, parts = [], [], []
            for i, text in enumerate(batch.column(4)):
                data = normalised(text.as_py())
                for no, at in enumerate(range(0, max(1, len(data)), CHUNK)):
                    take.append(i)
                    numbers.append(no)
                    parts.append(data[at : at + CHUNK])
            head = batch.select([0, 1, 2, 3]).take(pa.array(take, pa.int32()))
            yield pa.RecordBatch.from_arrays([*head.columns, pa.array(numbers, pa.int32()), pa.array(parts, pa.binary())], ["doc_id", "grp", "keep_id", "copies", "chunk_no", "chunk"])

    return rows.select("doc_id", "grp", "keep_id", "copies", "text").mapInArrow(run, "doc_id long, grp binary, keep_id long, copies int, chunk_no int, chunk binary")


def dedup(docs: DataFrame, primes: tuple[int, ...] = PRIMES, bases: tuple[int, ...] = BASES, huge: int = HUGE) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, fingerprint.

    Texts are equal when identical after each ``[\\x20\\x09-\\x0D]+`` became one
    space; a null text is empty; of equal texts the least doc_id stays. Texts of
    one fingerprint and length are candidates. Each candidate is then compared,
    chunk by chunk, with its group's first document; those that differ (only
    a collision can) form groups of their own in a further round, so the result
    is exact. A group of a third of all rows is met by partial aggregates,
    by a broadcast of under 1000 keys, and in the comparison by one copy of the
    representative's chunks per 256 members. An empty table gives no rows; extra
    columns are ignored. Rows that repeat a doc_id count as one document, that of the least fingerprint; a null doc_id is an id, the least.
    """
    spark = configure(docs.sparkSession)
    one = F.min(F.struct("fingerprint", "n_bytes", "text_sha256")).alias("p")
    prints = materialize(fingerprints(docs, primes, bases, huge).groupBy("doc_id").agg(one).select("doc_id", "p.*"), "prints")
    total = max(1, prints.count())
    left = prints.select("doc_id", F.concat(F.col("fingerprint"), F.lit(":").cast("binary"), F.col("n_bytes").cast("string").cast("binary")).alias("grp"))
    body = texts(docs)
    settled: DataFrame | None = None
    while True:
        groups = left.groupBy("grp").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
        members = materialize(sized_lookup(left, materialize(groups, "groups"), "grp", "n", total), "members")
        if members.isEmpty():
            break
        copies = F.ceil(F.col("n") / PER_COPY).cast("int")
        own = members.select("doc_id", "grp", "keep_id", copies.alias("copies"))
        chunks = materialize(_chunks(own.hint("merge").join(body, "doc_id")), "chunks")
        salted = chunks.where("doc_id <> keep_id").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("copies")).cast("int"))
        first = chunks.where("doc_id = keep_id").select(
            "keep_id", "chunk_no", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.col("chunk").alias("first_chunk")
        )
        same = (
            salted.join(first, ["keep_id", "chunk_no", "salt"], "left")
            .groupBy("doc_id", "keep_id")
            .agg(F.min(F.coalesce(F.col("chunk") == F.col("first_chunk"), F.lit(False))).alias("same"))
        )
        same = materialize(same, "same")
        equal = same.where("same").select("doc_id", "keep_id").unionByName(members.where("doc_id = keep_id").select("doc_id", "keep_id"))
        settled = equal if settled is None else settled.unionByName(equal)
        other = same.where("not same")
        if other.isEmpty():
            break
        left = materialize(left.join(other.select("doc_id"), "doc_id", "left_semi"), "left")
    if settled is None:
        settled = spark.createDataFrame([], "doc_id long, keep_id long")
    sizes = settled.groupBy("keep_id").agg(F.count(F.lit(1)).alias("group_size"))
    settled = sized_lookup(settled, materialize(sizes, "sizes"), "keep_id", "group_size", total)
    out = prints.join(settled, "doc_id", "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.coalesce("keep_id", "doc_id") == F.col("doc_id")).alias("kept"),
        "text_sha256",
    )
    return restored(out, "doc_id", "keep_id")


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t
"""

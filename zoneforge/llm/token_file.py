"""Token ids in directly addressable codes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zoneforge.functions.storage import new_path
from zoneforge.llm.common import configure, restored, texts
from zoneforge.llm.tokens import encoder as encoder_of

#: Tokenizer, id after each document, bits of a chunk by level (the last takes what is left), bits between rank entries, ids of a segment.
TOKENIZER, END, LEVELS, RANK_BITS, SEGMENT = "word_bpe_49k.json", 2, (8, 8, 16), 512, 1 << 16
MAGIC = b"DAC1"
_COUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode(ids: np.ndarray, levels: tuple[int, ...] = LEVELS) -> bytes:
    """Ids as chunks by level. Level k holds chunk k of each id that has one, a
    bitmap of those that go on in level k + 1, and a rank directory: set bits before every 512th bit.

    Layout: magic, number of ids, number of levels; a level has bits, entries, then chunks (1 or 2
    bytes each), bitmap (little bit order), directory (32-bit). Numbers are little-endian.
    """
    if sum(levels) < 32 or any(b not in (8, 16) for b in levels):
        raise ValueError("levels of 8 or 16 bits, 32 in all")
    out = [MAGIC, struct.pack("<QB", len(ids), len(levels))]
    left = ids.astype(np.uint32)
    for k, bits in enumerate(levels):
        chunk = (left & np.uint32((1 << bits) - 1)).astype(np.uint8 if bits == 8 else "<u2")
        rest = left >> np.uint32(bits) if bits < 32 else np.zeros_like(left)
        on = rest > 0 if k + 1 < len(levels) else np.zeros(len(left), bool)
        bitmap = np.packbits(on, bitorder="little")
        padded = np.zeros(-(-len(left) // RANK_BITS) * RANK_BITS // 8, np.uint8)
        padded[: len(bitmap)] = bitmap
        per = _COUNT[padded].reshape(-1, RANK_BITS // 8).sum(1, dtype=np.uint32) if len(padded) else np.zeros(0, np.uint32)
        directory = (np.cumsum(per) - per).astype("<u4")
        out += [struct.pack("<BQ", bits, len(left)), chunk.tobytes(), bitmap.tobytes(), directory.tobytes()]
        left = rest[on]
    return b"".join(out)


class Codes:
    """Reads a block of codes without decoding it."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        self.n, levels = struct.unpack_from("<QB", data, 4)
        at, self.levels = 13, []
        for _ in range(levels):
            bits, n = struct.unpack_from("<BQ", data, at)
            at += 9
            chunk = np.frombuffer(data, np.uint8 if bits == 8 else "<u2", n, at)
            at += n * bits // 8
            bitmap = np.frombuffer(data, np.uint8, -(-n // 8), at)
            at += len(bitmap)
            directory = np.frombuffer(data, "<u4", -(-n // RANK_BITS), at)
            at += 4 * len(directory)
            self.levels.append((bits, chunk, bitmap, directory))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """One id: at each level a chunk and, if its bit goes on, a rank from the directory and at most 64 bytes of bitmap."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for bits, chunk, bitmap, directory in self.levels:
            value |= int(chunk[i]) << shift
            shift += bits
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            low = i // RANK_BITS * (RANK_BITS // 8)
            partial = int(bitmap[i >> 3]) & ((1 << (i & 7)) - 1)
            i = int(directory[i // RANK_BITS]) + int(_COUNT[bitmap[low : i >> 3]].sum()) + int(_COUNT[partial])
        return value

    def _rank(self, bitmap: np.ndarray, directory: np.ndarray, i: int) -> int:
        """Set bits before bit i: an entry of the directory and at most 64 bytes of bitmap."""
        if not i:
            return 0
        low = (i - 1) // RANK_BITS
        part = np.unpackbits(bitmap[low * RANK_BITS // 8 : -(-i // 8)], bitorder="little")
        return int(directory[low]) + int(part[: i - low * RANK_BITS].sum())

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop. What goes on of a span is a span of the next level, between two ranks, so nothing else is read."""
        if not 0 <= start <= stop <= self.n:
            raise IndexError((start, stop))
        out = np.zeros(stop - start, np.uint32)
        at, shift = np.arange(stop - start), 0
        for bits, chunk, bitmap, directory in self.levels:
            out[at] |= chunk[start:stop].astype(np.uint32) << np.uint32(shift)
            shift += bits
            low = start // 8
            on = np.unpackbits(bitmap[low : -(-stop // 8)], bitorder="little")[start - 8 * low : stop - 8 * low].astype(bool)
            at = at[on]
            if not len(at):
                break
            start = self._rank(bitmap, directory, start)
            stop = start + len(at)
        return out

    def all(self) -> np.ndarray:
        out = np.zeros(self.n, np.uint32)
        at, shift = np.arange(self.n), 0
        for bits, chunk, bitmap, _ in self.levels:
            out[at] |= chunk.astype(np.uint32) << np.uint32(shift)
            shift += bits
            at = at[np.unpackbits(bitmap, count=len(chunk), bitorder="little").astype(bool)]
        return out


_SCHEMA = "task int, segment long, n_ids long, first_doc long, last_doc long, doc_ids binary, ends binary, codes binary"
_DIRECTORY = "task int, segment long, n_ids long, first_doc long, last_doc long, base long"


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END, segment: int = SEGMENT) -> None:
    """Write the ids of whole texts, in order of doc_id, each document followed by ``end``.

    ``path``/codes is a file of segments: Parquet rows (task, segment, n_ids, first_doc, last_doc, doc_ids,
    ends, codes); codes is a block of about ``segment`` ids, never part of a document; tasks, and segments
    in them, are in order of doc_id. ``path``/directory has where each segment begins among all
    ids, a row a segment. Both are written by Spark, so a lost task leaves nothing behind.
    """
    spark = configure(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts(docs).repartitionByRange(parts, "doc_id").withColumn("task", F.spark_partition_id()).sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = encoder_of(tokenizer), np.array([end], "<u4").tobytes()
        docs_in: list[int] = []
        parts_in: list[bytes] = []
        have, number, task = 0, 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts_in), "<u4")
            ends = np.cumsum([len(x) // 4 for x in parts_in]).astype("<i8")
            row = [[task], [number], [len(ids)], [docs_in[0]], [docs_in[-1]], [np.array(docs_in, "<i8").tobytes()], [ends.tobytes()], [encode(ids)]]
            kinds = [pa.int32(), *[pa.int64()] * 4, *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], ["task", "segment", "n_ids", "first_doc", "last_doc", "doc_ids", "ends", "codes"])

        for batch in batches:
            for doc, ids, task in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), batch.column(2).to_pylist(), strict=True):
                docs_in.append(doc)
                parts_in.append(ids + tail)
                have += len(ids) // 4 + 1
                if have >= segment:
                    yield flush()
                    docs_in, parts_in, have, number = [], [], 0, number + 1
        if docs_in:
            yield flush()

    rows.mapInArrow(run, _SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/codes")
    found = _codes(spark, path).select("task", "segment", "n_ids", "first_doc", "last_doc")
    sizes = found.groupBy("task").agg(F.sum("n_ids").alias("n"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("task", F.coalesce(F.sum("n").over(before(F.lit(1)).orderBy("task")), F.lit(0)).alias("task_base"))
    inner = found.withColumn("inner_base", F.coalesce(F.sum("n_ids").over(before("task").orderBy("segment")), F.lit(0)))
    at = inner.join(bases, "task").select("task", "segment", "n_ids", "first_doc", "last_doc", (F.col("task_base") + F.col("inner_base")).alias("base"))
    at.sortWithinPartitions("base").write.parquet(f"{path}/directory")


def _codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(f"{path}/codes")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """(task, segment, n_ids, first_doc, last_doc, base) of each segment; base is the ids before it."""
    return spark.read.schema(_DIRECTORY).parquet(f"{path}/directory")


def token_at(spark: SparkSession, path: str, i: int) -> int:
    """Id number i of all ids, by the directory and one segment, whose block isn't decoded. IndexError beyond the last."""
    found = directory(spark, path).where((F.col("base") <= i) & (F.col("base") + F.col("n_ids") > i)).take(1) if i >= 0 else []
    if not found:
        raise IndexError(i)
    own = found[0]
    row = _codes(spark, path).where((F.col("task") == own.task) & (F.col("segment") == own.segment)).select("codes").first()
    return Codes(bytes(row.codes))[i - own.base]


def tokens_of(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """(doc_id, ids) of a document, a row for each row that it had; only segments that may hold it are read, and of them its span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for docs, ends, codes in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                block, stops = Codes(codes), np.frombuffer(ends, "<i8")
                for k in np.flatnonzero(np.frombuffer(docs, "<i8") == doc_id).tolist():
                    out.append(block.span(int(stops[k - 1]) if k else 0, int(stops[k])).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(out), pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "ids"])

    rows = _codes(spark, path).where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    return rows.select("doc_ids", "ends", "codes").mapInArrow(run, "doc_id long, ids array<long>")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 of each document, read as a span of its segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task, segment, docs, ends, codes in zip(*(batch.column(i) for i in range(5)), strict=True):
                block, stops = Codes(codes.as_py()), np.frombuffer(ends.as_py(), "<i8")
                starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
                crc = [zlib.crc32(block.span(a, b).astype("<u4", copy=False).tobytes()) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                n = len(stops)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task.as_py()] * n, pa.int32()), pa.array([segment.as_py()] * n, pa.int64()), pa.array(np.frombuffer(docs.as_py(), "<i8")), pa.array(starts), pa.array(stops - starts), pa.array(crc, pa.int64())],
                    ["task", "segment", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    rows = _codes(spark, path).select("task", "segment", "doc_ids", "ends", "codes")
    found = rows.mapInArrow(run, "task int, segment long, doc_id long, inner long, n_tokens long, ids_crc32 long")
    joined = found.join(directory(spark, path).select("task", "segment", "base"), ["task", "segment"])
    return restored(joined.select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, segment: int = SEGMENT, path: str | None = None) -> DataFrame:
    """Write the files, read them back: doc_id, start, n_tokens (with the end id), ids_crc32.

    A null or empty text is its end id alone. Rows that repeat a doc_id follow each
    other; rows of a null doc_id come first. An empty table makes no segment and gives no rows; extra columns are ignored.
    """
    path = path or new_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, end, segment)
    return documents(docs.sparkSession, path)

"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneforge.functions.storage import materialize
from zoneforge.llm import tokens

#: Spark settings of these jobs: small Arrow batches bound a Python worker's
#: memory whatever the length of the texts; shuffle files go with their query.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: What stands for a null doc_id inside an operator: rows without an id are rows that repeat one id, the least.
NULL_ID = -(1 << 63)


def identified(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID)).alias("doc_id")


def restored(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with null again where an id stood for it."""
    return df.withColumns({n: F.when(F.col(n) != NULL_ID, F.col(n)) for n in names or ("doc_id",)})


def held_out() -> Column:
    """Rows whose labels are never read: crc32(doc_id as text) mod 5 is 0; a row without an id is none of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id (NULL_ID for null) and text alone: further columns, whatever their names, stay out of the plan."""
    return docs.select(identified(), F.col("text").cast("string").alias("text"))


def trim() -> None:
    """Give back the pages that this process's allocators keep for later."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for tasks that need no tokenizer: Spark's workers go from stage to stage, so what an earlier one left in them goes first, and nothing is left by this."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        trim()
        yield from run(batches)
        trim()

    return own


def gathered(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until ``column`` has ``size`` bytes."""
    held, have = [], 0
    for batch in batches:
        held.append(batch)
        have += batch.column(column).nbytes
        if have >= size:
            yield pa.concat_batches(held)
            held, have = [], 0
    if held:
        yield pa.concat_batches(held)


def sized_lookup(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row per ``key``; ``size``: how many of ``rows`` have it).

    A key of more than total/1000 rows is joined by broadcast; as sizes add up
    to ``total``, there are under 1000 such keys. No other key holds more than
    a thousandth of the rows, so the shuffle of the rest is even.
    """
    hot = F.broadcast(groups.where(F.col(size) > total / 1000))
    cold = groups.where(F.col(size) <= total / 1000)
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key))


__all__ = ["NULL_ID", "SETTINGS", "configure", "gathered", "held_out", "identified", "lean", "materialize", "read", "restored", "sized_lookup", "texts", "trim"]

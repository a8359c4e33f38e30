"""Tables that a stream adds to by epoch, and the keys it has seen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneforge.functions.storage import delete, listed, materialize


class EpochTable:
    """Parquet parts by epoch. An epoch that is run again replaces its own part, and reads only parts of earlier ones.

    After ``every`` epochs all parts become one, by ``combine`` (of all rows, None: as they are): so there are never more than
    ``every`` parts and a few, whatever the number of epochs. ``by`` are columns that parts are partitioned by.
    """

    def __init__(self, spark: SparkSession, path: str, by: tuple[str, ...] = (), every: int = 16, combine: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.by, self.every, self.combine = spark, path, by, every, combine

    def _parts(self) -> tuple[int, list[int]]:
        """(epoch up to which all is one part, or -1; epochs after it), of parts that are whole."""
        whole = [n for n in listed(self.spark, self.path) if n.startswith(("upto-", "epoch-")) and "_SUCCESS" in listed(self.spark, f"{self.path}/{n}")]
        upto = max((int(n[5:]) for n in whole if n.startswith("upto-")), default=-1)
        return upto, sorted(e for e in (int(n[6:]) for n in whole if n.startswith("epoch-")) if e > upto)

    def read(self, before: int | None = None) -> DataFrame | None:
        """Rows of epochs below ``before`` (of all, if None); None if there are none."""
        upto, epochs = self._parts()
        paths = [f"{self.path}/upto-{upto}"] if upto >= 0 else []
        paths += [f"{self.path}/epoch-{e}" for e in epochs if before is None or e < before]
        if not paths:
            return None
        parts = [self.spark.read.parquet(p) for p in paths]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def put(self, df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").partitionBy(*self.by).parquet(f"{self.path}/epoch-{epoch}")

    def compact(self, epoch: int) -> None:
        """Before ``epoch`` is put: parts of earlier epochs become one when they are ``every``. Old parts go once it is whole."""
        upto, epochs = self._parts()
        old = [e for e in epochs if e < epoch]
        if len(old) >= self.every:
            rows = self.read(epoch)
            rows = rows if self.combine is None else self.combine(rows)
            rows.write.mode("overwrite").partitionBy(*self.by).parquet(f"{self.path}/upto-{old[-1]}")
            for name in [*(f"epoch-{e}" for e in old), *([f"upto-{upto}"] if upto >= 0 else [])]:
                delete(self.spark, f"{self.path}/{name}")


class SeenKeys:
    """Keys that earlier epochs of a stream have had, in buckets by their hash; an epoch looks into its own keys' buckets alone."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, every: int = 16):
        self.key, self.buckets = key, buckets
        self.table = EpochTable(spark, path, ("bucket",), every)

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def unseen(self, rows: DataFrame, epoch: int) -> DataFrame:
        """Rows whose key no epoch before this one had. Buckets are a setting, so their numbers may go through the driver."""
        self.table.compact(epoch)
        known = self.table.read(epoch)
        if known is None:
            return rows
        rows = materialize(self._bucketed(rows), "asked")
        own = [r.bucket for r in rows.select("bucket").distinct().collect()]
        return rows.join(known.where(F.col("bucket").isin(own)).select("bucket", self.key), ["bucket", self.key], "left_anti").drop("bucket")

    def put(self, rows: DataFrame, epoch: int) -> None:
        self.table.put(self._bucketed(rows.select(self.key).distinct()).repartition("bucket"), epoch)

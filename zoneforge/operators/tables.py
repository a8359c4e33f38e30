"""Metadata, maintenance and set operations on tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zoneforge.functions.storage import materialize


def encode_value(value) -> tuple[str | None, str]:
    """A metadata value as text and the encoding that gives it back."""
    if value is None:
        return None, "null"
    for kind, name in ((bool, "json"), (int, "int"), (float, "float"), (str, "str")):
        if isinstance(value, kind):
            return (json.dumps(value) if kind is bool else str(value)), name
    if isinstance(value, bytes):
        return value.hex(), "bytes"
    return json.dumps(value), "json"


def decode_value(value: str | None, encoding: str):
    if encoding == "null":
        return None
    return {"int": int, "float": float, "str": str, "bytes": bytes.fromhex, "json": json.loads}[encoding](value)


def metadata_insert(meta: DataFrame, new: DataFrame) -> DataFrame:
    """``meta`` and ``new``; an error if a key is there already."""
    taken = new.join(meta, "key", "left_semi").select("key").take(1)
    if taken:
        raise ValueError(f"key exists: {taken[0].key}")
    return meta.unionByName(new)


def metadata_upsert(meta: DataFrame, new: DataFrame) -> DataFrame:
    return meta.join(new, "key", "left_anti").unionByName(new)


def metadata_select(meta: DataFrame, keys: list[str]) -> DataFrame:
    return meta.where(F.col("key").isin(keys))


def metadata_value(meta: DataFrame, key: str):
    """One decoded value; KeyError if it is missing."""
    rows = meta.where(F.col("key") == key).take(1)
    if not rows:
        raise KeyError(key)
    return decode_value(rows[0].value, rows[0].encoding)


def metadata_delete(meta: DataFrame, key: str) -> DataFrame:
    return meta.where(~F.col("key").eqNullSafe(F.lit(key)))


def config_drift(meta: DataFrame, params: DataFrame) -> DataFrame:
    """Keys whose stored and new values differ: (key, stored, given, status)."""
    old = meta.select("key", F.col("value").alias("stored"), F.lit(True).alias("had"))
    new = params.select("key", F.col("value").alias("given"), F.lit(True).alias("has"))
    both = old.join(new, "key", "full").where(~F.col("stored").eqNullSafe(F.col("given")) | F.col("had").isNull() | F.col("has").isNull())
    status = F.when(F.col("had").isNull(), "missing in store").when(F.col("has").isNull(), "missing in config").otherwise("changed")
    return both.select("key", "stored", "given", status.alias("status"))


def check_config(meta: DataFrame, params: DataFrame) -> None:
    """Raise if the store lacks a key or holds another value; the message lists the keys."""
    bad = config_drift(meta, params).orderBy("key").collect()
    if bad:
        raise ValueError("config differs from the store: " + ", ".join(f"{r.key} ({r.status})" for r in bad))


def label_drift(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """(label, stored, given) where ordered label lists (label int, name) differ."""
    a, b = stored.select("label", F.col("name").alias("stored")), computed.select("label", F.col("name").alias("given"))
    return a.join(b, "label", "full").where(~F.col("stored").eqNullSafe(F.col("given")))


def check_unique(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_fk(child: DataFrame, col: str, parent: DataFrame, pcol: str) -> DataFrame:
    """Non-null child keys without a parent, with their counts."""
    keys = parent.select(F.col(pcol).alias(col)).distinct()
    return child.where(F.col(col).isNotNull()).join(keys, col, "left_anti").groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def assert_no_fanout(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``left`` that a left join with ``right`` would multiply."""
    return left.select(*keys).distinct().join(check_unique(right, keys), keys)


def set_difference(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    return a.select(*cols).distinct().join(b.select(*cols).distinct(), cols, "left_anti")


def set_equality(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """What only one side has: (cols, side). Empty when the sets are equal."""
    return set_difference(a, b, cols).withColumn("side", F.lit("left")).unionByName(set_difference(b, a, cols).withColumn("side", F.lit("right")))


def update_splits(structure: DataFrame, splits: DataFrame) -> DataFrame:
    """All structures with their new split; an error unless splits cover exactly the structures."""
    odd = set_equality(structure, splits, ["pdb_id"]).take(1)
    if odd:
        raise ValueError(f"splits and structures differ: {odd[0].pdb_id} is only on the {odd[0].side}")
    return structure.drop("split").join(splits.select("pdb_id", "split"), "pdb_id")


def dense_index(df: DataFrame, order: list[str | Column], name: str = "index", start: int = 0) -> DataFrame:
    """Row numbers over a total order without an unpartitioned window.

    Rows are dealt by range, sorted and numbered within their task in one shuffle; tasks are shifted
    by the counts of those before, one number each.
    """
    own = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumns({"_task": F.shiftright(own, 33), "_row": own.bitwiseAND(F.lit((1 << 33) - 1))}), "index")
    per_task = ranged.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    base = per_task.select("_task", (F.coalesce(before, F.lit(0)) + start).alias("_base"))
    return ranged.join(F.broadcast(base), "_task").withColumn(name, (F.col("_base") + F.col("_row")).cast("long")).drop("_task", "_row", "_base")


def fraction_of_total(df: DataFrame, col: str, name: str) -> DataFrame:
    """``col`` over its sum, which is one aggregate; null if the sum is 0 or nothing is summed."""
    total = df.agg(F.sum(col)).first()[0]
    return df.withColumn(name, F.col(col) / F.lit(total) if total else F.lit(None).cast("double"))

"""The dataset on disk: versions of Parquet tables, packed atoms, scores and logs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneforge import schemas
from zoneforge.functions import frames
from zoneforge.functions.storage import delete, listed, put_new, read_text

#: Keys by table: rows whose key is stored already are not written again.
KEYS = {
    "structure": ["pdb_id"], "assembly": ["struct_id", "pdb_id"], "zone": ["zone_id"], "atoms": ["assembly_id", "atom_id", "symmetry_mate"], "subchain": ["zone_id", "subchain_id", "symmetry_mate"],
    "subchain_pair": ["zone_id", "subchain_id_1", "symmetry_mate_1", "subchain_id_2", "symmetry_mate_2"], "neighbor": ["neighbor_id"], "zone_neighbor": ["zone_id", "neighbor_id"], "curriculum": ["zone_id", "random_seed"], "metadata": ["key"],
    "novel_key": ["key"], "file": ["path"],
}


class Conflict(Exception):
    """Another writer's version came first, again and again."""


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """{version, tables: {name: folders}} of the last version, or of the one that is named.

    A version is one small file, written after all of its tables' files and only by one writer. One
    that was cut off while it was written is no version.
    """
    names = [n for n in listed(spark, f"{path}/versions") if version is None or n == _name(version)]
    for name in reversed(names):
        try:
            return json.loads(read_text(spark, f"{path}/versions/{name}"))
        except json.JSONDecodeError:
            continue
    if version is not None:
        raise KeyError(f"no version {version}")
    return {"version": 0, "tables": {}}


def _name(version: int) -> str:
    return f"{version:012d}.json"


def _read(spark: SparkSession, path: str, base: dict, name: str) -> DataFrame | None:
    parts = base["tables"].get(name)
    return spark.read.parquet(*[f"{path}/data/{p}" for p in parts]) if parts else None


def read_table(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame | None:
    """A table as of the last (or a given) version: all tables of a version belong together. None if it has none."""
    return _read(spark, path, manifest(spark, path, version), name)


def transact(spark: SparkSession, path: str, build: Callable[[Callable[[str], DataFrame | None], dict], dict[str, DataFrame]], attempts: int = 5) -> int | None:
    """Add rows to some tables as one version: all of them are seen, or none.

    ``build`` is given a reader of the last version's tables and its manifest, and returns the rows to add. They are
    staged as files that no reader looks at; then the version's manifest names them. If another writer was
    first, everything is built again on its version. Returns the version, or None if there was nothing to add. A job that dies leaves the old version, and files that ``vacuum`` clears.
    """
    for _ in range(attempts):
        base = manifest(spark, path)
        stamp, added = uuid.uuid4().hex, {}
        for name, df in build(lambda name, base=base: _read(spark, path, base, name), base).items():
            part = f"{name}/{stamp}"
            df.write.parquet(f"{path}/data/{part}")
            if name not in base["tables"] or not spark.read.parquet(f"{path}/data/{part}").isEmpty():
                added[name] = part
        if not added:
            return None
        tables = {n: [*base["tables"].get(n, []), *([added[n]] if n in added else [])] for n in {**base["tables"], **added}}
        if (made := _commit(spark, path, base, tables)) is not None:
            return made
    raise Conflict(f"{attempts} times another version came first")


def _commit(spark: SparkSession, path: str, base: dict, tables: dict[str, list[str]]) -> int | None:
    """The next version's number, or None if there is a newer one than ``base``. Numbers of versions that were cut off are passed over."""
    if manifest(spark, path)["version"] != base["version"]:
        return None
    taken = [int(n.split(".")[0]) for n in listed(spark, f"{path}/versions")]
    version = max([base["version"], *taken]) + 1
    return version if put_new(spark, f"{path}/versions/{_name(version)}", json.dumps({"version": version, "tables": tables})) else None


def fresh(df: DataFrame, old: DataFrame | None, key: list[str]) -> DataFrame:
    """Rows of ``df``, one a key, whose key ``old`` lacks; in order of key by task, so files can be skipped by it."""
    new = df.dropDuplicates(key)
    if old is not None:
        new = new.join(old.select(*key), key, "left_anti").select(*old.columns)
    return new.sortWithinPartitions(*key)


def write_dataset(tables: dict[str, DataFrame], path: str) -> int | None:
    """Add each table's new rows as one version; running it again adds nothing."""
    spark = next(iter(tables.values())).sparkSession
    return transact(spark, path, lambda read, _: {n: fresh(df, read(n), [c for c in KEYS[n] if c in df.columns]) for n, df in tables.items()})


def next_id(old: DataFrame | None, column: str) -> int:
    """The least id above all stored ones. Versions make it sure: who numbers from it on an outdated version isn't committed."""
    top = None if old is None else old.agg(F.max(column)).first()[0]
    return 0 if top is None else top + 1


def compact(spark: SparkSession, path: str, parts: int = 8) -> int | None:
    """A version whose tables of over ``parts`` folders are one folder each."""
    base = manifest(spark, path)
    tables, stamp = dict(base["tables"]), uuid.uuid4().hex
    for name, own in base["tables"].items():
        if len(own) > parts:
            _read(spark, path, base, name).write.parquet(f"{path}/data/{name}/{stamp}")
            tables[name] = [f"{name}/{stamp}"]
    return _commit(spark, path, base, tables) if tables != base["tables"] else None


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete what the last version doesn't name, and older versions; how many folders went. Not while others write."""
    base, gone = manifest(spark, path), 0
    for name in listed(spark, f"{path}/data"):
        for stamp in listed(spark, f"{path}/data/{name}"):
            if f"{name}/{stamp}" not in base["tables"].get(name, []):
                delete(spark, f"{path}/data/{name}/{stamp}")
                gone += 1
    for name in listed(spark, f"{path}/versions"):
        if name != _name(base["version"]):
            delete(spark, f"{path}/versions/{name}")
    return gone


def pack_atoms(atoms: DataFrame) -> DataFrame:
    """(assembly_id, atoms): an assembly's atoms as one array, in order of atom_id."""
    rest = [c for c in atoms.columns if c not in ("assembly_id", "atom_id")]
    return atoms.groupBy("assembly_id").agg(F.sort_array(F.collect_list(F.struct("atom_id", *rest))).alias("atoms"))


def unpack_atoms(packed: DataFrame) -> DataFrame:
    return packed.select("assembly_id", F.inline("atoms"))


def load_direction_table(spark: SparkSession, path: str, geometry: str, distance: float) -> DataFrame:
    """The stored neighbour offsets; written on first use, and never replaced by others."""
    new, old = frames.direction_sets(spark, geometry, distance), read_table(spark, path, "neighbor")
    if old is None:
        write_dataset({"neighbor": new.coalesce(1)}, path)
        return read_table(spark, path, "neighbor").orderBy("neighbor_id")
    near = reduce(lambda a, b: a & b, [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) < 1e-9 for c in ("dx", "dy", "dz")])
    both = old.alias("a").join(new.alias("b"), "neighbor_id", "full")
    if both.where(~F.coalesce(near, F.lit(False))).take(1):
        raise ValueError("the store has other neighbour directions")
    return old.orderBy("neighbor_id")


def append_scores(store: DataFrame, scores: DataFrame) -> DataFrame:
    """``store`` and those scores whose (zone, seed) it lacks."""
    cols = ["zone_id", "random_seed", "difficulty"]
    fresh = scores.select(*cols).dropDuplicates(cols[:2]).join(store.select(*cols[:2]), cols[:2], "left_anti")
    return store.select(*cols).unionByName(fresh)


def dataset_fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n, fingerprint): the sum of 60-bit hashes of rows, modulo 2^60, whatever the order of rows and columns.

    Each field stands behind its length, and null apart from every text, so different rows hash different bytes.
    """
    parts = []
    for name, df in tables.items():
        fields = [F.col(c).cast("string") for c in sorted(df.columns)]
        cells = [F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("N")) for x in fields]
        digest = F.conv(F.substring(F.md5(F.concat(*cells).cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
        total = F.coalesce(F.sum(digest), F.lit(0).cast("decimal(38,0)")) % F.lit(1 << 60).cast("decimal(38,0)")
        parts.append(df.agg(F.count(F.lit(1)).alias("n"), total.cast("long").alias("fingerprint")).select(F.lit(name).alias("table"), "n", "fingerprint"))
    return reduce(DataFrame.unionByName, parts)


def eval_log_append(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", False).csv(path)


def eval_log_read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EVAL_LOG).option("header", False).csv(path)


def eval_log_next(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.max("i") + 1, F.lit(0)).alias("next_i"))

"""Filters and gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_model(atoms: DataFrame, structure: DataFrame) -> DataFrame:
    """Atoms of each structure's own model."""
    return atoms.join(structure.select("pdb_id", "model_id"), ["pdb_id", "model_id"], "left_semi")


def prune_water(atoms: DataFrame) -> DataFrame:
    return atoms.where(~F.upper("comp_id").isin("HOH", "DOD", "WAT"))


def prune_hydrogen(atoms: DataFrame) -> DataFrame:
    return atoms.where(~F.upper("element").isin("H", "D"))


def check_elements(atoms: DataFrame, whitelist: list[str]) -> DataFrame:
    """(assembly_id, ok): whether every element, whatever its case, is listed; an empty list passes all."""
    listed = F.upper("element").isin([e.upper() for e in whitelist]) if whitelist else F.lit(True)
    return atoms.groupBy("assembly_id").agg(F.coalesce(F.bool_and(F.coalesce(listed, F.lit(False))), F.lit(True)).alias("ok"))


def exclude_structures(df: DataFrame, ids: list[str]) -> DataFrame:
    return df.where(~F.col("pdb_id").isin(ids)) if ids else df


def prune_nonbiological(atoms: DataFrame, blacklist: list[str]) -> DataFrame:
    """Without listed residues, unless they belong to a polymer."""
    return atoms.where(~(F.col("comp_id").isin(blacklist) & ~F.col("is_polymer")))


def gate_max_density(df: DataFrame, grid: DataFrame, limit: float) -> DataFrame:
    """Rows of assemblies whose grid nowhere goes above ``limit``."""
    dense = grid.groupBy("assembly_id").agg(F.max("rho").alias("m")).where(F.col("m") > limit)
    return df.join(dense, "assembly_id", "left_anti")


def gate_min_density(zones: DataFrame, limit: float) -> DataFrame:
    return zones.where(F.col("density") > limit)


def gate_neighbor_count(zones: DataFrame, zone_neighbor: DataFrame, threshold: int) -> DataFrame:
    """Zones of at least ``threshold`` dense neighbours; 0 turns the gate off."""
    if threshold <= 0:
        return zones
    enough = zone_neighbor.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold)
    return zones.join(enough, "zone_id", "left_semi")


def filter_atoms(atoms: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return atoms.transform(fn)


def filter_annotation_type(df: DataFrame, types: tuple[str, ...] = ("domain", "family")) -> DataFrame:
    return df.where(F.col("type").isin(*types)).select("pdb_id", "interpro_id")


def truncate_split(zones: DataFrame, n: int) -> DataFrame:
    return zones.orderBy("zone_id").limit(n)


def list_structures(structure: DataFrame) -> DataFrame:
    return structure.select("pdb_id")


def list_zones(zone: DataFrame) -> DataFrame:
    return zone.select("zone_id")

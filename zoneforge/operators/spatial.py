"""Range joins between centres and atoms, and what counts rest on them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CENTER = ("cx", "cy", "cz")


def distance2(a: tuple[str, ...] = CENTER, b: tuple[str, ...] = ("x", "y", "z")) -> Column:
    x, y, z = (F.col(p) - F.col(q) for p, q in zip(a, b, strict=True))
    return x * x + y * y + z * z


def _near_cells(radius: float) -> Column:
    around = F.sequence(F.lit(-1), F.lit(1))
    cell = lambda c, d: (F.floor(F.col(c) / radius) + d).cast("long")
    return F.flatten(F.transform(around, lambda i: F.flatten(F.transform(around, lambda j: F.transform(around, lambda k: F.struct(cell("cx", i).alias("ix"), cell("cy", j).alias("iy"), cell("cz", k).alias("iz")))))))


CELL = ("ix", "iy", "iz")


def celled(atoms: DataFrame, width: float) -> DataFrame:
    """Atoms with the cell that each lies in; the width of cells goes with the columns."""
    cells = {i: F.floor(F.col(c) / width).cast("long") for i, c in zip(CELL, "xyz", strict=True)}
    return atoms.select(*[c for c in atoms.columns if c not in CELL], *[v.alias(i, metadata={"width": float(width)}) for i, v in cells.items()])


def cell_columns(atoms: DataFrame) -> list[str]:
    """The columns of the cells that atoms are laid out by; none if they aren't."""
    return list(CELL) if all(c in atoms.columns and "width" in atoms.schema[c].metadata for c in CELL) else []


def lay_out(atoms: DataFrame, table: str, width: float, path: str, buckets: int | None = None) -> DataFrame:
    """Write atoms as a table bucketed by assembly and cell, and read it.

    Searches up to ``width`` then join on the buckets as they lie: atoms aren't shuffled again, however often they are searched, and
    an assembly is in as many buckets as it has cells. At least as many buckets as a shuffle has parts, or Spark would deal both sides anew.
    """
    spark = atoms.sparkSession
    buckets = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = ("assembly_id", *CELL)
    celled(atoms, width).repartition(buckets, *key).write.option("path", path).bucketBy(buckets, *key).sortBy(*key).mode("overwrite").saveAsTable(table)
    return spark.table(table)


def atoms_within(centers: DataFrame, atoms: DataFrame, radius: float) -> DataFrame:
    """Atoms within ``radius`` (inclusive) of each centre of their assembly, and d2.

    centers: (assembly_id, zone_id, cx, cy, cz). Space is cut in cells of
    ``radius``, or of the greater width that atoms are laid out by; a centre stands in 27 of them, an atom in one, so this is an
    equi-join on cells. A dense assembly is many cells, hence many tasks.
    """
    width = atoms.schema["ix"].metadata["width"] if cell_columns(atoms) else 0.0
    if width < radius:
        atoms, width = celled(atoms, radius), radius
    spread = centers.select("*", F.explode(_near_cells(width)).alias("cell")).select(*centers.columns, "cell.*")
    joined = atoms.join(spread, ["assembly_id", *CELL]).withColumn("d2", distance2())
    return joined.where(F.col("d2") <= radius * radius).drop("ix", "iy", "iz")


def prune_distant_atoms(centers: DataFrame, atoms: DataFrame, radius: float, depth: float) -> DataFrame:
    """Atoms within ``radius + depth`` of any centre; out_of_bounds if none is within ``radius``."""
    key = ["assembly_id", "atom_id", *(["symmetry_mate"] if "symmetry_mate" in atoms.columns else [])]
    near = atoms_within(centers.select("assembly_id", *CENTER), atoms.select(*key, "x", "y", "z", *cell_columns(atoms)), radius + depth)
    least = near.groupBy(*key).agg(F.min("d2").alias("least"))
    return atoms.drop("out_of_bounds", *cell_columns(atoms)).join(least, key).withColumn("out_of_bounds", F.col("least") > radius * radius).drop("least")


def count_atoms(atoms: DataFrame, by: list[str]) -> DataFrame:
    """Sums of occupancy: an atom half there counts half."""
    return atoms.groupBy(*by).agg(F.sum("occupancy").alias("occupancy"))


def sphere_volume_nm3(radius: float) -> float:
    return 4 / 3 * math.pi * (radius / 10) ** 3


def exact_density(atoms: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """``points`` with density: occupancy within ``radius`` over the sphere's volume, in atoms a cubic nanometre."""
    near = atoms_within(points.select("assembly_id", "zone_id", *CENTER), atoms.select("assembly_id", "x", "y", "z", "occupancy", *cell_columns(atoms)), radius)
    found = near.groupBy("assembly_id", "zone_id").agg((F.sum("occupancy") / sphere_volume_nm3(radius)).alias("density"))
    return points.join(found, ["assembly_id", "zone_id"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))


def zone_neighbors(zones: DataFrame, dirs: DataFrame, density, limit: float) -> DataFrame:
    """(zone_id, neighbor_id) where the density beside the zone is above ``limit``.

    ``density`` maps points (assembly_id, zone_id, cx, cy, cz) to themselves with density;
    ``dirs`` is a fixed table of at most some dozens of offsets.
    """
    moved = zones.crossJoin(F.broadcast(dirs)).select(
        "assembly_id", F.col("zone_id").alias("home"), "neighbor_id", F.struct("zone_id", "neighbor_id").alias("zone_id"),
        (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), (F.col("cz") + F.col("dz")).alias("cz"),
    )
    return density(moved).where(F.col("density") > limit).select(F.col("home").alias("zone_id"), "neighbor_id")


def collect_neighbors(zone_neighbor: DataFrame) -> DataFrame:
    return zone_neighbor.groupBy("zone_id").agg(F.sort_array(F.collect_list("neighbor_id")).alias("neighbor_ids"))


def join_asym_counts(counts: DataFrame, asym: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Counts of a zone beside the whole subchains' totals; subchains that aren't allowed go before fractions are taken."""
    totals = asym.withColumnRenamed("occupancy", "occupancy_asym")
    on = [c for c in ("assembly_id", "subchain_id") if c in asym.columns and c in counts.columns]
    if allowed is not None:
        totals = totals.join(allowed, [c for c in allowed.columns if c in totals.columns], "left_semi")
    return counts.join(totals, on)


def subchain_fractions(counts: DataFrame) -> DataFrame:
    """fraction_of_zone and fraction_of_subchain; a zone has at most as many rows as it has subchains."""
    return counts.withColumn("fraction_of_zone", F.col("occupancy") / F.sum("occupancy").over(Window.partitionBy("zone_id"))).withColumn(
        "fraction_of_subchain", F.col("occupancy") / F.col("occupancy_asym")
    )


def zone_fractions(zones: DataFrame, atoms: DataFrame, asym: DataFrame, radius: float, allowed: DataFrame | None = None) -> DataFrame:
    near = atoms_within(zones.select("assembly_id", "zone_id", *CENTER), atoms.select("assembly_id", "subchain_id", "symmetry_mate", "x", "y", "z", "occupancy", *cell_columns(atoms)), radius)
    return subchain_fractions(join_asym_counts(count_atoms(near, ["assembly_id", "zone_id", "subchain_id", "symmetry_mate"]), asym, allowed))


def present(fractions: DataFrame, of_zone: float, of_subchain: float) -> DataFrame:
    return fractions.where((F.col("fraction_of_zone") >= of_zone) | (F.col("fraction_of_subchain") >= of_subchain)).select("zone_id", "subchain_id", "symmetry_mate")


def subchain_pairs(found: DataFrame) -> DataFrame:
    """All unordered pairs of subchains present in a zone, the lesser (subchain, mate) first."""
    one = found.select("zone_id", F.col("subchain_id").alias("subchain_id_1"), F.col("symmetry_mate").alias("symmetry_mate_1"))
    two = found.select("zone_id", F.col("subchain_id").alias("subchain_id_2"), F.col("symmetry_mate").alias("symmetry_mate_2"))
    less = F.struct("subchain_id_1", "symmetry_mate_1") < F.struct("subchain_id_2", "symmetry_mate_2")
    return one.join(two, "zone_id").where(less)


def zone_subchains(zones: DataFrame, atoms: DataFrame, asym: DataFrame, radius: float, solo: tuple[float, float], pair: tuple[float, float], allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(subchains of zones, pairs of them), by thresholds (share of zone, share of subchain) for each."""
    shares = zone_fractions(zones, atoms, asym, radius, allowed)
    return present(shares, *solo), subchain_pairs(present(shares, *pair))


def axis_statistics(atoms: DataFrame) -> DataFrame:
    stats = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("avg", F.avg), ("max", F.max))]
    return atoms.groupBy("assembly_id").agg(*stats)


def _grid(stats: DataFrame, spacing: float) -> DataFrame:
    """Grid points through the mean of each axis: as many steps either way as leave no atom over half a step beyond."""
    out = stats
    for c in "xyz":
        low = F.ceil((F.col(f"avg_{c}") - F.col(f"min_{c}") - spacing / 2) / spacing)
        high = F.ceil((F.col(f"max_{c}") - F.col(f"avg_{c}") - spacing / 2) / spacing)
        out = out.withColumn(f"g{c}", F.explode(F.sequence(-low, high))).withColumn(f"c{c}", F.col(f"avg_{c}") + F.col(f"g{c}") * spacing)
    return out


def principal_axes(atoms: DataFrame) -> DataFrame:
    """(assembly_id, a11 .. a33): unit axes by falling variance, a row each, the largest entry of each positive.

    Covariances are native partial aggregates; only the 3 by 3 eigenproblem, one row an assembly, is Python.
    """
    import numpy as np
    import pandas as pd

    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    cov = atoms.groupBy("assembly_id").agg(*[F.coalesce(F.covar_pop(a, b), F.lit(0.0)).alias(a + b) for a, b in pairs])
    names = [f"a{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]

    def solve(frames):
        for f in frames:
            m = f[["xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz"]].to_numpy().reshape(-1, 3, 3)
            vectors = np.linalg.eigh(m)[1][:, :, ::-1].transpose(0, 2, 1)
            top = np.abs(vectors).argmax(axis=2)
            sign = np.sign(np.take_along_axis(vectors, top[:, :, None], axis=2))
            yield pd.concat([f[["assembly_id"]].reset_index(drop=True), pd.DataFrame((vectors * sign).reshape(-1, 9), columns=names)], axis=1)

    return cov.mapInPandas(solve, "assembly_id long, " + ", ".join(f"{n} double" for n in names))


def zone_grid(atoms: DataFrame, spacing: float, axes: str = "principal") -> DataFrame:
    """(assembly_id, cx, cy, cz): grid centres around the mean, along principal axes or, with 'identity', the given ones."""
    if axes == "identity":
        return _grid(axis_statistics(atoms.select("assembly_id", "x", "y", "z")), spacing).select("assembly_id", *CENTER)
    frames = principal_axes(atoms)
    turned = atoms.select("assembly_id", "x", "y", "z").join(frames, "assembly_id")
    turned = turned.select("assembly_id", *[(F.col(f"a{i}1") * F.col("x") + F.col(f"a{i}2") * F.col("y") + F.col(f"a{i}3") * F.col("z")).alias(c) for i, c in enumerate("xyz", 1)])
    grid = _grid(axis_statistics(turned), spacing).select("assembly_id", *CENTER).join(frames, "assembly_id")
    back = [(F.col(f"a1{j}") * F.col("cx") + F.col(f"a2{j}") * F.col("cy") + F.col(f"a3{j}") * F.col("cz")).alias(f"_{c}") for j, c in enumerate(CENTER, 1)]
    return grid.select("assembly_id", *back).toDF("assembly_id", *CENTER)

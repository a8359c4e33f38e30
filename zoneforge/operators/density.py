"""Densities on voxel grids."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edge of a tile of the grid in voxels; cells of a kernel up to which voxels are joined with it.
TILE, FEW = 64, 150
#: Atoms from which an assembly is measured on coarse voxels, and their width.
LARGE, COARSE = 10_000_000, 5.0


def coarsen_large(atoms: DataFrame, voxel: float, cutoff: int = LARGE, coarse: float = COARSE) -> DataFrame:
    """(assembly_id, n_atoms, voxel): a coarse grid where an assembly has ``cutoff`` atoms or more."""
    sizes = atoms.groupBy("assembly_id").agg(F.count(F.lit(1)).alias("n_atoms"))
    return sizes.withColumn("voxel", F.when(F.col("n_atoms") < cutoff, F.lit(float(voxel))).otherwise(F.lit(float(coarse))))


def with_resolution(atoms: DataFrame, sizes: DataFrame, voxel: float) -> DataFrame:
    """Atoms with their assembly's ``voxel`` of ``sizes``. Only assemblies of another width than ``voxel`` are looked up: of those there
    is at most one for each ``cutoff`` atoms, so they are broadcast and a huge assembly isn't shuffled by its id."""
    other = sizes.where(F.col("voxel") != float(voxel)).select("assembly_id", F.col("voxel").alias("_own"))
    return atoms.join(F.broadcast(other), "assembly_id", "left").withColumn("voxel", F.coalesce("_own", F.lit(float(voxel)))).drop("_own")


def _width(voxel: float | None) -> tuple[Column, list[str]]:
    """The width of a row's voxels, and the column that it is, if it is one."""
    return (F.col("voxel"), ["voxel"]) if voxel is None else (F.lit(float(voxel)), [])


def voxel_occupancy(atoms: DataFrame, voxel: float | None = None) -> DataFrame:
    """(assembly_id, ix, iy, iz, rho): occupancy of each voxel in atoms a cubic nanometre. Sparse: empty voxels have no row.

    Without ``voxel`` each row's own width counts, a column that the result has too.
    """
    width, own = _width(voxel)
    cells = {i: F.floor(F.col(c) / width).cast("long") for i, c in zip(("ix", "iy", "iz"), "xyz", strict=True)}
    rows = atoms.select("assembly_id", *own, "occupancy", *[c.alias(n) for n, c in cells.items()])
    volume = F.pow(width / 10, F.lit(3)) if own else F.lit((voxel / 10) ** 3)
    return rows.groupBy("assembly_id", *own, "ix", "iy", "iz").agg((F.sum("occupancy") / volume).alias("rho"))


def corner_area(a: np.ndarray, b: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Area of the disc of radius ``r`` around 0 where x <= a and y <= b."""
    a, b = np.clip(a, -r, r), np.clip(b, -r, r)
    primitive = lambda x: 0.5 * (x * np.sqrt(np.maximum(r * r - x * x, 0)) + r * r * np.arcsin(np.clip(x / r, -1, 1)))
    half = np.sqrt(np.maximum(r * r - b * b, 0))
    inner = np.clip(a, -half, half)
    under_b = primitive(inner) - primitive(-half) + b * (inner + half)
    left = np.minimum(a, -half)
    right = np.maximum(a, half)
    caps = 2 * (primitive(left) - primitive(-r)) + 2 * (primitive(right) - primitive(half))
    return np.where(b >= 0, under_b + caps, under_b)


@cache
def kernel_cells(radius: float, voxel: float) -> tuple[tuple[int, int, int, float], ...]:
    """(dx, dy, dz, weight): the share of a sphere that each voxel of an odd cube around its centre holds.

    Areas of disc and square are closed forms; along z they are integrated by Gauss-Legendre between the heights where the form changes.
    """
    n = math.ceil(2 * radius / voxel)
    pad = (n if n % 2 else n + 1) // 2
    nodes, weights = np.polynomial.legendre.leggauss(40)
    edges = (np.arange(2 * pad + 2) - pad - 0.5) * voxel
    corners = np.unique(np.abs(edges))
    hyp = np.unique(np.round(np.hypot(corners[:, None], corners[None, :]), 12))
    breaks = np.unique(np.concatenate([edges, *[[s * math.sqrt(radius**2 - h**2) for s in (1, -1)] for h in np.concatenate([corners, hyp]) if h < radius], [radius, -radius]]))
    breaks = breaks[np.abs(breaks) <= radius + 1e-12]
    out = np.zeros((2 * pad + 1,) * 3)
    for low, high in zip(breaks[:-1], breaks[1:], strict=True):
        if high - low < 1e-12:
            continue
        k = int(np.searchsorted(edges, (low + high) / 2)) - 1
        z = (low + high) / 2 + (high - low) / 2 * nodes
        r = np.sqrt(np.maximum(radius**2 - z * z, 1e-30))
        area = corner_area(edges[:, None, None], edges[None, :, None], r[None, None, :])
        cell = area[1:, 1:] - area[:-1, 1:] - area[1:, :-1] + area[:-1, :-1]
        out[:, :, k] += (cell * weights).sum(-1) * (high - low) / 2
    out /= 4 / 3 * math.pi * radius**3
    return tuple((int(i) - pad, int(j) - pad, int(k) - pad, float(out[i, j, k])) for i, j, k in np.ndindex(out.shape) if out[i, j, k] > 1e-15)


def sphere_kernel(spark: SparkSession, radius: float, voxel: float) -> DataFrame:
    """(dx, dy, dz, w): at most (2 radius / voxel + 2)^3 rows, fixed by the two parameters."""
    return spark.createDataFrame(list(kernel_cells(radius, voxel)), "dx long, dy long, dz long, w double")


@cache
def dense_kernel(radius: float, voxel: float) -> np.ndarray:
    """The kernel as an odd cube."""
    cells = kernel_cells(radius, voxel)
    pad = max(c[0] for c in cells)
    out = np.zeros((2 * pad + 1,) * 3)
    for x, y, z, w in cells:
        out[x + pad, y + pad, z + pad] = w
    return out


def smooth_density(voxels: DataFrame, radius: float, voxel: float | None = None, method: str = "auto", sizes: tuple[float, ...] = ()) -> DataFrame:
    """Voxel densities spread by the sphere kernel; the grid grows by the kernel's reach.

    'relational' joins voxels with a broadcast of the kernel, a row for each of its cells. 'fft' cuts the
    grid in tiles with a margin, and convolves each tile in a task of its own; no task holds a whole assembly. 'auto' takes
    the first for kernels of at most FEW cells. Without ``voxel`` rows have a width of their own, one of
    ``sizes``; each has its kernel, and all are spread in one pass.
    """
    spark = voxels.sparkSession
    width, own = _width(voxel)
    known = tuple(map(float, sizes)) if own else (float(voxel),)
    if not known:
        raise ValueError("give a voxel size, or the sizes that rows may have")
    kernels = {s: kernel_cells(radius, s) for s in known}
    if own:
        voxels = voxels.where(F.when(width.isin(*known), F.lit(True)).otherwise(F.raise_error(F.lit("a voxel size that isn't listed")).cast("boolean")))
    if method == "relational" or (method == "auto" and max(map(len, kernels.values())) <= FEW):
        table = spark.createDataFrame([(s, *cell) for s, cells in kernels.items() for cell in cells], "_s double, dx long, dy long, dz long, w double")
        moved = voxels.join(F.broadcast(table), width == F.col("_s"))
        cells = [(F.col(i) + F.col(d)).alias(i) for i, d in (("ix", "dx"), ("iy", "dy"), ("iz", "dz"))]
        return moved.select("assembly_id", *own, *cells, (F.col("rho") * F.col("w")).alias("rho")).groupBy("assembly_id", *own, "ix", "iy", "iz").agg(F.sum("rho").alias("rho"))
    pads = {s: max(c[0] for c in cells) for s, cells in kernels.items()}
    reach = F.lit(pads[known[0]])
    for s in known[1:]:
        reach = F.when(width == s, F.lit(pads[s])).otherwise(reach)
    tiles = voxels
    for c, t in (("ix", "tx"), ("iy", "ty"), ("iz", "tz")):
        tiles = tiles.withColumn(t, F.explode(F.sequence(F.floor((F.col(c) - reach) / TILE).cast("long"), F.floor((F.col(c) + reach) / TILE).cast("long"))))

    def convolve(key, frame: pd.DataFrame) -> pd.DataFrame:
        size = key[1] if own else known[0]
        pad, kernel = pads[size], dense_kernel(radius, size)
        low = np.array(key[-3:], np.int64) * TILE
        side = TILE + 2 * pad
        at = frame[["ix", "iy", "iz"]].to_numpy() - low + pad
        inside = ((at >= 0) & (at < side)).all(1)
        grid = np.zeros((side,) * 3)
        np.add.at(grid, tuple(at[inside].T), frame["rho"].to_numpy()[inside])
        shape = (side + 2 * pad,) * 3
        full = np.fft.irfftn(np.fft.rfftn(grid, shape) * np.fft.rfftn(kernel, shape), shape)
        part = full[2 * pad : 2 * pad + TILE, 2 * pad : 2 * pad + TILE, 2 * pad : 2 * pad + TILE]
        where = np.argwhere(part > 1e-9)
        named = {"voxel": size} if own else {}
        return pd.DataFrame({"assembly_id": key[0], **named, "ix": where[:, 0] + low[0], "iy": where[:, 1] + low[1], "iz": where[:, 2] + low[2], "rho": part[tuple(where.T)]})

    schema = f"assembly_id long, {'voxel double, ' if own else ''}ix long, iy long, iz long, rho double"
    return tiles.groupBy("assembly_id", *own, "tx", "ty", "tz").applyInPandas(convolve, schema)


def max_density(grid: DataFrame) -> DataFrame:
    return grid.groupBy("assembly_id").agg(F.max("rho").alias("max_rho"))


def interpolate_density(grid: DataFrame, points: DataFrame, voxel: float | None = None) -> DataFrame:
    """``points`` with density: trilinear between voxel centres, 0 beyond the outermost centres and where the grid is empty.

    Without ``voxel`` a point is measured on voxels of its assembly's own width, a column of the grid.
    """
    width, own = _width(voxel)
    box = grid.groupBy("assembly_id", *own).agg(*[f(c).alias(f"{n}_{c}") for c in ("ix", "iy", "iz") for n, f in (("lo", F.min), ("hi", F.max))])
    rows = points.drop(*own).join(box, "assembly_id", "left")
    inside = F.lit(True)
    for c, i in (("cx", "ix"), ("cy", "iy"), ("cz", "iz")):
        u = F.col(c) / width - 0.5
        inside = inside & (u >= F.col(f"lo_{i}")) & (u <= F.col(f"hi_{i}"))
    ends = F.array(F.lit(0), F.lit(1))
    corner = rows.where(inside).select("assembly_id", *own, "zone_id", "cx", "cy", "cz")
    weight = F.lit(1.0)
    for c, i, d in (("cx", "ix", "ox"), ("cy", "iy", "oy"), ("cz", "iz", "oz")):
        u = F.col(c) / width - 0.5
        low = F.floor(u)
        corner = corner.withColumn(d, F.explode(ends)).withColumn(i, (low + F.col(d)).cast("long"))
        weight = weight * F.when(F.col(d) == 1, u - low).otherwise(1 - (u - low))
    found = corner.withColumn("w", weight).join(grid.drop(*own), ["assembly_id", "ix", "iy", "iz"]).groupBy("assembly_id", "zone_id").agg(F.sum(F.col("w") * F.col("rho")).alias("density"))
    return points.join(found, ["assembly_id", "zone_id"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))

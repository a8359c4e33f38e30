"""Voxel images of samples."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from zoneforge.operators.density import corner_area

#: Spheres measured at a time; nodes between two heights where the form of a section changes.
_SPHERES, _NODES = 500, 10


@dataclass(frozen=True)
class Grid:
    """A cube of ``length`` voxels a side, ``resolution`` wide each, around the origin."""

    length: int
    resolution: float
    channels: int
    radius: float | None = None

    @property
    def atom_radius(self) -> float:
        return self.resolution / 2 if self.radius is None else self.radius

    @property
    def half(self) -> float:
        return self.length * self.resolution / 2


def clip_to_image(atoms: DataFrame, grid: Grid) -> DataFrame:
    """Atoms whose sphere touches the cube's extent on each axis."""
    reach = grid.half + grid.atom_radius
    return atoms.where(reduce(lambda a, b: a & b, [F.abs(c) < reach for c in "xyz"]))


def element_channels(atoms: DataFrame, channels: list[list[str]]) -> DataFrame:
    """``channels`` array: each that lists the element, or else those that list '*'."""
    rules = [(e, i) for i, elements in enumerate(channels) for e in elements]
    other = F.array(*[F.lit(i) for e, i in rules if e == "*"]).cast("array<int>")
    names = sorted({e for e, _ in rules if e != "*"})
    known = other
    for name in names:
        known = F.when(F.upper("element") == name.upper(), F.array(*[F.lit(i) for e, i in rules if e == name])).otherwise(known)
    return atoms.withColumn("channels", known)


def ligand_channel(atoms: DataFrame, predicate: str = "is_polymer", index: int = 0) -> DataFrame:
    """One more channel for atoms of which ``predicate`` (SQL) holds."""
    return atoms.withColumn("channels", F.when(F.coalesce(F.expr(predicate), F.lit(False)), F.array_append("channels", F.lit(index))).otherwise(F.col("channels")))


def overlaps(center: np.ndarray, radius: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """The first voxel (n, 3) that each sphere may touch, and its share in the m^3 voxels from there (n, m, m, m).

    Sections are closed forms; along z they are integrated by Gauss-Legendre between the heights
    where the form changes, over the sine of the node, as forms end there like a root.
    """
    m = math.ceil(2 * radius / width) + 1
    first = np.floor((center - radius) / width).astype(np.int64)
    x, y, z = (((first[:, k, None] + np.arange(m + 1)) * width - center[:, k, None]).clip(-radius, radius) for k in range(3))
    inner = np.concatenate([np.abs(x[:, 1:-1]), np.abs(y[:, 1:-1]), np.hypot(x[:, 1:-1, None], y[:, None, 1:-1]).reshape(len(center), -1)], 1)
    turn = np.sqrt(np.maximum(radius**2 - inner**2, 0))
    breaks = np.sort(np.concatenate([turn, -turn, z], 1), axis=1)
    low, high = breaks[:, :-1], breaks[:, 1:]
    nodes, weights = np.polynomial.legendre.leggauss(_NODES)
    height = (low + high)[:, :, None] / 2 + (high - low)[:, :, None] / 2 * np.sin(np.pi / 2 * nodes)
    r = np.sqrt(np.maximum(radius**2 - height**2, 1e-30))[..., None, None]
    area = corner_area(x[:, None, None, :, None], y[:, None, None, None, :], r)
    cell = area[..., 1:, 1:] - area[..., :-1, 1:] - area[..., 1:, :-1] + area[..., :-1, :-1]
    slabs = np.einsum("nikab,k->niab", cell, weights * np.pi / 2 * np.cos(np.pi / 2 * nodes)) * ((high - low) / 2)[..., None, None]
    layer = ((z[:, None, 1:] < ((low + high) / 2)[..., None]).sum(-1)).clip(0, m - 1)
    return first, np.einsum("niab,niz->nabz", slabs, np.eye(m)[layer]) / (4 / 3 * math.pi * radius**3)


def rasterize(atoms: DataFrame, grid: Grid, k: int | None = None) -> DataFrame:
    """(i, channel, vx, vy, vz, value): occupancy spread by the share of each sphere that a voxel holds.

    Shares are volumes of overlap; a row for each voxel that a sphere touches is all that is made. With ``k`` they are
    counted on ``k``^3 points of the sphere's cube, those inside: all built-in, coarser, and more rows. An
    atom's values sum to its occupancy, or to less if it stands over the edge. Atoms without a position show nowhere.
    """
    if k is not None:
        return _by_points(atoms, grid, k)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _SPHERES):
                part = batch.slice(start, _SPHERES)
                center = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4)], 1) + grid.half
                first, share = overlaps(center, grid.atom_radius, grid.resolution)
                atom, *step = np.nonzero(share > 1e-12)
                cell = first[atom] + np.stack(step, 1)
                inside = ((cell >= 0) & (cell < grid.length)).all(1)
                value = part.column(5).to_numpy(zero_copy_only=False)[atom] * share[(atom, *step)]
                own = pa.array(atom[inside])
                yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), *[pa.array(cell[inside, c].astype(np.int32)) for c in range(3)], pa.array(value[inside])], ["i", "channels", "vx", "vy", "vz", "value"])

    rows = atoms.dropna(subset=["x", "y", "z", "occupancy"]).select("i", "channels", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "occupancy")])
    schema = StructType([rows.schema["i"], rows.schema["channels"]]).add("vx", "integer").add("vy", "integer").add("vz", "integer").add("value", "double")
    voxels = rows.mapInArrow(spread, schema).select("i", F.explode("channels").alias("channel"), "vx", "vy", "vz", "value")
    return voxels.groupBy("i", "channel", "vx", "vy", "vz").agg(F.sum("value").alias("value"))


def _by_points(atoms: DataFrame, grid: Grid, k: int) -> DataFrame:
    r = grid.atom_radius
    step = [(2 * (a + 0.5) / k - 1) * r for a in range(k)]
    points = [(x, y, z) for x in step for y in step for z in step if x * x + y * y + z * z <= r * r]
    share = 1.0 / len(points)
    table = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(p, ("px", "py", "pz"), strict=True)]) for p in points])
    rows = atoms.select("i", F.explode("channels").alias("channel"), "x", "y", "z", "occupancy").withColumn("p", F.explode(table))
    voxels = {v: F.floor((F.col(c) + F.col(f"p.p{c}") + grid.half) / grid.resolution).cast("int") for v, c in zip(("vx", "vy", "vz"), "xyz", strict=True)}
    rows = rows.select("i", "channel", (F.col("occupancy") * share).alias("value"), *[c.alias(n) for n, c in voxels.items()])
    inside = reduce(lambda a, b: a & b, [F.col(v).between(0, grid.length - 1) for v in voxels])
    return rows.where(inside).groupBy("i", "channel", "vx", "vy", "vz").agg(F.sum("value").alias("value"))


def dense(voxels: DataFrame, samples: DataFrame, grid: Grid) -> DataFrame:
    """Every voxel of every sample and channel, 0 where nothing lies."""
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    whole = samples.select("i").distinct().withColumn("channel", axis(grid.channels))
    for v in ("vx", "vy", "vz"):
        whole = whole.withColumn(v, axis(grid.length))
    return whole.join(voxels, ["i", "channel", "vx", "vy", "vz"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def _per_channel(value, channels: int) -> list[float]:
    return [float(v) for v in value] if isinstance(value, (list, tuple)) else [float(value)] * channels


def normalize_image(voxels: DataFrame, samples: DataFrame, grid: Grid, mean, std) -> DataFrame:
    """(value - mean) / std by channel, over all voxels, the empty ones too; mean and std are numbers or lists."""
    pick = lambda v: F.element_at(F.array(*map(F.lit, _per_channel(v, grid.channels))), F.col("channel") + 1)
    return dense(voxels, samples, grid).withColumn("value", (F.col("value") - pick(mean)) / pick(std))


def pack_image(voxels: DataFrame, grid: Grid, by: tuple[str, ...] = ("i",)) -> DataFrame:
    """(by, image): a dense image as array<float> in order of channel, x, y, z. An image is channels * length^3 numbers, whatever the data."""
    n = grid.length
    at = ((F.col("channel") * n + F.col("vx")) * n + F.col("vy")) * n + F.col("vz")
    packed = voxels.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), F.col("value").cast("float").alias("v")))).alias("p"))
    return packed.select(*by, F.transform("p", lambda x: x["v"]).alias("image"))


def images(voxels: DataFrame, samples: DataFrame, grid: Grid) -> DataFrame:
    """(i, image) of every sample from the voxels that aren't empty: as ``pack_image`` of ``dense``, without a row for each
    empty voxel. A group is one image, channels * length^3 numbers at most."""
    n = grid.length
    at = ((F.col("channel") * n + F.col("vx")) * n + F.col("vy")) * n + F.col("vz")
    rows = voxels.select("i", at.cast("int").alias("at"), F.col("value").cast("double").alias("value"))
    rows = rows.unionByName(samples.select("i", F.lit(0).alias("at"), F.lit(0.0).alias("value")))
    schema = StructType([samples.schema["i"]]).add("image", ArrayType(FloatType()))

    def fill(part: pa.Table) -> pa.Table:
        flat = np.bincount(part.column("at").to_numpy(), part.column("value").to_numpy(), grid.channels * n**3).astype(np.float32)
        return pa.table({"i": part.column("i").slice(0, 1), "image": pa.array([flat], pa.list_(pa.float32()))})

    return rows.groupBy("i").applyInArrow(fill, schema)


def image_stacks(atoms: DataFrame, samples: DataFrame, grid: Grid, views: int = 1, mean=0.0, std=1.0) -> DataFrame:
    """(i, images): every sample's views as dense, normalised arrays, in order of channel, x, y, z, straight from its atoms.

    atoms: (i, channels, x, y, z, occupancy), and ``view`` if there are more views than one. A group is one sample: the atoms that its
    images show, and views * channels * length^3 numbers that are filled, scaled by (value - mean) / std of
    the channel and packed in one task. No voxel is a row, and atoms without a position show nowhere.
    """
    n, shape = grid.length, (views, grid.channels, grid.length**3)
    low, width = (np.array(_per_channel(v, grid.channels)).reshape(1, -1, 1) for v in (mean, std))
    view = F.col("view").cast("int") if "view" in atoms.columns else F.lit(0)
    rows = atoms.dropna(subset=["x", "y", "z", "occupancy"]).select("i", view.alias("view"), F.col("channels").cast("array<int>").alias("channels"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "occupancy")])
    nothing = [F.lit(0).alias("view"), F.array().cast("array<int>").alias("channels"), *[F.lit(0.0).alias(c) for c in ("x", "y", "z", "occupancy")]]
    rows = rows.unionByName(samples.select("i").distinct().select("i", *nothing))
    schema = StructType([samples.schema["i"]]).add("images", ArrayType(ArrayType(FloatType())))

    def fill(part: pa.Table) -> pa.Table:
        flat = np.zeros(views * grid.channels * n**3)
        for batch in part.combine_chunks().to_batches(max_chunksize=_SPHERES):
            own = batch.column("channels")
            count, channel = own.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            first, share = overlaps(np.stack([batch.column(c).to_numpy() for c in "xyz"], 1) + grid.half, grid.atom_radius, grid.resolution)
            atom, *step = np.nonzero(share > 1e-12)
            cell = first[atom] + np.stack(step, 1)
            value = batch.column("occupancy").to_numpy()[atom] * share[(atom, *step)]
            inside = ((cell >= 0) & (cell < n)).all(1) & (count[atom] > 0)
            atom, cell, value = atom[inside], cell[inside], value[inside]
            # a part of a sphere counts in each channel of its atom
            many = np.repeat(np.arange(len(atom)), count[atom])
            within = np.arange(len(many)) - np.repeat(np.cumsum(count[atom]) - count[atom], count[atom])
            at = channel[(np.cumsum(count) - count)[atom[many]] + within]
            place = ((batch.column("view").to_numpy()[atom[many]] * grid.channels + at) * n + cell[many, 0]) * n * n + cell[many, 1] * n + cell[many, 2]
            flat += np.bincount(place, value[many], len(flat))
        images = ((flat.reshape(shape) - low) / width).astype(np.float32).reshape(views, -1)
        return pa.table({"i": part.column("i").slice(0, 1), "images": pa.array([list(images)], pa.list_(pa.list_(pa.float32())))})

    return rows.groupBy("i").applyInArrow(fill, schema)


def image_pair(view_a: DataFrame, view_b: DataFrame, labels: DataFrame, grid: Grid) -> DataFrame:
    """(i, images of both views, label) from dense voxels of each view."""
    a = pack_image(view_a, grid).withColumnRenamed("image", "image_a")
    b = pack_image(view_b, grid).withColumnRenamed("image", "image_b")
    return a.join(b, "i").join(labels.select("i", "label"), "i").select("i", F.array("image_a", "image_b").alias("images"), "label")

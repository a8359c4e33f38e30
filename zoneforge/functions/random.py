"""Reproducible random columns: uniforms by a hash of (seed, slot), and what is drawn from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zoneforge.functions import frames as f


def uniform(seed: str | Column, slot: int | str) -> Column:
    """A number in [0, 1) that hangs on the seed and the slot alone; any engine with md5 gives the same."""
    seed = F.col(seed) if isinstance(seed, str) else seed
    return F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), F.lit(str(slot))).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


def uniform_stream(df: DataFrame, seed: str, slots: int, name: str = "u") -> DataFrame:
    return df.withColumns({f"{name}{k}": uniform(seed, k) for k in range(slots)})


def unit_vector(seed: str, slot: int) -> Column:
    """Uniform on the sphere: height and longitude are uniform."""
    z, phi = 2 * uniform(seed, slot) - 1, 2 * math.pi * uniform(seed, slot + 1)
    r = F.sqrt(1 - z * z)
    return f.vector(r * F.cos(phi), r * F.sin(phi), z)


def sample_unit_vector(df: DataFrame, slot: int, seed: str = "i", name: str = "v") -> DataFrame:
    return df.withColumn(name, unit_vector(seed, slot))


def sample_in_cube(df: DataFrame, size: float, center: str = "center", seed: str = "i", name: str = "origin") -> DataFrame:
    c = F.col(center)
    return df.withColumn(name, f.vector(*[c[a] + size * (uniform(seed, k) - 0.5) for k, a in enumerate("xyz")]))


def sample_frame(df: DataFrame, origin: str, seed: str = "i", slot: int = 10, name: str = "frame") -> DataFrame:
    """A frame at ``origin`` turned by a uniform angle about a uniform axis (not uniform over all rotations)."""
    return df.withColumn("_axis", unit_vector(seed, slot)).withColumn(name, f.frame(F.col(origin), f.axis_angle(F.col("_axis"), 2 * math.pi * uniform(seed, slot + 2)))).drop("_axis")


def sample_noise_frame(df: DataFrame, max_distance: float | Column, max_angle: float | Column, seed: str = "i", slot: int = 20, name: str = "noise") -> DataFrame:
    """A small frame: distance and angle (degrees) uniform up to their limits, in uniform directions."""
    limit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    origin = f.scale(unit_vector(seed, slot), uniform(seed, slot + 2) * limit(max_distance))
    angle = F.radians(uniform(seed, slot + 3) * limit(max_angle))
    return df.withColumn("_o", origin).withColumn("_a", unit_vector(seed, slot + 4)).withColumn(name, f.frame(F.col("_o"), f.axis_angle(F.col("_a"), angle))).drop("_o", "_a")

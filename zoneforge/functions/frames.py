"""Vectors, rotations and coordinate frames as columns.

A vector is struct<x,y,z>; a rotation is an array of 9 doubles by rows; a frame is
struct<r: array<double>, t: struct<x,y,z>> and takes v to r v + t.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PHI = (1 + math.sqrt(5)) / 2


def _scaled(points: list[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    n = math.sqrt(sum(v * v for v in points[0]))
    return [tuple(v / n for v in p) for p in points]


def directions(name: str) -> list[tuple[float, float, float]]:
    """Unit vectors of a named set: faces of Platonic solids, their unions, and subdivided icosahedra.

    The order of the basic sets is fixed, because ids of stored neighbours refer to it.
    """
    # Their order decides the ids of neighbours.
    s, g, h = 1 / math.sqrt(2), PHI, 1 / PHI
    fixed = {
        "tetrahedron": [(1, 0, -s), (-1, 0, -s), (0, 1, s), (0, -1, s)],
        "cube": [(0, -1, 0), (0, 1, 0), (-1, 0, 0), (1, 0, 0), (0, 0, 1), (0, 0, -1)],
        "octahedron": [
            (1, 1, 1), (1, 1, -1), (1, -1, 1), (1, -1, -1),
            (-1, 1, 1), (-1, 1, -1), (-1, -1, 1), (-1, -1, -1),
        ],
        "dodecahedron": [
            (0, 1, g), (0, -1, g), (0, 1, -g), (0, -1, -g),
            (1, g, 0), (-1, g, 0), (1, -g, 0), (-1, -g, 0),
            (g, 0, 1), (g, 0, -1), (-g, 0, 1), (-g, 0, -1),
        ],
        "icosahedron": [
            (1, 1, 1), (1, 1, -1), (1, -1, 1), (1, -1, -1),
            (-1, 1, 1), (-1, 1, -1), (-1, -1, 1), (-1, -1, -1),
            (0, g, h), (0, g, -h), (0, -g, h), (0, -g, -h),
            (h, 0, g), (-h, 0, g), (h, 0, -g), (-h, 0, -g),
            (g, h, 0), (g, -h, 0), (-g, h, 0), (-g, -h, 0),
        ],
    }
    if name in fixed:
        return _scaled(fixed[name])
    unions = {"octahedron+cube": ("octahedron", "cube"), "icosahedron+dodecahedron": ("icosahedron", "dodecahedron")}
    if name in unions:
        return [v for part in unions[name] for v in directions(part)]
    if name.startswith("icosphere"):
        return _icosphere(int(name[9:]))
    raise ValueError(f"no such set of directions: {name}")


def _icosphere(n: int) -> list[tuple[float, float, float]]:
    """Vertices of an icosahedron whose edges are cut in ``n``: 10 n^2 + 2 of them."""
    corners = directions("dodecahedron")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    near = max(dot(corners[0], c) for c in corners[1:]) - 1e-9
    joined = [[dot(a, b) > near for b in corners] for a in corners]
    out: dict[tuple, tuple[float, float, float]] = {}
    for i in range(12):
        for j in range(i + 1, 12):
            for k in range(j + 1, 12):
                if joined[i][j] and joined[j][k] and joined[i][k]:
                    for a in range(n + 1):
                        for b in range(n + 1 - a):
                            p = tuple(a * x + b * y + (n - a - b) * z for x, y, z in zip(corners[i], corners[j], corners[k], strict=True))
                            q = _scaled([p])[0]
                            out.setdefault(tuple(round(v, 9) + 0.0 for v in q), q)
    return [out[k] for k in sorted(out)]


def direction_sets(spark: SparkSession, name: str, distance: float = 1.0) -> DataFrame:
    rows = [(i, *(float(v * distance) for v in p)) for i, p in enumerate(directions(name))]
    return spark.createDataFrame(rows, "neighbor_id int, dx double, dy double, dz double")


def union_directions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both sets, the second numbered on from the first."""
    n = a.agg((F.max("neighbor_id") + 1).alias("n"))
    moved = b.crossJoin(F.broadcast(n)).select((F.col("neighbor_id") + F.coalesce("n", F.lit(0))).cast("int").alias("neighbor_id"), "dx", "dy", "dz")
    return a.select("neighbor_id", "dx", "dy", "dz").unionByName(moved)


def vector(x, y, z) -> Column:
    x, y, z = (F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(float(v)) for v in (x, y, z))
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def let(values: dict[str, Column], body) -> Column:
    """``body`` over a struct of ``values``, each computed once: nested vector algebra would else repeat its parts without end."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


def dot(a: Column, b: Column) -> Column:
    return let({"a": a, "b": b}, lambda s: _dot(s["a"], s["b"]))


def _dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def _cross(a: Column, b: Column) -> Column:
    return vector(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def _scale(a: Column, s) -> Column:
    return vector(a["x"] * s, a["y"] * s, a["z"] * s)


def scale(a: Column, s) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return let({"a": a, "s": s}, lambda v: _scale(v["a"], v["s"]))


def add(a: Column, b: Column) -> Column:
    return let({"a": a, "b": b}, lambda s: vector(*[s["a"][c] + s["b"][c] for c in "xyz"]))


def unit(a: Column) -> Column:
    return let({"a": a}, lambda s: _scale(s["a"], 1 / F.sqrt(_dot(s["a"], s["a"]))))


def rotation(*entries) -> Column:
    return F.array(*[e.cast("double") if isinstance(e, Column) else F.lit(float(e)) for e in entries])


IDENTITY = (1, 0, 0, 0, 1, 0, 0, 0, 1)


def _turned(r: Column, v: Column) -> Column:
    row = lambda i: r[3 * i] * v["x"] + r[3 * i + 1] * v["y"] + r[3 * i + 2] * v["z"]
    return vector(row(0), row(1), row(2))


def turned(r: Column, v: Column) -> Column:
    return let({"r": r, "v": v}, lambda s: _turned(s["r"], s["v"]))


def _transpose(r: Column) -> Column:
    return F.array(*[r[3 * j + i] for i in range(3) for j in range(3)])


def product_of(a: Column, b: Column) -> Column:
    entry = lambda s, i, j: s["a"][3 * i] * s["b"][j] + s["a"][3 * i + 1] * s["b"][3 + j] + s["a"][3 * i + 2] * s["b"][6 + j]
    return let({"a": a, "b": b}, lambda s: F.array(*[entry(s, i, j) for i in range(3) for j in range(3)]))


def axis_angle(axis: Column, angle: Column) -> Column:
    """Rotation by ``angle`` about a unit ``axis``."""

    def matrix(v: Column) -> Column:
        x, y, z, c, s = v["u"]["x"], v["u"]["y"], v["u"]["z"], v["c"], v["s"]
        k = 1 - c
        return rotation(c + x * x * k, x * y * k - z * s, x * z * k + y * s, y * x * k + z * s, c + y * y * k, y * z * k - x * s, z * x * k - y * s, z * y * k + x * s, c + z * z * k)

    return let({"u": axis, "c": F.cos(angle), "s": F.sin(angle)}, matrix)


def _usual(s: Column) -> Column:
    x, y, z, c = s["v"]["x"], s["v"]["y"], s["v"]["z"], s["c"]
    k = 1 / (1 + c)
    return rotation(1 - (y * y + z * z) * k, x * y * k - z, x * z * k + y, x * y * k + z, 1 - (x * x + z * z) * k, y * z * k - x, x * z * k - y, y * z * k + x, 1 - (x * x + y * y) * k)


def _half_turn(u: Column) -> Column:
    x, y, z = u["x"], u["y"], u["z"]
    return rotation(2 * x * x - 1, 2 * x * y, 2 * x * z, 2 * y * x, 2 * y * y - 1, 2 * y * z, 2 * z * x, 2 * z * y, 2 * z * z - 1)


def _across(p: Column) -> Column:
    ax, ay, az = F.abs(p["x"]), F.abs(p["y"]), F.abs(p["z"])
    return F.when((ax <= ay) & (ax <= az), vector(F.lit(0.0), p["z"], -p["y"])).when(ay <= az, vector(-p["z"], F.lit(0.0), p["x"])).otherwise(vector(p["y"], -p["x"], F.lit(0.0)))


def aligning(a: Column, b: Column) -> Column:
    """The least rotation that takes the direction of ``b`` to that of ``a``; an error for a zero vector, null for a null one.

    Opposite directions turn by half a circle about an axis across the least entry of ``a``.
    """

    def between(s: Column) -> Column:
        kept = let({"p": s["p"], "v": _cross(s["q"], s["p"]), "c": _dot(s["q"], s["p"])}, lambda t: F.when(t["c"] > -1 + 1e-12, _usual(t)).otherwise(let({"u": unit(_across(t["p"]))}, lambda w: _half_turn(w["u"]))))
        return F.when(F.isnan(s["p"]["x"]) | F.isnan(s["q"]["x"]) | s["p"]["x"].isNull() | s["q"]["x"].isNull(), F.lit(None)).otherwise(kept)

    safe = lambda v: let({"v": v}, lambda s: F.when(_dot(s["v"], s["v"]) > 0, unit(s["v"])).when(s["v"].isNotNull() & (_dot(s["v"], s["v"]) == 0), F.raise_error(F.lit("a vector of no length has no direction to align"))))
    return let({"p": safe(a), "q": safe(b)}, between)


def frame(origin: Column, r: Column) -> Column:
    """The frame whose origin is ``origin`` and whose axes are ``r``'s columns: v goes to r^T (v - origin)."""
    return let({"o": origin, "b": let({"r": r}, lambda s: _transpose(s["r"]))}, lambda s: F.struct(s["b"].alias("r"), scale(_turned(s["b"], s["o"]), -1.0).alias("t")))


def applied(f: Column, v: Column) -> Column:
    return let({"f": f, "v": v}, lambda s: add(_turned(s["f"]["r"], s["v"]), s["f"]["t"]))


def composed(second: Column, first: Column) -> Column:
    """``first``, then ``second``."""
    return let({"a": second, "b": first}, lambda s: F.struct(product_of(s["a"]["r"], s["b"]["r"]).alias("r"), applied(s["a"], s["b"]["t"]).alias("t")))


def inverted(f: Column) -> Column:
    return let({"t": f["t"], "b": let({"r": f["r"]}, lambda s: _transpose(s["r"]))}, lambda s: F.struct(s["b"].alias("r"), scale(_turned(s["b"], s["t"]), -1.0).alias("t")))


def align_vectors(df: DataFrame, a: str, b: str, name: str = "rotation") -> DataFrame:
    return df.withColumn(name, aligning(F.col(a), F.col(b)))


def make_frame(df: DataFrame, origin: str, r: str, name: str = "frame") -> DataFrame:
    return df.withColumn(name, frame(F.col(origin), F.col(r)))


def frame_from_rotvec(df: DataFrame, origin: str, rotvec: str, name: str = "frame") -> DataFrame:
    v = F.col(rotvec)
    angle = F.sqrt(dot(v, v))
    axis = F.when(angle > 0, scale(v, 1 / angle)).otherwise(vector(1, 0, 0))
    return df.withColumn(name, frame(F.col(origin), axis_angle(axis, angle)))


def compose_invert_frames(df: DataFrame, second: str, first: str) -> DataFrame:
    return df.withColumn("composed", composed(F.col(second), F.col(first))).withColumn("inverse", inverted(F.col(first)))


def unit_directions(dirs: DataFrame) -> DataFrame:
    n = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)
    return dirs.select("neighbor_id", (F.col("dx") / n).alias("dx"), (F.col("dy") / n).alias("dy"), (F.col("dz") / n).alias("dz"))


def pairwise_rotations(dirs: DataFrame) -> DataFrame:
    """(i, j, rotation that sends direction i to direction j), over a fixed set of at most some dozens."""
    one = dirs.select(F.col("neighbor_id").alias("i"), vector("dx", "dy", "dz").alias("a"))
    two = F.broadcast(dirs.select(F.col("neighbor_id").alias("j"), vector("dx", "dy", "dz").alias("b")))
    return one.crossJoin(two).select("i", "j", aligning(F.col("b"), F.col("a")).alias("rotation"))


def nearest_direction(vectors: DataFrame, dirs: list[tuple[float, float, float]], v: str = "v", name: str = "nearest") -> DataFrame:
    """Index of the closest direction, the first on ties; ``dirs`` is a literal array."""
    x = F.col(v)
    options = [F.struct(((x["x"] - F.lit(a)) ** 2 + (x["y"] - F.lit(b)) ** 2 + (x["z"] - F.lit(c)) ** 2).alias("d"), F.lit(i).alias("i")) for i, (a, b, c) in enumerate(dirs)]
    return vectors.withColumn(name, F.array_min(F.array(*options))["i"])

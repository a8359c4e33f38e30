"""Directions, rotations, frames, draws, plans, images."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from zoneforge import fixtures as fx
from zoneforge.catalog import query
from zoneforge.catalog.stored import _values
from zoneforge.fixtures import table, with_sql
from zoneforge.functions import frames as f
from zoneforge.functions import random as r
from zoneforge.operators import raster, sampling

ATOMS = with_sql("fx_atoms")
#: Vectors of the embeddings: v, a and b.
_VEC = "WITH s AS (SELECT vec_id AS i, label, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS {n}" for k, n in enumerate(("vx", "vy", "vz", "ax", "ay", "az", "kx", "ky", "kz"))) + " FROM embeddings)"


def vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    part = lambda k: F.element_at("embedding", k).cast("double")
    return e.select(F.col("vec_id").alias("i"), "label", f.vector(part(1), part(2), part(3)).alias("v"), f.vector(part(4), part(5), part(6)).alias("a"), f.vector(part(7), part(8), part(9)).alias("b"))


def xyz(v, prefix=""):
    return [F.round(v[c], 6).alias(f"{prefix}{c}") for c in "xyz"]


class V:
    """A vector of SQL expressions."""

    def __init__(self, x, y, z):
        self.p = (x, y, z)

    def __add__(self, o):
        return V(*(f"({a} + {b})" for a, b in zip(self.p, o.p, strict=True)))

    def __sub__(self, o):
        return V(*(f"({a} - {b})" for a, b in zip(self.p, o.p, strict=True)))

    def __neg__(self):
        return V(*(f"(-{a})" for a in self.p))

    def times(self, s):
        return V(*(f"({a} * ({s}))" for a in self.p))

    def dot(self, o):
        return "(" + " + ".join(f"{a} * {b}" for a, b in zip(self.p, o.p, strict=True)) + ")"

    def cross(self, o):
        (a, b, c), (d, e, g) = self.p, o.p
        return V(f"({b} * {g} - {c} * {e})", f"({c} * {d} - {a} * {g})", f"({a} * {e} - {b} * {d})")

    def unit(self):
        return self.times(f"1 / sqrt({self.dot(self)})")

    def turned(self, axis, angle):
        """Rodrigues' formula, for a unit axis."""
        return self.times(f"cos({angle})") + axis.cross(self).times(f"sin({angle})") + axis.times(f"{axis.dot(self)} * (1 - cos({angle}))")

    def aligned(self, a, b):
        """Turned as unit ``b`` turns to unit ``a``."""
        k = b.cross(a)
        return self + k.cross(self) + k.cross(k.cross(self)).times(f"1 / (1 + {a.dot(b)})")

    def out(self, prefix=""):
        return ", ".join(f"round({e}, 6) AS {prefix}{c}" for e, c in zip(self.p, "xyz", strict=True))

    def named(self, prefix):
        return ", ".join(f"{e} AS {prefix}{c}" for e, c in zip(self.p, "xyz", strict=True))


def col(prefix):
    return V(*(f"{prefix}{c}" for c in "xyz"))


def u(slot, seed="i"):
    return f"(CAST(concat('0x', substr(md5(concat({seed}, ':{slot}')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def sphere(slot, seed="i"):
    z, phi = f"(2 * {u(slot, seed)} - 1)", f"({2 * math.pi!r} * {u(slot + 1, seed)})"
    return V(f"(sqrt(1 - {z} * {z}) * cos({phi}))", f"(sqrt(1 - {z} * {z}) * sin({phi}))", z)


SETS = ("tetrahedron", "cube", "octahedron", "dodecahedron", "icosahedron", "octahedron+cube", "icosahedron+dodecahedron", "icosphere2", "icosphere3")


def dirs_sql(name, distance=1.0):
    return f"(SELECT neighbor_id, CAST(dx AS DOUBLE) AS dx, CAST(dy AS DOUBLE) AS dy, CAST(dz AS DOUBLE) AS dz FROM {_values([(i, *(float(distance * v) for v in p)) for i, p in enumerate(f.directions(name))])} d(neighbor_id, dx, dy, dz))"


@query(_VEC + " " + " UNION ALL ".join(f"SELECT '{n}' AS name, s.i, CAST(d.neighbor_id AS INT) AS neighbor_id, round(vx*dx + vy*dy + vz*dz, 6) AS along FROM s, {dirs_sql(n)} d" for n in SETS))
def direction_sets(spark, sf):
    from functools import reduce

    s = vectors(spark, sf)
    parts = [s.crossJoin(F.broadcast(f.direction_sets(spark, n))).select(F.lit(n).alias("name"), "i", "neighbor_id", F.round(F.col("v.x") * F.col("dx") + F.col("v.y") * F.col("dy") + F.col("v.z") * F.col("dz"), 6).alias("along")) for n in SETS]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(_VEC + f" SELECT s.i, CAST(d.neighbor_id AS INT) AS neighbor_id, round(vx*dx + vy*dy + vz*dz, 6) AS along FROM s, (SELECT * FROM {dirs_sql('cube', 3.0)} UNION ALL SELECT neighbor_id + 6, dx, dy, dz FROM {dirs_sql('tetrahedron', 2.0)}) d")
def union_directions(spark, sf):
    both = f.union_directions(f.direction_sets(spark, "cube", 3.0), f.direction_sets(spark, "tetrahedron", 2.0))
    return vectors(spark, sf).crossJoin(F.broadcast(both)).select("i", "neighbor_id", F.round(F.col("v.x") * F.col("dx") + F.col("v.y") * F.col("dy") + F.col("v.z") * F.col("dz"), 6).alias("along"))


@query(_VEC + f" SELECT s.i, CAST(d.neighbor_id AS INT) AS neighbor_id, round(vx*dx + vy*dy + vz*dz, 6) AS along FROM s, {dirs_sql('dodecahedron')} d")
def unit_directions(spark, sf):
    dirs = f.unit_directions(f.direction_sets(spark, "dodecahedron", 7.5))
    return vectors(spark, sf).crossJoin(F.broadcast(dirs)).select("i", "neighbor_id", F.round(F.col("v.x") * F.col("dx") + F.col("v.y") * F.col("dy") + F.col("v.z") * F.col("dz"), 6).alias("along"))


@query(_VEC + f" SELECT i, {col('v').aligned(col('a').unit(), col('k').unit()).out()} FROM s")
def align_vectors(spark, sf):
    return f.align_vectors(vectors(spark, sf), "a", "b").select("i", *xyz(f.turned(F.col("rotation"), F.col("v"))))


_PAIR = f", p AS (SELECT s.*, a.dx AS px, a.dy AS py, a.dz AS pz, b.dx AS qx, b.dy AS qy, b.dz AS qz FROM s JOIN {dirs_sql('tetrahedron')} a ON a.neighbor_id = s.i % 4 JOIN {dirs_sql('tetrahedron')} b ON b.neighbor_id = s.label % 4)"


@query(_VEC + _PAIR + f" SELECT i, {col('v').aligned(col('q'), col('p')).out()} FROM p")
def pairwise_rotations(spark, sf):
    table_ = f.pairwise_rotations(f.direction_sets(spark, "tetrahedron")).withColumnRenamed("i", "i_")
    s = vectors(spark, sf).withColumn("i_", (F.col("i") % 4).cast("int")).withColumn("j", (F.col("label") % 4).cast("int"))
    return s.join(F.broadcast(table_), ["i_", "j"]).select("i", *xyz(f.turned(F.col("rotation"), F.col("v"))))


@query(_VEC + f" SELECT i, CAST(arg_min(neighbor_id, (vx-dx)*(vx-dx) + (vy-dy)*(vy-dy) + (vz-dz)*(vz-dz)) AS INT) AS nearest FROM s, {dirs_sql('icosahedron')} d GROUP BY i")
def nearest_direction(spark, sf):
    return f.nearest_direction(vectors(spark, sf), f.directions("icosahedron")).select("i", "nearest")


_O = col("a")  # origin


@query(_VEC + f" SELECT i, {(col('v') - _O).aligned(V('0', '0', '1'), col('k').unit()).out()} FROM s")
def make_frame(spark, sf):
    s = vectors(spark, sf).withColumn("up", f.vector(0, 0, 1))
    s = f.make_frame(f.align_vectors(s, "b", "up"), "a", "rotation")
    return s.select("i", *xyz(f.applied(F.col("frame"), F.col("v"))))


_ANGLE = f"sqrt({col('k').dot(col('k'))})"


@query(_VEC + f" SELECT i, {(col('v') - _O).turned(col('k').unit(), '-' + _ANGLE).out()} FROM s")
def frame_from_rotvec(spark, sf):
    return f.frame_from_rotvec(vectors(spark, sf), "a", "b").select("i", *xyz(f.applied(F.col("frame"), F.col("v"))))


@query(_VEC + f", one AS (SELECT *, {(col('v') - _O).turned(col('k').unit(), '-' + _ANGLE).named('w')} FROM s), two AS (SELECT *, {(col('w') - col('k')).turned(col('a').unit(), f'-sqrt({_O.dot(_O)})').named('t')} FROM one) SELECT i, {col('t').out()}, {col('v').out('back_')} FROM two")
def compose_invert_frames(spark, sf):
    s = f.frame_from_rotvec(vectors(spark, sf), "a", "b", "first")
    s = f.compose_invert_frames(f.frame_from_rotvec(s, "b", "a", "second"), "second", "first")
    return s.select("i", *xyz(f.applied(F.col("composed"), F.col("v"))), *xyz(f.applied(F.col("inverse"), f.applied(F.col("first"), F.col("v"))), "back_"))


@query(f"SELECT event_id AS i, {u(0, 'event_id')} AS u0, {u(1, 'event_id')} AS u1 FROM events")
def uniform_stream(spark, sf):
    return r.uniform_stream(table(spark, sf, "events").select(F.col("event_id").alias("i")), "i", 2)


@query("SELECT event_id AS i, zone_id FROM events JOIN (SELECT c_custkey AS zone_id, row_number() OVER (ORDER BY c_custkey) - 1 AS k, count(*) OVER () AS n FROM customer) ON k = event_id % n")
def sample_index(spark, sf):
    n = table(spark, sf, "events").count()
    return sampling.sample_index(table(spark, sf, "customer").select(F.col("c_custkey").alias("zone_id")), 0, n)


_CUBE = V(*(f"({c} + 5 * ({u(k)} - 0.5))" for k, c in enumerate(("ax", "ay", "az"))))


@query(_VEC + f" SELECT i, {_CUBE.out()} FROM s")
def sample_in_cube(spark, sf):
    return r.sample_in_cube(vectors(spark, sf).withColumnRenamed("a", "center"), 5.0).select("i", *xyz(F.col("origin")))


@query(_VEC + f" SELECT i, {sphere(3).out()} FROM s")
def sample_unit_vector(spark, sf):
    return r.sample_unit_vector(vectors(spark, sf).drop("v"), 3).select("i", *xyz(F.col("v")))


@query(_VEC + f" SELECT i, {(col('v') - _O).turned(sphere(10), f'(-{2 * math.pi!r} * {u(12)})').out()} FROM s")
def sample_frame(spark, sf):
    return r.sample_frame(vectors(spark, sf), "a").select("i", *xyz(f.applied(F.col("frame"), F.col("v"))))


_NOISE = (col("v") - sphere(20).times(f"{u(22)} * 2.0")).turned(sphere(24), f"(-radians({u(23)} * 10.0))")


@query(_VEC + f" SELECT i, {_NOISE.out()} FROM s")
def sample_noise_frame(spark, sf):
    return r.sample_noise_frame(vectors(spark, sf), 2.0, 10.0).select("i", *xyz(f.applied(F.col("noise"), F.col("v"))))


_DRAW = f", d AS (SELECT *, {sphere(5).named('x')} FROM s), n AS (SELECT d.i, CAST(arg_min(t.neighbor_id, (xx-dx)*(xx-dx)+(xy-dy)*(xy-dy)+(xz-dz)*(xz-dz)) AS INT) AS near FROM d, {dirs_sql('tetrahedron')} t GROUP BY 1), k AS (SELECT d.*, near, CASE WHEN label % 2 = 0 THEN CAST(floor({u(7)} * 2) AS INT) + 1 ELSE 3 END AS pick FROM d JOIN n USING (i)), m AS (SELECT k.*, a.dx AS px, a.dy AS py, a.dz AS pz, b.dx AS qx, b.dy AS qy, b.dz AS qz FROM k JOIN {dirs_sql('tetrahedron')} a ON a.neighbor_id = near JOIN {dirs_sql('tetrahedron')} b ON b.neighbor_id = pick)"


def _with_neighbors(spark, sf):
    return vectors(spark, sf).withColumn("neighbor_ids", F.when(F.col("label") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(3))))


@query(_VEC + _DRAW.replace("{u(7)}", u(7)) + f" SELECT i, {col('x').aligned(col('q'), col('p')).out()} FROM m")
def sample_direction_near(spark, sf):
    return sampling.sample_direction_near(_with_neighbors(spark, sf), f.directions("tetrahedron")).select("i", *xyz(F.col("direction")))


_HOME = _CUBE
_NF = (
    _VEC + _DRAW + f", w AS (SELECT *, {col('x').aligned(col('q'), col('p')).named('g')}, {_CUBE.named('o')}, CAST(floor({u(9)} * 4) AS INT) AS lab FROM m), l AS (SELECT w.*, t.dx AS ex, t.dy AS ey, t.dz AS ez FROM w JOIN {dirs_sql('tetrahedron')} t ON t.neighbor_id = lab),"
    + f" h AS (SELECT *, {(col('v') - col('o')).aligned(col('e'), col('g').unit()).named('h')} FROM l), b AS (SELECT *, {(col('h') - col('e').times('30.0')).named('b_')} FROM h),"
    + f" c AS (SELECT *, {(col('b_') - sphere(20).times(f'{u(22)} * 2.0')).turned(sphere(24), f'(-radians({u(23)} * 10.0))').named('c_')} FROM b) SELECT i, lab AS label, {col('h').out('a_')}, {col('c_').out('c_')} FROM c"
)


@query(_NF)
def neighbor_frames(spark, sf):
    params = sampling.NeighborParams("tetrahedron", length=24.0, padding=6.0, noise_distance=2.0, noise_angle=10.0, threshold=1)
    s = _with_neighbors(spark, sf).withColumnRenamed("a", "center").drop("label").withColumn("neighbor_ids", F.col("neighbor_ids"))
    out = sampling.neighbor_frames(s, f.directions("tetrahedron"), params, 5.0)
    return out.select("i", "label", *xyz(f.applied(F.col("frame_a"), F.col("v")), "a_"), *xyz(f.applied(F.col("frame_c"), F.col("v")), "c_"))


@query(with_sql("fx_structure") + " SELECT pdb_id, CASE split WHEN 'train' THEN 2.0::DOUBLE ELSE 0 END AS noise_distance, CASE split WHEN 'train' THEN 10.0::DOUBLE ELSE 0 END AS noise_angle FROM fx_structure")
def noise_by_split(spark, sf):
    params = sampling.NeighborParams(distance=30.0, noise_distance=2.0, noise_angle=10.0)
    return sampling.noise_by_split(params, fx.structure(spark, sf)).select("pdb_id", "noise_distance", "noise_angle")


def _plan_sql() -> str:
    """Rounds of pairs that swap or not, over the positions of all events."""
    out = "WITH c AS (SELECT count(*) AS n FROM customer), e AS (SELECT count(*) AS m FROM events), r0 AS (SELECT pos, pos AS x FROM range((SELECT m FROM e)) t(pos))"
    for k, key in enumerate(sampling.round_keys(5, 2)):
        out += f", p{k} AS (SELECT pos, x, ({key} % m - x + m) % m AS p FROM r{k}, e), r{k + 1} AS (SELECT pos, CASE WHEN substr(md5(concat('5:2:{k}:', greatest(x, p))), 1, 1) < '8' THEN p ELSE x END AS x FROM p{k})"
    return out + f", q AS (SELECT pos, x + 2 * m AS i, (x + 2 * m) % n AS zone_index FROM r{sampling.ROUNDS}, e, c), p AS (SELECT * FROM events)"


_PLAN = _plan_sql()


def _plan(spark, sf):
    zones = table(spark, sf, "customer")
    return sampling.epoch_plan(zones.count(), 2, table(spark, sf, "events").count(), 5, True, zones)


@query(_PLAN + " SELECT pos, i, zone_index FROM q")
def epoch_plan(spark, sf):
    return _plan(spark, sf)


@query(_PLAN + " SELECT pos // 64 AS batch, pos, i, zone_index FROM q WHERE pos < (SELECT count(*) FROM p) // 64 * 64")
def batch_plan(spark, sf):
    return sampling.batch_plan(_plan(spark, sf), 64).select("batch", "pos", "i", "zone_index")


@query(ATOMS + ", s AS (SELECT assembly_id AS i, avg(x) AS ox, avg(y) AS oy, avg(z) AS oz FROM fx_atoms GROUP BY 1) SELECT i, atom_id, round(x - ox, 6) AS x, round(y - oy, 6) AS y, round(z - oz, 6) AS z FROM fx_atoms JOIN s ON i = assembly_id")
def apply_frames(spark, sf):
    atoms = fx.atoms(spark, sf)
    middle = atoms.groupBy("assembly_id").agg(*[F.avg(c).alias(c) for c in "xyz"]).withColumn("origin", f.vector("x", "y", "z")).withColumn("rotation", f.rotation(*f.IDENTITY))
    frames = f.make_frame(middle, "origin", "rotation").withColumn("i", F.col("assembly_id"))
    return sampling.apply_frames(atoms, frames).select("i", "atom_id", *[F.round(c, 6).alias(c) for c in "xyz"])


GRID = raster.Grid(length=9, resolution=2.0, channels=4)
CHANNELS = [["C"], ["N", "O"], ["*"]]
_K = 4
_STEPS = [(2 * (k + 0.5) / _K - 1) * GRID.atom_radius for k in range(_K)]
_POINTS = [(x, y, z) for x in _STEPS for y in _STEPS for z in _STEPS if x * x + y * y + z * z <= GRID.atom_radius**2]
_CLIP = ", clip AS (SELECT assembly_id AS i, * FROM fx_atoms WHERE abs(x) < 10 AND abs(y) < 10 AND abs(z) < 10)"
_CHAN = ", chan AS (SELECT *, CASE element WHEN 'C' THEN [0] WHEN 'N' THEN [1] WHEN 'O' THEN [1] ELSE [2] END AS own FROM clip), chans AS (SELECT *, CASE WHEN is_polymer THEN list_append(own, 3) ELSE own END AS channels FROM chan)"
_RAST = f", pts(px, py, pz) AS (SELECT * FROM {_values(_POINTS)} p), rast AS (SELECT i, channel, CAST(floor((x+px+9)/2) AS INT) AS vx, CAST(floor((y+py+9)/2) AS INT) AS vy, CAST(floor((z+pz+9)/2) AS INT) AS vz, sum(occupancy / {len(_POINTS)}) AS value FROM (SELECT *, unnest(channels) AS channel FROM chans), pts WHERE floor((x+px+9)/2) BETWEEN 0 AND 8 AND floor((y+py+9)/2) BETWEEN 0 AND 8 AND floor((z+pz+9)/2) BETWEEN 0 AND 8 GROUP BY ALL)"
_DENSE = ", samples AS (SELECT DISTINCT assembly_id AS i FROM fx_atoms), dense AS (SELECT s.i, CAST(c AS INT) AS channel, CAST(a AS INT) AS vx, CAST(b AS INT) AS vy, CAST(d AS INT) AS vz, coalesce(value, 0) AS value FROM samples s CROSS JOIN range(4) t1(c) CROSS JOIN range(9) t2(a) CROSS JOIN range(9) t3(b) CROSS JOIN range(9) t4(d) LEFT JOIN rast ON rast.i = s.i AND channel = c AND vx = a AND vy = b AND vz = d)"


def _clipped(spark, sf):
    return raster.clip_to_image(fx.atoms(spark, sf).withColumn("i", F.col("assembly_id")), GRID)


def _channels(spark, sf):
    return raster.ligand_channel(raster.element_channels(_clipped(spark, sf), CHANNELS), "is_polymer", 3)


def _samples(spark, sf):
    return fx.atoms(spark, sf).select(F.col("assembly_id").alias("i")).distinct()


@query(ATOMS + _CLIP + " SELECT i, atom_id FROM clip")
def clip_to_image(spark, sf):
    return _clipped(spark, sf).select("i", "atom_id")


@query(ATOMS + _CLIP + _CHAN + " SELECT i, atom_id, own AS channels FROM chan")
def element_channels(spark, sf):
    return raster.element_channels(_clipped(spark, sf), CHANNELS).select("i", "atom_id", "channels")


@query(ATOMS + _CLIP + _CHAN + " SELECT i, atom_id, channels FROM chans")
def ligand_channel(spark, sf):
    return _channels(spark, sf).select("i", "atom_id", "channels")


@query(ATOMS + _CLIP + _CHAN + _RAST + " SELECT i, channel, vx, vy, vz, round(value, 6) AS value FROM rast")
def rasterize(spark, sf):
    return raster.rasterize(_channels(spark, sf), GRID, _K).withColumn("value", F.round("value", 6))


@query(ATOMS + _CLIP + _CHAN + _RAST + _DENSE + " SELECT i, channel, vx, vy, vz, round((value - [0.1, 0.2, 0.0, 0.3][channel+1]) / [0.5, 1.0, 2.0, 0.25][channel+1], 6) AS value FROM dense")
def normalize_image(spark, sf):
    voxels = raster.rasterize(_channels(spark, sf), GRID, _K)
    return raster.normalize_image(voxels, _samples(spark, sf), GRID, [0.1, 0.2, 0.0, 0.3], [0.5, 1.0, 2.0, 0.25]).withColumn("value", F.round("value", 6))


_AT = "((channel * 9 + vx) * 9 + vy) * 9 + vz"


@query(ATOMS + _CLIP + _CHAN + _RAST + _DENSE + f" SELECT i, count(*) AS n, round(sum(value), 3) AS total, round(sum(value * (({_AT}) % 7)), 3) AS weighted FROM dense GROUP BY 1")
def pack_image(spark, sf):
    voxels = raster.dense(raster.rasterize(_channels(spark, sf), GRID, _K), _samples(spark, sf), GRID)
    return _digest(raster.pack_image(voxels, GRID), "image")


def _digest(packed, name, keep=()):
    weighted = F.aggregate(F.zip_with(name, F.sequence(F.lit(0), F.size(name) - 1), lambda v, k: v.cast("double") * (k % 7)), F.lit(0.0), lambda a, x: a + x)
    total = F.aggregate(name, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return packed.select("i", *keep, F.size(name).cast("long").alias("n"), F.round(total, 3).alias("total"), F.round(weighted, 3).alias("weighted"))


#: Spheres so small that each lies in one voxel, so the exact overlap is a count; the second view is the first one mirrored.
SMALL = raster.Grid(length=9, resolution=2.0, channels=4, radius=1e-7)
MEAN, STD = [0.1, 0.2, 0.0, 0.3], [0.5, 1.0, 2.0, 0.25]
_SEEN = ", seen AS (SELECT *, 0 AS view, x AS sx FROM chans UNION ALL SELECT *, 1, -x FROM chans)"
_SHOWN = f""", shown AS (SELECT i, view, channel, CAST(floor((sx+9)/2) AS INT) AS vx, CAST(floor((y+9)/2) AS INT) AS vy, CAST(floor((z+9)/2) AS INT) AS vz, sum(occupancy) AS value FROM (SELECT *, unnest(channels) AS channel FROM seen)
 WHERE floor((sx+9)/2) BETWEEN 0 AND 8 AND floor((y+9)/2) BETWEEN 0 AND 8 AND floor((z+9)/2) BETWEEN 0 AND 8 GROUP BY ALL),
every AS (SELECT s.i, CAST(w AS INT) AS view, CAST(c AS INT) AS channel, CAST(a AS INT) AS vx, CAST(b AS INT) AS vy, CAST(d AS INT) AS vz, (coalesce(value, 0) - {MEAN}[CAST(c + 1 AS INT)]) / {STD}[CAST(c + 1 AS INT)] AS value
 FROM (SELECT DISTINCT assembly_id AS i FROM fx_atoms) s CROSS JOIN range(2) t0(w) CROSS JOIN range(4) t1(c) CROSS JOIN range(9) t2(a) CROSS JOIN range(9) t3(b) CROSS JOIN range(9) t4(d) LEFT JOIN shown r ON r.i = s.i AND r.view = w AND channel = c AND vx = a AND vy = b AND vz = d)"""


def _stacks(spark, sf):
    chans = _channels(spark, sf).select("i", "channels", "x", "y", "z", "occupancy")
    seen = chans.withColumn("view", F.lit(0)).unionByName(chans.withColumns({"view": F.lit(1), "x": -F.col("x")}))
    return raster.image_stacks(seen, _samples(spark, sf), SMALL, 2, MEAN, STD)


@query(ATOMS + _CLIP + _CHAN + _SEEN + _SHOWN + f" SELECT i, view, count(*) AS n, round(sum(value), 3) AS total, round(sum(value * (({_AT}) % 7)), 3) AS weighted FROM every GROUP BY 1, 2")
def image_stacks(spark, sf):
    one = _stacks(spark, sf).select("i", F.posexplode("images").alias("view", "image"))
    return _digest(one, "image", ("view",))


@query(ATOMS + _CLIP + _CHAN + f", kept AS (SELECT i, unnest(channels) AS channel, occupancy FROM chans WHERE abs(x) < 8 AND abs(y) < 8 AND abs(z) < 8) SELECT i, CAST(channel AS INT) AS channel, round(sum(occupancy), 4) AS total FROM kept GROUP BY 1, 2")
def rasterize_overlaps(spark, sf):
    """Spheres of the voxels' own radius, wholly inside: the voxels of a channel sum to the occupancy, whatever their shares."""
    inside = _channels(spark, sf).where("abs(x) < 8 AND abs(y) < 8 AND abs(z) < 8")
    return raster.rasterize(inside, GRID).groupBy("i", "channel").agg(F.round(F.sum("value"), 4).alias("total"))


@query(ATOMS + _CLIP + _CHAN + _RAST + _DENSE + " SELECT i, CAST(i % 6 AS INT) AS label, 2 AS views, round(sum(value), 3) AS total_a, round(sum(value) * 2, 3) AS total_b FROM dense GROUP BY 1")
def image_pair(spark, sf):
    voxels = raster.dense(raster.rasterize(_channels(spark, sf), GRID, _K), _samples(spark, sf), GRID)
    labels = _samples(spark, sf).withColumn("label", (F.col("i") % 6).cast("int"))
    pairs = raster.image_pair(voxels, voxels.withColumn("value", F.col("value") * 2), labels, GRID)
    total = lambda k: F.round(F.aggregate(F.col("images")[k], F.lit(0.0), lambda a, x: a + x.cast("double")), 3)
    return pairs.select("i", "label", F.size("images").alias("views"), total(0).alias("total_a"), total(1).alias("total_b"))

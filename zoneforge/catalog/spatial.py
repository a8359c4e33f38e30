"""Filters, annotation, range joins, counts, densities."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from zoneforge import fixtures as fx
from zoneforge.catalog import query
from zoneforge.catalog.samples import V
from zoneforge.catalog.stored import _values
from zoneforge.fixtures import table, with_sql
from zoneforge.functions import frames
from zoneforge.functions.storage import new_path
from zoneforge.operators import annotate, density, filters, spatial
from zoneforge.operators.tables import dense_index

ATOMS = with_sql("fx_atoms")
R, SPACING = 15.0, 15.0
VOL = spatial.sphere_volume_nm3(R)


def steps(c: str, side: str) -> str:
    gap = f"avg({c}) - min({c})" if side == "low" else f"max({c}) - avg({c})"
    return f"CAST(ceil(({gap} - {SPACING / 2}) / {SPACING}) AS BIGINT)"


#: Zones of the identity grid over fx_atoms, their density, and helper views; they follow ATOMS.
ZONES = f""", axes AS (SELECT assembly_id, {", ".join(f"avg({c}) AS a{c}, {steps(c, 'low')} AS l{c}, {steps(c, 'high')} AS h{c}" for c in "xyz")} FROM fx_atoms GROUP BY assembly_id),
grid AS (SELECT assembly_id, round(ax + gx*{SPACING}, 6) AS cx, round(ay + gy*{SPACING}, 6) AS cy, round(az + gz*{SPACING}, 6) AS cz FROM axes, range(-20, 21) x(gx), range(-20, 21) y(gy), range(-20, 21) z(gz)
 WHERE gx BETWEEN -lx AND hx AND gy BETWEEN -ly AND hy AND gz BETWEEN -lz AND hz),
zones AS (SELECT *, row_number() OVER (ORDER BY assembly_id, cx, cy, cz) - 1 AS zone_id FROM grid)"""
NEAR = f""", near AS (SELECT z.zone_id, a.* FROM zones z JOIN fx_atoms a ON a.assembly_id = z.assembly_id AND (cx-x)*(cx-x)+(cy-y)*(cy-y)+(cz-z)*(cz-z) <= {R * R})""".replace("cz-z)", "cz-a.z)")
DENSE = f""", dens AS (SELECT z.zone_id, z.assembly_id, cx, cy, cz, coalesce(sum(occupancy), 0) / {VOL!r} AS density FROM zones z LEFT JOIN near n ON n.zone_id = z.zone_id GROUP BY ALL)"""
LIMIT = 12.0


def zones(spark, sf):
    grid = spatial.zone_grid(fx.atoms(spark, sf), SPACING, "identity")
    return dense_index(grid.select("assembly_id", *[F.round(c, 6).alias(c) for c in spatial.CENTER]), ["assembly_id", *spatial.CENTER], "zone_id")


def measured(spark, sf):
    return spatial.exact_density(fx.atoms(spark, sf), zones(spark, sf), R)


@query(ATOMS + " SELECT * FROM fx_atoms WHERE (atom_id//21) % 2 = 0")
def select_model(spark, sf):
    atoms = fx.atoms(spark, sf).withColumn("pdb_id", F.col("assembly_id").cast("string")).withColumn("model_id", (F.floor(F.col("atom_id") / 21) % 2).cast("string"))
    structure = atoms.select("pdb_id").distinct().withColumn("model_id", F.lit("0"))
    return filters.select_model(atoms, structure).drop("pdb_id", "model_id")


@query(ATOMS + " SELECT assembly_id, atom_id, CASE comp_id WHEN 'GOL' THEN 'HOH' ELSE comp_id END AS comp_id FROM fx_atoms WHERE comp_id <> 'GOL'")
def prune_water(spark, sf):
    atoms = fx.atoms(spark, sf).selectExpr("assembly_id", "atom_id", "CASE comp_id WHEN 'GOL' THEN 'HOH' ELSE comp_id END AS comp_id")
    return filters.prune_water(atoms)


@query(ATOMS + " SELECT assembly_id, atom_id, element FROM fx_atoms WHERE element <> 'N'")
def prune_hydrogen(spark, sf):
    atoms = fx.atoms(spark, sf).selectExpr("assembly_id", "atom_id", "CASE element WHEN 'N' THEN 'H' ELSE element END AS element")
    return filters.prune_hydrogen(atoms)


@query(ATOMS + " SELECT assembly_id, bool_and(upper(element) IN ('C','N','O','S','P')) AS ok FROM fx_atoms GROUP BY assembly_id")
def check_elements(spark, sf):
    return filters.check_elements(fx.atoms(spark, sf), ["c", "N", "O", "S", "P"])


@query(with_sql("fx_structure") + " SELECT * FROM fx_structure WHERE pdb_id NOT IN ('s3', 's14')")
def exclude_structures(spark, sf):
    return filters.exclude_structures(fx.structure(spark, sf), ["s3", "s14"])


@query(ATOMS + " SELECT assembly_id, atom_id, comp_id, is_polymer FROM fx_atoms WHERE NOT (comp_id IN ('GOL','PEG') AND NOT is_polymer)")
def prune_nonbiological(spark, sf):
    return filters.prune_nonbiological(fx.atoms(spark, sf), ["GOL", "PEG"]).select("assembly_id", "atom_id", "comp_id", "is_polymer")


VOXEL = 4.0
GRID = f""", vox AS (SELECT assembly_id, CAST(floor(x/{VOXEL}) AS BIGINT) AS ix, CAST(floor(y/{VOXEL}) AS BIGINT) AS iy, CAST(floor(z/{VOXEL}) AS BIGINT) AS iz, sum(occupancy) / {(VOXEL / 10) ** 3!r} AS rho FROM fx_atoms GROUP BY 1, 2, 3, 4)"""
RADIUS = 6.0
KERNEL = f", kern(dx, dy, dz, w) AS (SELECT * FROM {_values(density.kernel_cells(RADIUS, VOXEL))} k)"
SMOOTH = ", smooth AS (SELECT assembly_id, ix+dx AS ix, iy+dy AS iy, iz+dz AS iz, sum(rho*w) AS rho FROM vox, kern GROUP BY 1, 2, 3, 4)"


def voxels(spark, sf):
    return density.voxel_occupancy(fx.atoms(spark, sf), VOXEL)


@query(ATOMS + GRID + " SELECT assembly_id, ix, iy, iz, round(rho, 6) AS rho FROM vox")
def voxel_occupancy(spark, sf):
    return voxels(spark, sf).withColumn("rho", F.round("rho", 6))


@query(ATOMS + GRID + KERNEL + SMOOTH + " SELECT assembly_id, ix, iy, iz, round(rho, 6) AS rho FROM smooth WHERE rho > 0.001")
def smooth_density(spark, sf):
    return density.smooth_density(voxels(spark, sf), RADIUS, VOXEL, "relational").where("rho > 0.001").withColumn("rho", F.round("rho", 6))


@query(ATOMS + GRID + KERNEL + SMOOTH + " SELECT assembly_id, ix, iy, iz, round(rho, 6) AS rho FROM smooth WHERE rho > 0.001")
def smooth_density_fft(spark, sf):
    return density.smooth_density(voxels(spark, sf), RADIUS, VOXEL, "fft").where("rho > 0.001").withColumn("rho", F.round("rho", 6))


@query(ATOMS + GRID + KERNEL + " SELECT assembly_id, count(*) AS n, round(sum(rho*w), 6) AS total FROM vox, kern GROUP BY assembly_id")
def sphere_kernel(spark, sf):
    spread = voxels(spark, sf).crossJoin(F.broadcast(density.sphere_kernel(spark, RADIUS, VOXEL)))
    return spread.groupBy("assembly_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("rho") * F.col("w")), 6).alias("total"))


@query(ATOMS + GRID + KERNEL + SMOOTH + " SELECT assembly_id, round(max(rho), 6) AS max_rho FROM smooth GROUP BY 1")
def max_density(spark, sf):
    return density.max_density(density.smooth_density(voxels(spark, sf), RADIUS, VOXEL)).withColumn("max_rho", F.round("max_rho", 6))


@query(ATOMS + GRID + KERNEL + SMOOTH + ", bad AS (SELECT assembly_id FROM smooth GROUP BY 1 HAVING max(rho) > 33) SELECT assembly_id, count(*) AS n FROM fx_atoms WHERE assembly_id NOT IN (SELECT * FROM bad) GROUP BY 1")
def gate_max_density(spark, sf):
    grid = density.smooth_density(voxels(spark, sf), RADIUS, VOXEL)
    return filters.gate_max_density(fx.atoms(spark, sf), grid, 33.0).groupBy("assembly_id").agg(F.count(F.lit(1)).alias("n"))


_U = ", ".join(f"c{c}/{VOXEL} - 0.5 AS u{c}" for c in "xyz")
_W = "*".join(f"(CASE o{c} WHEN 1 THEN u{c} - floor(u{c}) ELSE 1 - (u{c} - floor(u{c})) END)" for c in "xyz")


@query(
    ATOMS + ZONES + GRID + KERNEL + SMOOTH + f""", box AS (SELECT assembly_id, {", ".join(f"min(i{c}) AS l{c}, max(i{c}) AS h{c}" for c in "xyz")} FROM smooth GROUP BY 1), u AS (SELECT zone_id, assembly_id, {_U} FROM zones),
 corner AS (SELECT u.assembly_id, zone_id, {", ".join(f"CAST(floor(u{c}) AS BIGINT) + o{c} AS i{c}" for c in "xyz")}, {_W} AS w FROM u JOIN box ON box.assembly_id = u.assembly_id, range(2) a(ox), range(2) b(oy), range(2) c(oz) WHERE ux BETWEEN lx AND hx AND uy BETWEEN ly AND hy AND uz BETWEEN lz AND hz),
 hit AS (SELECT zone_id, sum(w*rho) AS d FROM corner JOIN smooth USING (assembly_id, ix, iy, iz) GROUP BY 1) SELECT zones.zone_id, round(coalesce(d, 0), 6) AS density FROM zones LEFT JOIN hit ON hit.zone_id = zones.zone_id"""
)
def interpolate_density(spark, sf):
    grid = density.smooth_density(voxels(spark, sf), RADIUS, VOXEL)
    return density.interpolate_density(grid, zones(spark, sf), VOXEL).select("zone_id", F.round("density", 6).alias("density"))


#: Assemblies of at least the mean number of atoms have voxels of 5 instead of 4.
MIXED = (VOXEL, 5.0)
_MIXED = f""", mean AS (SELECT CAST(floor(count(*) / count(DISTINCT assembly_id)) AS BIGINT) AS m FROM fx_atoms),
sized AS (SELECT assembly_id, CASE WHEN count(*) < (SELECT m FROM mean) THEN CAST({MIXED[0]} AS DOUBLE) ELSE CAST({MIXED[1]} AS DOUBLE) END AS voxel FROM fx_atoms GROUP BY 1),
vox AS (SELECT assembly_id, voxel, CAST(floor(x/voxel) AS BIGINT) AS ix, CAST(floor(y/voxel) AS BIGINT) AS iy, CAST(floor(z/voxel) AS BIGINT) AS iz, sum(occupancy) / (voxel/10)**3 AS rho FROM fx_atoms JOIN sized USING (assembly_id) GROUP BY 1, 2, 3, 4, 5),
kern(s, dx, dy, dz, w) AS (SELECT * FROM {_values([(s, *c) for s in MIXED for c in density.kernel_cells(RADIUS, s)])} k),
smooth AS (SELECT assembly_id, voxel, ix+dx AS ix, iy+dy AS iy, iz+dz AS iz, sum(rho*w) AS rho FROM vox JOIN kern ON s = voxel GROUP BY 1, 2, 3, 4, 5)"""


def mixed_grid(spark, sf, method):
    atoms = fx.atoms(spark, sf)
    n, assemblies = atoms.agg(F.count(F.lit(1)), F.countDistinct("assembly_id")).first()
    sizes = density.coarsen_large(atoms, MIXED[0], n // assemblies, MIXED[1])
    return density.smooth_density(density.voxel_occupancy(density.with_resolution(atoms, sizes, MIXED[0])), RADIUS, method=method, sizes=MIXED)


@query(ATOMS + _MIXED + " SELECT assembly_id, voxel, ix, iy, iz, round(rho, 6) AS rho FROM smooth WHERE rho > 0.001")
def smooth_density_mixed(spark, sf):
    return mixed_grid(spark, sf, "fft").where("rho > 0.001").withColumn("rho", F.round("rho", 6))


@query(ATOMS + ZONES + _MIXED + """, box AS (SELECT assembly_id, voxel, min(ix) AS lx, max(ix) AS hx, min(iy) AS ly, max(iy) AS hy, min(iz) AS lz, max(iz) AS hz FROM smooth GROUP BY 1, 2),
spot AS (SELECT zone_id, b.*, cx/voxel-0.5 AS ux, cy/voxel-0.5 AS uy, cz/voxel-0.5 AS uz FROM zones JOIN box b USING (assembly_id)),
corner AS (SELECT zone_id, assembly_id, CAST(floor(ux) AS BIGINT)+ox AS ix, CAST(floor(uy) AS BIGINT)+oy AS iy, CAST(floor(uz) AS BIGINT)+oz AS iz,
 CASE ox WHEN 1 THEN ux-floor(ux) ELSE 1-(ux-floor(ux)) END * CASE oy WHEN 1 THEN uy-floor(uy) ELSE 1-(uy-floor(uy)) END * CASE oz WHEN 1 THEN uz-floor(uz) ELSE 1-(uz-floor(uz)) END AS w
 FROM spot, range(2) a(ox), range(2) b(oy), range(2) c(oz) WHERE ux BETWEEN lx AND hx AND uy BETWEEN ly AND hy AND uz BETWEEN lz AND hz),
met AS (SELECT zone_id, sum(w*rho) AS density FROM corner JOIN smooth USING (assembly_id, ix, iy, iz) GROUP BY 1)
SELECT z.zone_id, round(coalesce(density, 0), 6) AS density FROM zones z LEFT JOIN met m ON m.zone_id = z.zone_id""")
def interpolate_density_mixed(spark, sf):
    return density.interpolate_density(mixed_grid(spark, sf, "relational"), zones(spark, sf)).select("zone_id", F.round("density", 6).alias("density"))


@query(ATOMS + ", n AS (SELECT assembly_id, count(*) AS n_atoms FROM fx_atoms GROUP BY 1) SELECT assembly_id, n_atoms, CAST(CASE WHEN n_atoms < 1050 THEN 2 ELSE 5 END AS DOUBLE) AS voxel FROM n")
def coarsen_large(spark, sf):
    return density.coarsen_large(fx.atoms(spark, sf), 2.0, 1050)


@query(ATOMS + ZONES + " SELECT assembly_id, cx, cy, cz, zone_id FROM zones")
def zone_grid(spark, sf):
    return zones(spark, sf)


#: Eigenvectors of the covariances in closed form: eigenvalues by the cosine formula, vectors as the longest cross product of two rows of (matrix - eigenvalue).
_ROWS = [V("(xx - l)", "xy", "xz"), V("xy", "(yy - l)", "yz"), V("xz", "yz", "(zz - l)")]
_CROSS = " UNION ALL ".join(f"SELECT assembly_id, k, {_ROWS[i].cross(_ROWS[j]).named('v')} FROM val" for i, j in ((0, 1), (0, 2), (1, 2)))
_LONG = "arg_max(struct_pack(x := vx, y := vy, z := vz), vx*vx + vy*vy + vz*vz)"
_SIGN = "CASE WHEN abs(v.x) >= abs(v.y) AND abs(v.x) >= abs(v.z) THEN sign(v.x) WHEN abs(v.y) >= abs(v.z) THEN sign(v.y) ELSE sign(v.z) END / sqrt(v.x*v.x + v.y*v.y + v.z*v.z)"
AXES = f""", cov AS (SELECT assembly_id, {", ".join(f"covar_pop({a}, {b}) AS {a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))} FROM fx_atoms GROUP BY 1), mid AS (SELECT *, (xx + yy + zz) / 3 AS q FROM cov),
wide AS (SELECT *, sqrt(((xx-q)*(xx-q) + (yy-q)*(yy-q) + (zz-q)*(zz-q) + 2*(xy*xy + xz*xz + yz*yz)) / 6) AS p FROM mid),
turn AS (SELECT *, acos(greatest(-1, least(1, ((xx-q)*((yy-q)*(zz-q) - yz*yz) - xy*(xy*(zz-q) - yz*xz) + xz*(xy*yz - (yy-q)*xz)) / (2*p*p*p)))) / 3 AS phi FROM wide),
val AS (SELECT turn.*, k, q + 2*p*cos(phi + [0, 4, 2][k] * pi() / 3) AS l FROM turn, range(1, 4) r(k)), crossed AS ({_CROSS}), long AS (SELECT assembly_id, k, {_LONG} AS v FROM crossed GROUP BY 1, 2),
units AS (SELECT assembly_id, k, v, {_SIGN} AS s FROM long), paxes AS (SELECT assembly_id, {", ".join(f"max(v.{c} * s) FILTER (k = {i}) AS a{i}{j}" for i in (1, 2, 3) for j, c in enumerate("xyz", 1))} FROM units GROUP BY 1)"""
_TURNED = ", turned AS (SELECT fx_atoms.assembly_id, " + ", ".join(f"a{i}1*x + a{i}2*y + a{i}3*z AS {c}" for i, c in enumerate("xyz", 1)) + " FROM fx_atoms JOIN paxes ON paxes.assembly_id = fx_atoms.assembly_id)"
_OWN = re.sub(r"round\((a. \+ g.\*[\d.]+), 6\)", r"\1", ZONES.replace("FROM fx_atoms", "FROM turned"))


@query(ATOMS + AXES + _TURNED + _OWN + " SELECT grid.assembly_id, " + ", ".join(f"round(a1{j}*cx + a2{j}*cy + a3{j}*cz, 4) AS c{c}" for j, c in enumerate("xyz", 1)) + " FROM grid JOIN paxes ON paxes.assembly_id = grid.assembly_id")
def zone_grid_principal(spark, sf):
    return spatial.zone_grid(fx.atoms(spark, sf), SPACING).select("assembly_id", *[F.round(c, 4).alias(c) for c in spatial.CENTER])


@query(ATOMS + AXES + " SELECT assembly_id, " + ", ".join(f"round(a{i}{j}, 6) AS a{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)) + " FROM paxes")
def principal_axes(spark, sf):
    axes = spatial.principal_axes(fx.atoms(spark, sf))
    return axes.select("assembly_id", *[F.round(c, 6).alias(c) for c in axes.columns[1:]])


@query(ATOMS + ZONES + NEAR + " SELECT zone_id, assembly_id, atom_id FROM near")
def atoms_within(spark, sf):
    return spatial.atoms_within(zones(spark, sf), fx.atoms(spark, sf), R).select("zone_id", "assembly_id", "atom_id")


@query(ATOMS + ZONES + NEAR + " SELECT zone_id, assembly_id, atom_id FROM near")
def atoms_within_laid_out(spark, sf):
    """The same search on atoms that lie in buckets of assembly and cell."""
    laid = spatial.lay_out(fx.atoms(spark, sf), f"zf_atoms_{uuid.uuid4().hex}", R, new_path(spark, "laid"))
    return spatial.atoms_within(zones(spark, sf), laid, R).select("zone_id", "assembly_id", "atom_id")


@query(ATOMS + ZONES + NEAR + DENSE + " SELECT zone_id, round(density, 6) AS density FROM dens")
def exact_density(spark, sf):
    return measured(spark, sf).select("zone_id", F.round("density", 6).alias("density"))


@query(ATOMS + ZONES + NEAR + DENSE + f" SELECT zone_id, assembly_id FROM dens WHERE density > {LIMIT}")
def gate_min_density(spark, sf):
    return filters.gate_min_density(measured(spark, sf), LIMIT).select("zone_id", "assembly_id")


_PRUNE = """, best AS (SELECT a.assembly_id, a.atom_id, min((cx-x)*(cx-x)+(cy-y)*(cy-y)+(cz-a.z)*(cz-a.z)) AS d2 FROM zones s JOIN fx_atoms a ON a.assembly_id = s.assembly_id GROUP BY 1, 2)"""


@query(ATOMS + ZONES + _PRUNE + " SELECT assembly_id, atom_id, d2 > 100 AS out_of_bounds FROM best WHERE d2 <= 225")
def prune_distant_atoms(spark, sf):
    return spatial.prune_distant_atoms(zones(spark, sf), fx.atoms(spark, sf), 10.0, 5.0).select("assembly_id", "atom_id", "out_of_bounds")


@query(ATOMS + " SELECT assembly_id, subchain_id, symmetry_mate, sum(occupancy) AS occupancy FROM fx_atoms GROUP BY 1, 2, 3")
def count_atoms(spark, sf):
    return spatial.count_atoms(fx.atoms(spark, sf), ["assembly_id", "subchain_id", "symmetry_mate"])


_STEP = 8.0
_DIRS = f", dirs(neighbor_id, dx, dy, dz) AS (SELECT * FROM {_values([(i, *(_STEP * v for v in p)) for i, p in enumerate(frames.directions('cube'))])} d)"
_BESIDE = f""", beside AS (SELECT zone_id, neighbor_id, z.assembly_id, sum(occupancy) / {VOL!r} AS density FROM zones z, dirs, fx_atoms a WHERE a.assembly_id = z.assembly_id
 AND (cx+dx-a.x)*(cx+dx-a.x)+(cy+dy-a.y)*(cy+dy-a.y)+(cz+dz-a.z)*(cz+dz-a.z) <= {R * R} GROUP BY 1, 2, 3), zn AS (SELECT zone_id, CAST(neighbor_id AS INT) AS neighbor_id FROM beside WHERE density > {LIMIT})"""


def zone_neighbor(spark, sf):
    atoms = fx.atoms(spark, sf)
    return spatial.zone_neighbors(zones(spark, sf), frames.direction_sets(spark, "cube", _STEP), lambda p: spatial.exact_density(atoms, p, R), LIMIT)


@query(ATOMS + ZONES + _DIRS + _BESIDE + " SELECT zone_id, neighbor_id FROM zn")
def zone_neighbors(spark, sf):
    return zone_neighbor(spark, sf)


@query(ATOMS + ZONES + _DIRS + _BESIDE + " SELECT zone_id, list(neighbor_id ORDER BY neighbor_id) AS neighbor_ids FROM zn GROUP BY 1")
def collect_neighbors(spark, sf):
    return spatial.collect_neighbors(zone_neighbor(spark, sf))


@query(ATOMS + ZONES + _DIRS + _BESIDE + " SELECT zone_id, assembly_id FROM zones WHERE zone_id IN (SELECT zone_id FROM zn GROUP BY 1 HAVING count(*) >= 3)")
def gate_neighbor_count(spark, sf):
    z = zones(spark, sf)
    return filters.gate_neighbor_count(z, zone_neighbor(spark, sf), 3).select("zone_id", "assembly_id")


ASYM = """, asym AS (SELECT assembly_id, subchain_id, sum(occupancy) AS total FROM fx_atoms WHERE symmetry_mate = 0 AND subchain_id <> 'D' GROUP BY 1, 2),
cnt AS (SELECT n.zone_id, n.assembly_id, n.subchain_id, n.symmetry_mate, sum(occupancy) AS occupancy, total FROM near n JOIN asym USING (assembly_id, subchain_id) GROUP BY ALL),
frac AS (SELECT *, occupancy / sum(occupancy) OVER (PARTITION BY zone_id) AS fz, occupancy / total AS fs FROM cnt),
solo AS (SELECT zone_id, subchain_id, symmetry_mate FROM frac WHERE fz >= 0.3 OR fs >= 0.12), pres AS (SELECT zone_id, subchain_id, symmetry_mate FROM frac WHERE fz >= 0.2 OR fs >= 0.08),
pair AS (SELECT a.zone_id, a.subchain_id AS subchain_id_1, a.symmetry_mate AS symmetry_mate_1, b.subchain_id AS subchain_id_2, b.symmetry_mate AS symmetry_mate_2 FROM pres a JOIN pres b ON a.zone_id = b.zone_id AND (a.subchain_id < b.subchain_id OR (a.subchain_id = b.subchain_id AND a.symmetry_mate < b.symmetry_mate)))"""
SOLO, PAIR = (0.3, 0.12), (0.2, 0.08)


def asym(spark, sf):
    return spatial.count_atoms(fx.atoms(spark, sf).where("symmetry_mate = 0 AND subchain_id <> 'D'"), ["assembly_id", "subchain_id"])


@query(ATOMS + ZONES + NEAR + ASYM + " SELECT zone_id, subchain_id, symmetry_mate, occupancy, total AS occupancy_asym FROM cnt")
def join_asym_counts(spark, sf):
    near = spatial.atoms_within(zones(spark, sf), fx.atoms(spark, sf), R)
    counts = spatial.count_atoms(near, ["assembly_id", "zone_id", "subchain_id", "symmetry_mate"])
    every = spatial.count_atoms(fx.atoms(spark, sf).where("symmetry_mate = 0"), ["assembly_id", "subchain_id"])
    allowed = every.select("subchain_id").distinct().where("subchain_id <> 'D'")
    return spatial.join_asym_counts(counts, every, allowed).select("zone_id", "subchain_id", "symmetry_mate", "occupancy", "occupancy_asym")


@query(ATOMS + ZONES + NEAR + ASYM + " SELECT zone_id, subchain_id, symmetry_mate, round(fz, 6) AS fraction_of_zone, round(fs, 6) AS fraction_of_subchain FROM frac")
def subchain_fractions(spark, sf):
    shares = spatial.zone_fractions(zones(spark, sf), fx.atoms(spark, sf), asym(spark, sf), R)
    return shares.select("zone_id", "subchain_id", "symmetry_mate", *[F.round(c, 6).alias(c) for c in ("fraction_of_zone", "fraction_of_subchain")])


@query(ATOMS + ZONES + NEAR + ASYM + " SELECT * FROM solo")
def zone_subchains(spark, sf):
    return spatial.zone_subchains(zones(spark, sf), fx.atoms(spark, sf), asym(spark, sf), R, SOLO, PAIR)[0]


@query(ATOMS + ZONES + NEAR + ASYM + " SELECT * FROM pair")
def subchain_pairs(spark, sf):
    return spatial.zone_subchains(zones(spark, sf), fx.atoms(spark, sf), asym(spark, sf), R, SOLO, PAIR)[1]


@query(ATOMS + " SELECT assembly_id, atom_id, x, y, z FROM fx_atoms WHERE element = 'C' AND occupancy = 1")
def filter_atoms(spark, sf):
    return filters.filter_atoms(fx.atoms(spark, sf), lambda a: a.where("element = 'C' AND occupancy = 1").select("assembly_id", "atom_id", "x", "y", "z"))


@query(with_sql("fx_zone") + " SELECT zone_id FROM fx_zone ORDER BY zone_id LIMIT 100")
def truncate_split(spark, sf):
    return filters.truncate_split(fx.zone(spark, sf).select("zone_id"), 100)


@query(with_sql("fx_structure") + " SELECT pdb_id FROM fx_structure")
def list_structures(spark, sf):
    return filters.list_structures(fx.structure(spark, sf))


@query(with_sql("fx_zone") + " SELECT zone_id FROM fx_zone")
def list_zones(spark, sf):
    return filters.list_zones(fx.zone(spark, sf))


@query("SELECT concat('p', p_partkey) AS pdb_id, 'A' AS chain_id, CAST(p_size AS INT) AS domain_id, p_brand, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS ranges FROM part")
def join_domain_tables(spark, sf):
    p = table(spark, sf, "part").selectExpr("concat('p', p_partkey) AS pdb_id", "'A' AS chain_id", "cast(p_size as int) AS domain_id", "p_brand", "p_type AS ranges", "p_partkey")
    keys = ["pdb_id", "chain_id", "domain_id"]
    return annotate.join_domain_tables(p.select(*keys, "p_brand"), p.where("p_partkey % 3 <> 0").select(*keys, "ranges"))


_POLY = "CASE entity_id WHEN '1' THEN 0 WHEN '3' THEN 2 END"


@query(ATOMS + f" SELECT assembly_id, atom_id, entity_id, entity_id IN ('1','2','3') AS is_polymer, CAST({_POLY} AS INT) AS polymer_label FROM fx_atoms")
def annotate_polymers(spark, sf):
    atoms = fx.atoms(spark, sf).select("assembly_id", "atom_id", "entity_id")
    ids = atoms.select("entity_id").distinct().where("entity_id <> '5'")
    entities = ids.selectExpr("entity_id AS id", "CASE WHEN entity_id < '4' THEN 'polymer' ELSE 'non-polymer' END AS type")
    kinds = ids.where("entity_id < '4'").selectExpr("entity_id", "CASE entity_id WHEN '1' THEN 'polypeptide(L)' WHEN '3' THEN 'polyribonucleotide' ELSE 'other' END AS type")
    return annotate.annotate_polymers(atoms, entities, kinds, list(annotate.POLYMERS))


@query(ATOMS + f" SELECT polymer_label AS label, count(*) AS n FROM (SELECT CAST({_POLY} AS INT) AS polymer_label FROM fx_atoms) WHERE polymer_label IS NOT NULL GROUP BY 1")
def polymer_vocabulary(spark, sf):
    words = annotate.polymer_vocabulary(spark)
    named = fx.atoms(spark, sf).selectExpr("CASE entity_id WHEN '1' THEN 'polypeptide(L)' WHEN '3' THEN 'polyribonucleotide' END AS name")
    return named.join(F.broadcast(words), "name").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_LABELLED = """, lab AS (SELECT chr(CAST(65+p_partkey%4 AS INT)) AS chain_id, p_partkey AS domain_id, p_size AS lo, CAST(p_partkey%25 AS INT) AS cath_label FROM part),
res AS (SELECT chain_id, domain_id, CAST(lo + k AS INT) AS seq_id, cath_label FROM lab, range(4) r(k)),
one AS (SELECT chain_id, seq_id, cath_label FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, seq_id ORDER BY domain_id) AS n FROM res) WHERE n = 1)"""


def _labelled(spark, sf):
    p = table(spark, sf, "part")
    return p.selectExpr("char(cast(65 + p_partkey % 4 as int)) AS chain_id", "p_partkey AS domain_id", "sequence(p_size, p_size + 3) AS seq_ids", "cast(p_partkey % 25 as int) AS cath_label")


@query(ATOMS + _LABELLED + " SELECT chain_id, seq_id, cath_label FROM one")
def first_domain_per_residue(spark, sf):
    return annotate.first_domain_per_residue(_labelled(spark, sf))


@query(ATOMS + _LABELLED + " SELECT assembly_id, atom_id, cath_label FROM fx_atoms LEFT JOIN one USING (chain_id, seq_id)")
def annotate_domains(spark, sf):
    return annotate.annotate_domains(fx.atoms(spark, sf), _labelled(spark, sf)).select("assembly_id", "atom_id", "cath_label")


_CLASSES = ", cls AS (SELECT c, a, count(*) AS n, CAST(row_number() OVER (ORDER BY c, a) - 1 AS INT) AS label FROM fx_domains GROUP BY 1, 2 HAVING count(*) >= 20)"


@query(with_sql("fx_domains") + _CLASSES + " SELECT c, a, n, label FROM cls")
def frequent_classes(spark, sf):
    return annotate.frequent_classes(fx.domains(spark, sf), 20)


@query(with_sql("fx_domains") + _CLASSES + " SELECT pdb_id, label AS cath_label FROM fx_domains JOIN cls USING (c, a)")
def label_domains(spark, sf):
    d = fx.domains(spark, sf)
    return annotate.label_domains(d, annotate.frequent_classes(d, 20))


@query(ATOMS + """, g AS (SELECT *, CASE mate WHEN 0 THEN x ELSE -y + 5 END AS nx, CASE mate WHEN 0 THEN y ELSE x - 2.5 END AS ny, CASE mate WHEN 0 THEN z ELSE z + 100 END AS nz
 FROM fx_atoms, range(2) m(mate) WHERE mate = 0 OR subchain_id IN ('A', 'B')) SELECT assembly_id, atom_id, CAST(mate AS INT) AS symmetry_mate, round(nx, 6) AS x, round(ny, 6) AS y, round(nz, 6) AS z FROM g""")
def build_assembly(spark, sf):
    atoms = fx.atoms(spark, sf).select("assembly_id", "subchain_id", "atom_id", "x", "y", "z")
    own = atoms.select("assembly_id", "subchain_id").distinct()
    gen = own.withColumn("oper_id", F.lit("1")).unionByName(own.where("subchain_id IN ('A', 'B')").withColumn("oper_id", F.lit("2")))
    columns = ["oper_id", *(f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)), "t1", "t2", "t3"]
    one = ["1", 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0]
    two = ["2", 0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 5.0, -2.5, 100.0]
    out = annotate.build_assembly(atoms, gen, spark.createDataFrame([one, two], columns))
    return out.select("assembly_id", "atom_id", "symmetry_mate", *[F.round(c, 6).alias(c) for c in "xyz"])



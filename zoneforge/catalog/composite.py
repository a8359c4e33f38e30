"""Composite jobs: zones from atoms, samples, curricula, and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from zoneforge import fixtures as fx
from zoneforge.catalog import query
from zoneforge.catalog.samples import u
from zoneforge.catalog.spatial import ASYM, ATOMS, DENSE, LIMIT, NEAR, PAIR, SOLO, SPACING, ZONES, R, asym
from zoneforge.fixtures import with_sql
from zoneforge.functions import frames as f
from zoneforge.functions.storage import materialize, new_path
from zoneforge.operators import spatial, splits
from zoneforge.plans import jobs, pick
from zoneforge.sources import store
from zoneforge.streaming import jobs as streams

PARAMS = jobs.PickParams(
    spacing=SPACING, density_radius=R, min_density=LIMIT, max_density=1000.0, zone_radius=R, boundary_depth=5.0, solo=SOLO, pair=PAIR, elements=("C", "N", "O", "S", "P"), nonbiological=("GOL", "PEG"), axes="identity"
)


def _entity(atoms):
    """Subchain A and C are clustered, B and D are not; D's ligand is nonspecific."""
    own = atoms.select("assembly_id", "subchain_id").distinct()
    return own.select("assembly_id", "subchain_id", F.concat("subchain_id", (F.col("assembly_id") % 3).cast("string")).alias("entity_id"), F.when(F.col("subchain_id") == "D", "GOL").otherwise("POL").alias("comp_id"))


def _inputs(spark, sf):
    atoms = fx.atoms(spark, sf)
    entity = _entity(atoms)
    cluster = entity.select("entity_id").distinct().where("entity_id LIKE 'A%' OR entity_id LIKE 'C%'").withColumn("cluster_id", F.expr("CASE WHEN entity_id LIKE 'A%' THEN 1 ELSE 2 END"))
    return {"atoms": atoms, "asym": asym(spark, sf), "rank": atoms.select("assembly_id").distinct().withColumn("assembly_rank", F.col("assembly_id")), "subchain_entity": entity, "cluster": cluster, "nonspecific": spark.createDataFrame([("GOL",)], "comp_id string")}


_SOLID = ", checked AS (SELECT * FROM fx_atoms WHERE assembly_id NOT IN (SELECT assembly_id FROM fx_atoms WHERE element NOT IN ('C','N','O','S','P'))), solid AS (SELECT * FROM checked WHERE NOT (comp_id IN ('GOL','PEG') AND NOT is_polymer))"
_NAME = "CASE {c} WHEN 'A' THEN 'c1' WHEN 'C' THEN 'c2' ELSE concat('e', {c}, assembly_id % 3) END"
_PICK = (
    ATOMS + _SOLID + ZONES.replace("FROM fx_atoms GROUP BY assembly_id", "FROM checked GROUP BY assembly_id") + NEAR
    + f", sdens AS (SELECT z.zone_id, z.assembly_id, cx, cy, cz, coalesce(sum(a.occupancy), 0) / {spatial.sphere_volume_nm3(R)!r} AS density FROM zones z LEFT JOIN solid a ON a.assembly_id = z.assembly_id AND (cx-a.x)*(cx-a.x)+(cy-a.y)*(cy-a.y)+(cz-a.z)*(cz-a.z) <= {R * R} GROUP BY ALL), thick AS (SELECT * FROM sdens WHERE density > {LIMIT})"
    + ASYM + f", keyed AS (SELECT zone_id, assembly_id, {_NAME.format(c='subchain_id')} AS key FROM solo JOIN thick USING (zone_id) WHERE subchain_id <> 'D' UNION ALL"
    + f" SELECT zone_id, assembly_id, concat(least(k1, k2), '|', greatest(k1, k2)) FROM (SELECT zone_id, assembly_id, {_NAME.format(c='subchain_id_1')} AS k1, {_NAME.format(c='subchain_id_2')} AS k2 FROM pair JOIN thick USING (zone_id) WHERE subchain_id_1 <> 'D' AND subchain_id_2 <> 'D')),"
    + " firsts AS (SELECT key, min(assembly_id) AS r FROM keyed GROUP BY 1), picked AS (SELECT DISTINCT zone_id FROM keyed JOIN firsts USING (key) WHERE assembly_id = r)"
)


@query(_PICK + " SELECT zone_id, assembly_id, cx AS x, cy AS y, cz AS z FROM thick WHERE zone_id IN (SELECT zone_id FROM picked)")
def pick_training_zones(spark, sf):
    return jobs.pick_training_zones(_inputs(spark, sf), PARAMS)["zone"].select("zone_id", "assembly_id", "center.*")


def cif_files(spark, sf, path: str) -> None:
    """An mmCIF file for each assembly of the atoms' view: chains A to D, of which A and B stand twice in the assembly, and things to leave out."""
    atoms = fx.atoms(spark, sf).withColumn("vec_id", F.floor(F.col("atom_id") / 21)).withColumn("k", F.col("atom_id") % 21)
    line = lambda atom_id, element, comp, model: F.concat_ws(" ", F.lit("ATOM"), atom_id, element, F.lit("X"), comp, "subchain_id", F.ascii("subchain_id") - 64, "seq_id", *[F.round(c, 6) for c in "xyz"], "occupancy", "subchain_id", F.lit(model))
    extra = [("k = 0 AND vec_id % 10 = 0", line(F.col("atom_id") + 10_000_000, F.lit("O"), F.lit("HOH"), "1")), ("k = 1", line(F.col("atom_id") + 20_000_000, F.lit("H"), F.col("comp_id"), "1")), ("k = 2", line(F.col("atom_id"), F.col("element"), F.col("comp_id"), "2"))]
    rows = atoms.select("assembly_id", line(F.col("atom_id"), F.col("element"), F.col("comp_id"), "1").alias("line"))
    for which, text in extra:
        rows = rows.unionByName(atoms.where(which).select("assembly_id", text.alias("line")))
    fields = "group_PDB id type_symbol label_atom_id label_comp_id label_asym_id label_entity_id label_seq_id Cartn_x Cartn_y Cartn_z occupancy auth_asym_id pdbx_PDB_model_num".split()
    loop = lambda name, columns, body: "#\nloop_\n" + "".join(f"_{name}.{c}\n" for c in columns) + body
    entity = loop("entity", ["id", "type"], "".join(f"{i} {kind}\n" for i, kind in enumerate(["polymer"] * 3 + ["non-polymer"], 1)))
    poly = loop("entity_poly", ["entity_id", "type"], "1 'polypeptide(L)'\n2 polydeoxyribonucleotide\n3 'peptide nucleic acid'\n")
    gen = loop("pdbx_struct_assembly_gen", ["assembly_id", "oper_expression", "asym_id_list"], "1 1,2 A,B\n1 1 C,D\n")
    matrix = [f"matrix[{i}][{j}]" for i in (1, 2, 3) for j in (1, 2, 3)]
    ops = loop("pdbx_struct_oper_list", ["id", *matrix, "vector[1]", "vector[2]", "vector[3]"], "".join(f"{i} 1 0 0 0 1 0 0 0 1 {x} 0 0\n" for i, x in ((1, 0), (2, 30))))
    head = F.concat(F.lit("data_S"), F.lpad(F.col("assembly_id").cast("string"), 2, "0"), F.lit("\n" + entity + poly + gen + ops + loop("atom_site", fields, "")))
    rows.groupBy("assembly_id").agg(F.concat_ws("\n", F.collect_list("line")).alias("lines")).select(F.concat(head, "lines", F.lit("\n#\n"))).write.option("maxRecordsPerFile", 1).text(path)


def file_census(spark, sf) -> pick.Census:
    """Chains A are one cluster, chains C another; ligands whose first residue is ALA are nonspecific."""
    names = fx.atoms(spark, sf).select(F.concat(F.lit("s"), F.lpad(F.col("assembly_id").cast("string"), 2, "0")).alias("pdb_id")).distinct()
    clusters = names.select("pdb_id", F.explode(F.array(*[F.struct(F.lit(e).alias("entity_id"), F.lit(c).alias("cluster_id")) for e, c in (("1", 1), ("3", 2))])).alias("c")).select("pdb_id", "c.*")
    return pick.Census(clusters=clusters, nonspecific=spark.createDataFrame([("ALA",)], "comp_id string"))


_FILED = (
    f"WITH RECURSIVE src AS ({fx.SQL['fx_atoms']}), base AS (SELECT assembly_id, atom_id, subchain_id, comp_id, element, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, occupancy, subchain_id <> 'D' AS is_polymer FROM src),"
    " fx_atoms AS (SELECT *, 0 AS symmetry_mate FROM base UNION ALL SELECT * REPLACE (x + 30 AS x), 1 FROM base WHERE subchain_id IN ('A', 'B')), ligand AS (SELECT assembly_id FROM base WHERE subchain_id = 'D' GROUP BY 1 HAVING min(comp_id) <> 'ALA')"
)
_FILED_PICK = _PICK.replace(ATOMS, _FILED, 1).replace("WHERE symmetry_mate = 0 AND subchain_id <> 'D'", "WHERE symmetry_mate = 0")
for _c in ("subchain_id", "subchain_id_1", "subchain_id_2"):
    _FILED_PICK = _FILED_PICK.replace(_NAME.format(c=_c), f"CASE {_c} WHEN 'A' THEN 'c1' WHEN 'C' THEN 'c2' ELSE concat('e', assembly_id, '/', {_c}) END").replace(f"{_c} <> 'D'", f"({_c} <> 'D' OR assembly_id IN (SELECT assembly_id FROM ligand))")
_FILED_PICK = _FILED_PICK.replace("(subchain_id <> 'D' OR assembly_id IN (SELECT assembly_id FROM ligand)) AS is_polymer", "subchain_id <> 'D' AS is_polymer")


@query(
    _FILED_PICK + """, kept AS (SELECT * FROM thick WHERE zone_id IN (SELECT zone_id FROM picked)),
 reach AS (SELECT k.zone_id, count(*) AS atoms FROM kept k JOIN fx_atoms a ON a.assembly_id = k.assembly_id AND (cx-a.x)*(cx-a.x)+(cy-a.y)*(cy-a.y)+(cz-a.z)*(cz-a.z) <= 400 GROUP BY 1)
SELECT concat('s', lpad(CAST(assembly_id AS VARCHAR), 2, '0')) AS pdb_id, cx AS x, cy AS y, cz AS z, (SELECT count(*) FROM solo s WHERE s.zone_id = k.zone_id) AS subchains, (SELECT count(*) FROM pair p WHERE p.zone_id = k.zone_id) AS pairs, r.atoms
FROM kept k JOIN reach r ON r.zone_id = k.zone_id"""
)
def pick_files(spark, sf):
    """Zones of the store that mmCIF files were picked into, with their children and the stored atoms around them."""
    src, path = new_path(spark, "cif"), new_path(spark, "store")
    cif_files(spark, sf, src)
    pick.pick_files(spark, f"{src}/*.txt", path, PARAMS, file_census(spark, sf))
    zone, assembly, structure, atoms, solo, pair = (store.read_table(spark, path, n) for n in ("zone", "assembly", "structure", "atoms", "subchain", "subchain_pair"))
    centers = zone.select("zone_id", "assembly_id", *[F.col("center")[c].alias(f"c{c}") for c in "xyz"])
    near = spatial.atoms_within(centers, atoms.select("assembly_id", "x", "y", "z"), R + 5.0).groupBy("zone_id").agg(F.count(F.lit(1)).alias("atoms"))
    count = lambda df, name: df.groupBy("zone_id").agg(F.count(F.lit(1)).alias(name))
    out = centers.join(near, "zone_id").join(count(solo, "subchains"), "zone_id", "left").join(count(pair, "pairs"), "zone_id", "left").na.fill(0, ["subchains", "pairs"])
    named = assembly.select("assembly_id", "struct_id").join(structure.select("struct_id", "pdb_id"), "struct_id")
    return out.join(named, "assembly_id").select("pdb_id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), "subchains", "pairs", "atoms")


#: Even assemblies arrive before odd ones.
_ARRIVAL = "(assembly_id % 2 * 1000000000 + assembly_id)"


@query(_PICK.replace("min(assembly_id) AS r", f"min({_ARRIVAL}) AS r").replace("WHERE assembly_id = r", f"WHERE {_ARRIVAL} = r") + " SELECT assembly_id, count(*) AS zones FROM thick WHERE zone_id IN (SELECT zone_id FROM picked) GROUP BY 1")
def stream_pick(spark, sf):
    src, dst = new_path(spark, "arriving"), new_path(spark, "picked")
    inputs = _inputs(spark, sf)
    atoms = materialize(inputs["atoms"], "atoms")

    def pick(batch, seen):
        tables = jobs.pick_training_zones(inputs | {"atoms": batch, "seen": seen}, PARAMS)
        # dense ids would start anew in each batch
        return {"zone": tables["zone"].withColumn("zone_id", F.xxhash64("assembly_id", "center.x", "center.y", "center.z")), "novel_key": tables["novel_key"]}

    for odd in (0, 1):
        atoms.where(F.col("assembly_id") % 2 == odd).repartition(8, "assembly_id").write.mode("append").parquet(src)
        found = streams.stream_pick(spark, src, dst, pick, ", ".join(f"{n} {t}" for n, t in atoms.dtypes), files=8)
    return found.groupBy("assembly_id").agg(F.count(F.lit(1)).alias("zones"))


@query(_PICK + " SELECT assembly_id, count(*) AS zones FROM thick WHERE zone_id IN (SELECT zone_id FROM picked) GROUP BY 1")
def stream_pick_gathered(spark, sf):
    """Each assembly's atoms come in three batches; it waits in the state until it is whole, and all are picked in the last."""
    src, dst = new_path(spark, "arriving"), new_path(spark, "picked")
    inputs = _inputs(spark, sf)
    sizes = inputs["atoms"].groupBy("assembly_id").agg(F.count(F.lit(1)).alias("n_atoms"))
    atoms = materialize(inputs["atoms"].join(F.broadcast(sizes), "assembly_id"), "atoms")

    def pick_batch(batch, unseen):
        tables = jobs.pick_training_zones(inputs | {"atoms": batch.drop("n_atoms"), "seen": unseen}, PARAMS)
        return {"zone": tables["zone"].withColumn("zone_id", F.xxhash64("assembly_id", "center.x", "center.y", "center.z")), "novel_key": tables["novel_key"]}

    for part in range(3):
        atoms.where(F.col("atom_id") % 3 == part).coalesce(4).write.mode("append").parquet(src)
        found = streams.stream_pick(spark, src, dst, pick_batch, ", ".join(f"{n} {t}" for n, t in atoms.dtypes), files=8, total="n_atoms")
    return found.groupBy("assembly_id").agg(F.count(F.lit(1)).alias("zones"))


def _store(spark, sf):
    zone = fx.zone(spark, sf).withColumn("center", f.vector(F.col("zone_id") % 97, F.col("zone_id") % 89, F.col("zone_id") % 83))
    return {"zone": zone, "assembly": fx.assembly(spark, sf), "structure": fx.structure(spark, sf), "curriculum": fx.curriculum(spark, sf)}


_ORIGIN = ", ".join(f"round(zone_id % {m} + 10 * ({u(k)} - 0.5), 6) AS {c}" for k, (c, m) in enumerate(zip("xyz", (97, 89, 83), strict=True)))
_VAL = with_sql("fx_zone", "fx_assembly", "fx_structure") + ", val AS (SELECT zone_id, row_number() OVER (ORDER BY zone_id) - 1 AS k, count(*) OVER () AS n FROM fx_zone z JOIN fx_assembly a ON a.assembly_id = z.assembly_id JOIN fx_structure s ON s.struct_id = a.struct_id WHERE split = '{split}')"


@query(_VAL.format(split="val") + f" SELECT i, zone_id, {_ORIGIN} FROM range(5000) r(i) JOIN val ON k = i % n")
def make_samples(spark, sf):
    drawn = jobs.make_samples(_store(spark, sf), "val", 10.0, 0, 5000)
    return drawn.select("i", "zone_id", *[F.round(F.col("origin")[c], 6).alias(c) for c in "xyz"])


_TRAIN = ", seed AS (SELECT max(random_seed) + 1 AS s FROM fx_curriculum), m AS (SELECT count(*) * 2 // 64 * 64 AS total FROM val), drawn AS (SELECT zone_id, s + j AS i FROM m, range(m.total) r(j), seed, val WHERE k = (s + j) % n)"


@query(_VAL.format(split="train").replace("WITH RECURSIVE ", f"WITH RECURSIVE fx_curriculum AS ({fx.SQL['fx_curriculum']}), ") + _TRAIN + f" SELECT zone_id, i AS random_seed, round({u(3)}, 6) AS difficulty FROM drawn UNION ALL SELECT zone_id, random_seed, round(difficulty, 6) FROM fx_curriculum")
def make_curriculum(spark, sf):
    from zoneforge.functions.random import uniform

    scored = lambda s: s.select("zone_id", "random_seed", uniform("i", 3).alias("difficulty"))
    return jobs.make_curriculum(_store(spark, sf), scored, 2, 10.0, 64).withColumn("difficulty", F.round("difficulty", 6))




@query(ATOMS + ZONES + NEAR + DENSE + ASYM + """, shown AS (SELECT d.zone_id, d.assembly_id FROM dens d WHERE density > 5 AND zone_id IN (SELECT zone_id FROM solo)),
counts AS (SELECT assembly_id, count(*) AS zones FROM shown GROUP BY 1), grp AS (SELECT assembly_id, min(assembly_id) OVER (PARTITION BY assembly_id % 4) AS group_id, zones FROM counts),
gs AS (SELECT group_id, CAST(sum(zones) AS BIGINT) AS zones FROM grp GROUP BY 1) SELECT g.assembly_id, g.group_id, g.zones, gs.zones AS group_zones FROM grp g JOIN gs ON gs.group_id = g.group_id""")
def flagship(spark, sf):
    """Zones of sufficient density that show a subchain, counted by groups of assemblies that share a cluster."""
    atoms = fx.atoms(spark, sf)
    zones = spatial.zone_grid(atoms, SPACING, "identity").select("assembly_id", *[F.round(c, 6).alias(c) for c in spatial.CENTER])
    zones = materialize(zones.withColumn("zone_id", F.xxhash64("assembly_id", *spatial.CENTER)), "zones")
    dense = spatial.exact_density(atoms, zones, R).where("density > 5")
    solo, _ = spatial.zone_subchains(zones, atoms, asym(spark, sf), R, SOLO, PAIR)
    counts = materialize(dense.join(solo, "zone_id", "left_semi").groupBy(F.col("assembly_id").alias("pdb_id")).agg(F.count(F.lit(1)).alias("zones")), "counts")
    clusters = counts.select("pdb_id", (F.col("pdb_id") % 4).alias("cluster"))
    groups = materialize(splits.connected_groups(counts.select("pdb_id"), clusters), "groups")
    sizes = splits.group_sizes(groups, counts).withColumnRenamed("zones", "group_zones")
    return groups.join(counts, "pdb_id").join(sizes, "group_id").select(F.col("pdb_id").alias("assembly_id"), "group_id", "zones", "group_zones")



"""From mmCIF files to a stored dataset: ingest, annotate, assemble, pick, commit."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneforge.functions.storage import delete, listed
from zoneforge.operators import annotate, filters, spatial
from zoneforge.operators.tables import dense_index
from zoneforge.plans.jobs import PickParams, pick_training_zones
from zoneforge.sources import readers, store

#: Tables of a picked dataset, in the order in which they are made.
TABLES = ("structure", "assembly", "atoms", "zone", "subchain", "subchain_pair", "zone_neighbor", "novel_key", "file")


@dataclass(frozen=True)
class Census:
    """What is known of the structures beside their files; each part may be left out.

    structures (pdb_id, model_id, structure_rank): those to take, their model and rank; assemblies (pdb_id, assembly, assembly_rank): those to
    take; clusters (pdb_id, entity_id, cluster_id); nonspecific (comp_id): ligands that make no zone novel; domains (pdb_id,
    chain_id, seq_ids, cath_label): labelled domains. Without ranks structures go by name.
    """

    structures: DataFrame | None = None
    assemblies: DataFrame | None = None
    clusters: DataFrame | None = None
    nonspecific: DataFrame | None = None
    domains: DataFrame | None = None


def input_files(spark: SparkSession, src: str) -> DataFrame:
    """(path, length) of the files of a glob, listed by Spark; their content isn't read."""
    return spark.read.format("binaryFile").load(src).select("path", "length")


def _stage(spark: SparkSession, folder: str, name: str, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """What ``make`` gives, written to a folder of the stage; a stage that an earlier run has finished is read instead.

    Its tables are named by a last, empty one, so a run that died among them makes the stage again.
    """
    at = f"{folder}/{name}"
    if "done" in listed(spark, at) and "_SUCCESS" in listed(spark, f"{at}/done"):
        names = [n for n in listed(spark, at) if n != "done"]
    else:
        delete(spark, at)
        names = []
        for table, df in make().items():
            df.write.parquet(f"{at}/{table}")
            names.append(table)
        spark.range(0).write.parquet(f"{at}/done")
    return {n: spark.read.parquet(f"{at}/{n}") for n in names}


def annotated_atoms(raw: dict[str, DataFrame], census: Census) -> DataFrame:
    """Atoms of each structure's model, without water and hydrogen, labelled by polymer and domain."""
    atoms = raw["asym_atoms"]
    if census.structures is not None:
        atoms = filters.select_model(atoms, census.structures)
    else:
        first = atoms.groupBy("pdb_id").agg(F.min(F.struct(F.expr("try_cast(model_id AS bigint)"), "model_id"))["model_id"].alias("model_id"))
        atoms = filters.select_model(atoms, first)
    atoms = filters.prune_hydrogen(filters.prune_water(atoms))
    atoms = annotate.annotate_polymers(atoms, raw["entities"], raw["polymers"], list(annotate.POLYMERS))
    if census.domains is None:
        return atoms.withColumn("cath_label", F.lit(None).cast("int"))
    order = [c for c in ("domain_id",) if c in census.domains.columns]
    return annotate.annotate_domains(atoms, census.domains, ("pdb_id", "chain_id"), tuple(order))


def numbered_assemblies(raw: dict[str, DataFrame], census: Census, atoms: DataFrame, first_struct: int, first_assembly: int) -> DataFrame:
    """(struct_id, assembly_id, pdb_id, model_id, assembly) in order of rank, numbered on from the ids given."""
    models = atoms.select("pdb_id", "model_id").distinct()
    rank = census.structures.select("pdb_id", "structure_rank") if census.structures is not None and "structure_rank" in census.structures.columns else models.select("pdb_id", F.lit(0).alias("structure_rank"))
    structures = dense_index(models.join(rank, "pdb_id"), ["structure_rank", "pdb_id"], "struct_id", first_struct)
    known = raw["assembly_gen"].select("pdb_id", "assembly").distinct()
    own = known.withColumn("assembly_rank", F.lit(0)) if census.assemblies is None else known.join(census.assemblies.select("pdb_id", "assembly", "assembly_rank"), ["pdb_id", "assembly"])
    return dense_index(structures.join(own, "pdb_id"), ["struct_id", "assembly_rank", "assembly"], "assembly_id", first_assembly).drop("assembly_rank", "structure_rank")


def picking_inputs(raw: dict[str, DataFrame], census: Census, asym: DataFrame, plan: DataFrame, seen: DataFrame | None) -> dict[str, DataFrame]:
    """What ``pick_training_zones`` takes, for all planned assemblies. Atoms keep their structure for the exclusion list."""
    spark = asym.sparkSession
    gen = raw["assembly_gen"].join(plan.select("pdb_id", "assembly", "assembly_id"), ["pdb_id", "assembly"]).select("assembly_id", "pdb_id", "subchain_id", "oper_id")
    atoms = annotate.build_assembly(asym, gen, raw["oper_map"])
    members = gen.select("assembly_id", "pdb_id", "subchain_id").distinct()
    totals = spatial.count_atoms(asym, ["pdb_id", "subchain_id"])
    named = F.concat_ws("/", "pdb_id", "entity_id")
    kinds = asym.groupBy("pdb_id", "subchain_id").agg(F.min("entity_id").alias("entity_id"), F.min(F.when(~F.col("is_polymer"), F.col("comp_id"))).alias("comp_id"))
    entity = members.join(kinds, ["pdb_id", "subchain_id"]).select("assembly_id", "subchain_id", named.alias("entity_id"), F.coalesce("comp_id", F.lit("")).alias("comp_id"))
    cluster = spark.createDataFrame([], "entity_id string, cluster_id long") if census.clusters is None else census.clusters.select(named.alias("entity_id"), F.col("cluster_id"))
    nonspecific = spark.createDataFrame([], "comp_id string") if census.nonspecific is None else census.nonspecific.select("comp_id").distinct()
    return {
        "atoms": atoms, "asym": members.join(totals, ["pdb_id", "subchain_id"]).select("assembly_id", "subchain_id", "occupancy"), "rank": plan.select("assembly_id", F.col("assembly_id").alias("assembly_rank")),
        "subchain_entity": entity, "cluster": cluster, "nonspecific": nonspecific, "seen": seen,
    }


def pick_files(spark: SparkSession, src: str, path: str, params: PickParams, census: Census | None = None) -> int | None:
    """Pick training zones from the mmCIF files of a glob into the store at ``path``; the version made, or None without new files.

    Files that the store has taken are left out, so a second run adds nothing and one with more files takes only those, against the
    keys that were seen before. Each stage lies in ``path``/work under a name that hangs on its inputs: a run that is
    broken off goes on behind its last full stage. Structures, assemblies, atoms, zones, their children, keys and the list of
    files become visible together. Ids go on from the stored ones, in order of rank, so the same run gives the same ids.
    """
    census = census or Census()
    taken = store.read_table(spark, path, "file")
    files = input_files(spark, src)
    files = files if taken is None else files.join(taken.select("path"), "path", "left_anti")
    names = sorted(r.path for r in files.select("path").collect())  # as many names as Spark's own listing holds on the driver
    if not names:
        return None
    tag = hashlib.md5("\n".join([repr(replace(params)), *names]).encode()).hexdigest()
    folder = f"{path}/work/{tag}"
    raw = _stage(spark, folder, "ingest", lambda: readers.ingest_mmcif(spark, names))
    asym = _stage(spark, folder, "annotate", lambda: {"asym": annotated_atoms(raw, census)})["asym"]

    def build(read: Callable[[str], DataFrame | None], base: dict) -> dict[str, DataFrame]:
        at, firsts = f"{folder}/{base['version']}", [store.next_id(read(t), c) for t, c in (("structure", "struct_id"), ("assembly", "assembly_id"), ("zone", "zone_id"))]
        plan = _stage(spark, at, "plan", lambda: {"plan": numbered_assemblies(raw, census, asym, *firsts[:2])})["plan"]
        inputs = picking_inputs(raw, census, asym, plan, read("novel_key"))
        inputs["atoms"] = _stage(spark, at, "assemble", lambda: {"atoms": inputs["atoms"]})["atoms"]
        found = _stage(spark, at, "pick", lambda: pick_training_zones(inputs, params))
        shift = lambda df: df.withColumn("zone_id", F.col("zone_id") + firsts[2])
        kept = plan.join(found["zone"].select("assembly_id").distinct(), "assembly_id", "left_semi")
        out = {
            "structure": kept.select("struct_id", "pdb_id", "model_id", F.lit(None).cast("string").alias("split")), "assembly": kept.select("assembly_id", "struct_id", F.col("assembly").alias("pdb_id")),
            "atoms": found["atoms"], **{n: shift(found[n]) for n in ("zone", "subchain", "subchain_pair", "zone_neighbor") if n in found}, "file": files,
        }
        if "novel_key" in found:
            out["novel_key"] = found["novel_key"]
        return {n: store.fresh(out[n], read(n), store.KEYS[n]) for n in TABLES if n in out}

    made = store.transact(spark, path, build)
    delete(spark, folder)
    return made

"""Labels for atoms and domains, and symmetry expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Polymer types by label; fixed values.
POLYMERS = ("polypeptide(L)", "polydeoxyribonucleotide", "polyribonucleotide")


def polymer_vocabulary(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(POLYMERS)), "label int, name string")


def join_domain_tables(domains: DataFrame, ranges: DataFrame) -> DataFrame:
    return domains.join(ranges, ["pdb_id", "chain_id", "domain_id"], "left")


def annotate_polymers(atoms: DataFrame, entities: DataFrame, polymers: DataFrame, labels: list[str]) -> DataFrame:
    """is_polymer (false where unknown) and polymer_label: the type's place in ``labels``, null if not listed.

    Entities are those of one structure, or of each where all three tables have ``pdb_id``.
    """
    own_id = ["pdb_id"] if all("pdb_id" in df.columns for df in (atoms, entities, polymers)) else []
    on = [*own_id, "entity_id"]
    kinds = entities.select(*own_id, F.col("id").alias("entity_id"), (F.col("type") == "polymer").alias("is_polymer"))
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("type")).cast("int")
    own = polymers.select(*on, F.when(place > 0, place - 1).alias("polymer_label"))
    return atoms.drop("is_polymer", "polymer_label").join(kinds, on, "left").join(own, on, "left").withColumn("is_polymer", F.coalesce("is_polymer", F.lit(False)))


def first_domain_per_residue(labelled: DataFrame, key: tuple[str, ...] = ("chain_id",), order: tuple[str, ...] = ("domain_id",)) -> DataFrame:
    """(key, seq_id, cath_label): where domains overlap the first by ``order`` has the residue."""
    rows = labelled.select(*key, *order, "cath_label", F.posexplode("seq_ids").alias("pos", "seq_id"))
    first = F.row_number().over(Window.partitionBy(*key, "seq_id").orderBy(*order, "pos"))
    return rows.withColumn("_n", first).where("_n = 1").select(*key, "seq_id", "cath_label")


def annotate_domains(atoms: DataFrame, labelled: DataFrame, key: tuple[str, ...] = ("chain_id",), order: tuple[str, ...] = ("domain_id",)) -> DataFrame:
    """Atoms with their residue's domain label; as many rows as before, for residues are unique by then."""
    return atoms.drop("cath_label").join(first_domain_per_residue(labelled, key, order), [*key, "seq_id"], "left")


def frequent_classes(domains: DataFrame, n: int) -> DataFrame:
    """(c, a, n, label): classes of at least ``n`` domain rows, numbered in order."""
    kept = domains.groupBy("c", "a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n)
    return kept.withColumn("label", F.row_number().over(Window.orderBy("c", "a")) - 1)


def label_domains(domains: DataFrame, classes: DataFrame) -> DataFrame:
    """Domains of the kept classes with their label, without the class columns."""
    return domains.join(classes.select("c", "a", F.col("label").alias("cath_label")), ["c", "a"]).drop("c", "a", "t", "h")


def build_assembly(asym_atoms: DataFrame, gen: DataFrame, ops: DataFrame) -> DataFrame:
    """Atoms of an assembly: each subchain under each of its operators, mates numbered from 0.

    gen: (assembly_id, subchain_id, oper_id); ops: (oper_id, r11 .. r33, t1 .. t3). With ``pdb_id`` in all of
    them subchains and operators are those of their structure.
    """
    mate = F.row_number().over(Window.partitionBy("assembly_id", "subchain_id").orderBy("oper_id")) - 1
    own = ["pdb_id"] if "pdb_id" in gen.columns and "pdb_id" in ops.columns else []
    plan = gen.distinct().withColumn("symmetry_mate", mate.cast("int")).join(ops, [*own, "oper_id"])
    on = [c for c in ("assembly_id", "pdb_id", "subchain_id") if c in asym_atoms.columns and c in plan.columns]
    rows = asym_atoms.drop("symmetry_mate").join(plan, on)
    new = {c: F.col(f"r{i}1") * F.col("x") + F.col(f"r{i}2") * F.col("y") + F.col(f"r{i}3") * F.col("z") + F.col(f"t{i}") for i, c in enumerate("xyz", 1)}
    return rows.withColumns(new).drop("oper_id", *(f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)), "t1", "t2", "t3")

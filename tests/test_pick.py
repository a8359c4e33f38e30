"""From files to the store: what a broken run leaves, what a second run adds; golden cases of zones and groups."""

import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from zoneforge.catalog import composite
from zoneforge.functions.storage import listed
from zoneforge.operators import annotate, density, spatial, splits
from zoneforge.operators.graph import components
from zoneforge.plans import pick
from zoneforge.sources import store


def test_files_are_picked_once_and_a_broken_run_goes_on(spark, sf, tmp_path, monkeypatch):
    every, src, path = tmp_path / "every", tmp_path / "src", f"file://{tmp_path}/store"
    composite.cif_files(spark, sf, f"file://{every}")
    src.mkdir()
    files = sorted(every.glob("*.txt"))
    for f in files[: len(files) // 2]:
        shutil.copy(f, src)
    run = lambda: pick.pick_files(spark, f"file://{src}/*.txt", path, composite.PARAMS, composite.file_census(spark, sf))
    rows = lambda name, version=None: {tuple(r) for r in store.read_table(spark, path, name, version).collect()}

    def lost(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(pick, "pick_training_zones", lost)
        with pytest.raises(RuntimeError, match="lost"):
            run()
    assert store.manifest(spark, path)["version"] == 0
    with monkeypatch.context() as m:
        m.setattr(pick.readers, "ingest_mmcif", lost)  # that stage is done
        assert run() == 1
    assert listed(spark, f"{path}/work") == [] and run() is None
    first = {n: rows(n) for n in ("structure", "assembly", "zone", "subchain", "novel_key", "file")}
    for f in files[len(files) // 2 :]:
        shutil.copy(f, src)
    assert run() == 2 and run() is None
    for name, old in first.items():
        assert old < rows(name) and old == rows(name, 1)
    assert {os.path.basename(r[0]) for r in rows("file")} == {f.name for f in files}
    zone, assembly, structure = (store.read_table(spark, path, n) for n in ("zone", "assembly", "structure"))
    for df, key in ((zone, "zone_id"), (assembly, "assembly_id"), (structure, "struct_id"), (store.read_table(spark, path, "novel_key"), "key")):
        assert df.count() == df.select(key).distinct().count()
    for child in ("subchain", "subchain_pair"):
        assert store.read_table(spark, path, child).join(zone, "zone_id", "left_anti").count() == 0
    atoms = store.read_table(spark, path, "atoms")
    assert atoms.where("comp_id = 'HOH' OR element = 'H' OR model_id <> '1'").count() == 0 and atoms.select("symmetry_mate").distinct().count() == 2
    assert atoms.join(assembly, "assembly_id", "left_anti").count() == 0


#: Seven atoms: (x, y, z) of each, of which those within 1.5 of the origin are the first four.
POINTS = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (2, 0, 0), (0, 2, 0), (0, 0, 2)]
#: Subchain and mate of the fourth and seventh atom; of each case: shares that a lone subchain and a pair need, and what is found.
OTHERS = [("B", 0), ("A", 1)]
SHARES = [
    ((0.74, 1), (1, 1), True, False), ((0.76, 1), (1, 1), False, False), ((1, 0.59), (1, 1), True, False), ((1, 0.61), (1, 1), False, False),
    ((1, 1), (0.24, 1), False, True), ((1, 1), (0.26, 1), False, False), ((1, 1), (1, 0.49), False, True), ((1, 1), (1, 0.51), False, False),
]


#: Both mates of a subchain are measured against the whole of it, so those cases of a pair hold for another subchain alone.
@pytest.mark.parametrize(("other", "solo", "pair", "alone", "both"), [(o, *s) for o in OTHERS for s in SHARES if o[0] == "B" or s[1][1] == 1])
def test_subchains_of_a_zone(spark, other, solo, pair, alone, both):
    owners = [("A", 0)] * 3 + [other] + [("A", 0)] * 2 + [other]
    atoms = spark.createDataFrame([(1, k, s, m, *map(float, p), 1.0) for k, ((s, m), p) in enumerate(zip(owners, POINTS, strict=True))], "assembly_id long, atom_id long, subchain_id string, symmetry_mate int, x double, y double, z double, occupancy double")
    totals = spark.createDataFrame([(1, "A", 5.0), (1, "B", 2.0)] if other[0] == "B" else [(1, "A", 5.0)], "assembly_id long, subchain_id string, occupancy double")
    zone = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0)], "assembly_id long, zone_id long, cx double, cy double, cz double")
    found, pairs = spatial.zone_subchains(zone, atoms, totals, 1.5, solo, pair)
    assert sorted((r.subchain_id, r.symmetry_mate) for r in found.collect()) == ([("A", 0)] if alone else [])
    assert [tuple(r)[1:] for r in pairs.collect()] == ([("A", 0, *other)] if both else [])


@pytest.mark.parametrize(
    ("names", "clusters", "groups"),
    [
        ("", {}, []), ("ab", {}, ["a", "b"]), ("ab", {1: "a", 2: "b"}, ["a", "b"]), ("ab", {1: "ab"}, ["ab"]), ("abc", {1: "ab", 2: "bc"}, ["abc"]), ("abc", {1: "ab", 2: "ab"}, ["ab", "c"]),
        ("abcd", {1: "ab", 2: "cd"}, ["ab", "cd"]), ("ac", {1: "ab", 2: "bc"}, ["ac"]),
    ],
)
def test_groups_of_structures(spark, names, clusters, groups):
    structures = spark.createDataFrame([(n,) for n in names], "pdb_id string")
    edges = spark.createDataFrame([(n, str(k)) for k, own in clusters.items() for n in own], "pdb_id string, cluster string")
    found: dict[str, str] = {}
    for r in splits.connected_groups(structures, edges).collect():
        found[r.group_id] = found.get(r.group_id, "") + r.pdb_id
    assert sorted("".join(sorted(v)) for v in found.values()) == groups


def test_only_shared_clusters_go_through_the_rounds(spark, monkeypatch):
    """Of 1000 structures two share a cluster; a cluster of one structure is no edge, whatever its rows."""
    sent = []
    monkeypatch.setattr(splits, "components", lambda edges, *names, **more: sent.append(edges.count()) or components(edges, *names, **more))
    ids = spark.range(1000).select(F.col("id").alias("pdb_id"))
    rows = ids.select("pdb_id", F.col("pdb_id").alias("cluster"))
    rows = rows.unionByName(rows).unionByName(spark.createDataFrame([(7, -1), (3, -1), (None, -1), (5, None), (5000, -2), (8, -2), (9, -2)], "pdb_id long, cluster long"))
    found = {r.pdb_id: r.group_id for r in splits.connected_groups(ids, rows).collect()}
    assert sent == [3] and found == {k: {7: 3, 9: 8}.get(k, k) for k in range(1000)}
    named = {r.pdb_id: r.group_id for r in splits.connected_groups(ids, rows.withColumn("pdb_id", F.col("pdb_id").cast("string"))).collect()}
    assert named == found


@pytest.mark.parametrize(
    ("sizes", "targets", "expected"),
    [
        ({}, {"a": 1}, {}), ({"x": 1}, {"a": 1}, {"x": "a"}), ({"x": 2, "y": 1}, {"a": 1}, {"x": "a", "y": "a"}),
        ({"x": 4, "y": 3, "z": 1}, {"a": 0.5, "b": 0.5}, {"x": "a", "y": "b", "z": "b"}),
    ],
)
def test_more_allocations(spark, sizes, targets, expected):
    groups = spark.createDataFrame(list(sizes.items()), "group_id string, zones long")
    assert {x.group_id: x.split for x in splits.allocate_splits(groups, targets, "argmax").collect()} == expected


def test_operators_of_several_structures_do_not_mix(spark):
    asym = spark.createDataFrame([("p", "A", 1.0), ("q", "A", 2.0)], "pdb_id string, subchain_id string, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    ops = [(p, o, *[1.0 if i == j else 0.0 for i in range(3) for j in range(3)], t, 0.0, 0.0) for p, o, t in (("p", "1", 0.0), ("q", "1", 10.0), ("q", "2", 20.0))]
    frame = spark.createDataFrame(ops, "pdb_id string, oper_id string, " + ", ".join(f"r{i}{j} double" for i in (1, 2, 3) for j in (1, 2, 3)) + ", t1 double, t2 double, t3 double")
    gen = spark.createDataFrame([(7, "p", "A", "1"), (8, "q", "A", "1"), (8, "q", "A", "2")], "assembly_id long, pdb_id string, subchain_id string, oper_id string")
    assert sorted((r.assembly_id, r.symmetry_mate, r.x) for r in annotate.build_assembly(asym, gen, frame).collect()) == [(7, 0, 1.0), (8, 0, 12.0), (8, 1, 22.0)]


def test_one_pass_measures_assemblies_of_two_voxel_sizes(spark):
    rng = np.random.default_rng(8)
    rows = [(a, k, *map(float, rng.uniform(0, 30, 3)), 1.0) for a, n in ((1, 400), (2, 900)) for k in range(n)]
    atoms = spark.createDataFrame(rows, "assembly_id long, atom_id long, x double, y double, z double, occupancy double")
    points = spark.createDataFrame([(a, 10 * a + k, 15.0 + k, 15.0, 14.0) for a in (1, 2, 3) for k in range(3)], "assembly_id long, zone_id long, cx double, cy double, cz double")
    sizes = density.coarsen_large(atoms, 2.0, 900, 5.0)
    assert {r.assembly_id: r.voxel for r in sizes.collect()} == {1: 2.0, 2: 5.0}
    marked = density.voxel_occupancy(density.with_resolution(atoms, sizes, 2.0))
    value = lambda df: {r.zone_id: r.density for r in df.collect()}
    for method in ("fft", "relational"):
        found = value(density.interpolate_density(density.smooth_density(marked, 8.0, method=method, sizes=(2.0, 5.0)), points))
        for assembly, voxel in ((1, 2.0), (2, 5.0)):
            own = atoms.where(F.col("assembly_id") == assembly)
            alone = value(density.interpolate_density(density.smooth_density(density.voxel_occupancy(own, voxel), 8.0, voxel, method), points, voxel))
            assert all(found[10 * assembly + k] == pytest.approx(alone[10 * assembly + k]) and alone[10 * assembly + k] > 1 for k in range(3))
        assert all(found[30 + k] == 0 for k in range(3))
    with pytest.raises(Exception, match="isn't listed"):
        density.smooth_density(marked, 8.0, sizes=(2.0,)).collect()


@pytest.mark.parametrize("few", [0, 5, 10_000])
def test_components_whoever_finishes_them(spark, few):
    rng = np.random.default_rng(few)
    edges = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 150, (120, 2))] + [(f"p{k}", f"p{k + 1}") for k in range(60)] + [("alone", "alone")]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "src string, dst string"), few=few).collect()}
    parent = {v: v for e in edges for v in e}
    find = lambda v: v if parent[v] == v else find(parent[v])
    for a, b in edges:
        parent[find(a)] = find(b)
    assert got.keys() == parent.keys()
    assert len({(find(v), got[v]) for v in got}) == len({find(v) for v in got}) == len(set(got.values()))


def test_fingerprints_tell_rows_apart(spark):
    print_of = lambda *rows: store.dataset_fingerprint({"t": spark.createDataFrame(rows, "a string, b string")}).first().fingerprint
    assert len({print_of(("a|b", "c")), print_of(("a", "b|c")), print_of((None, "c")), print_of(("\\N", "c")), print_of(("N", "c")), print_of(("a", "b"), ("c", "d")), print_of(("a", "d"), ("c", "b"))}) == 7
    assert print_of(("a", "b"), ("c", "d")) == print_of(("c", "d"), ("a", "b"))


def test_atoms_laid_out_by_cell_are_not_shuffled(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(int(a), k, *map(float, rng.uniform(0, 60, 3)), 1.0) for k, a in enumerate(rng.choice([1, 2, 3], 2000, p=[0.9, 0.05, 0.05]))]
    atoms = spark.createDataFrame(rows, "assembly_id long, atom_id long, x double, y double, z double, occupancy double")
    centers = spark.createDataFrame([(a, 10 * a + k, *map(float, rng.uniform(10, 50, 3))) for a in (1, 2, 3) for k in range(5)], "assembly_id long, zone_id long, cx double, cy double, cz double")
    laid = spatial.lay_out(atoms, "zf_laid_test", 10.0, f"file://{tmp_path}/laid")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for radius in (10.0, 6.0, 14.0):
            found, plain = (spatial.atoms_within(centers, x, radius) for x in (laid, atoms))
            key = lambda df: sorted((r.zone_id, r.atom_id) for r in df.collect())
            assert key(found) == key(plain) and found.columns == plain.columns
            plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
            assert plan.count("Exchange hashpartitioning") == (1 if radius <= 10 else 2)
        value = lambda x: {r.zone_id: r.density for r in spatial.exact_density(x, centers, 8.0).collect()}
        assert value(laid) == pytest.approx(value(atoms))
        sizes = laid.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert sizes < 500  # an assembly of 1800 atoms is in many buckets
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE zf_laid_test")

"""Golden cases and invariants of single operators."""

import math

import numpy as np
import pytest

from zoneforge.functions import frames as f
from zoneforge.functions import random as r
from zoneforge.operators import density, raster, sampling, spatial, splits, tables
from zoneforge.operators.graph import components
from zoneforge.plans import jobs
from zoneforge.plans.jobs import PickParams
from zoneforge.sources import readers, store

POINTS = "assembly_id long, zone_id long, cx double, cy double, cz double"


def test_kernel_is_a_unit_sphere():
    for radius, voxel in ((15.0, 2.0), (1.0, 1.0), (3.0, 1.0), (0.4, 1.0)):
        cells = density.kernel_cells(radius, voxel)
        assert sum(c[3] for c in cells) == pytest.approx(1, abs=1e-9)
        assert {(-a, -b, -c) for a, b, c, _ in cells} == {c[:3] for c in cells}
    assert density.kernel_cells(0.4, 1.0) == ((0, 0, 0, pytest.approx(1.0)),)


def test_density_by_tiles_equals_the_relational_form(spark):
    rng = np.random.default_rng(0)
    atoms = spark.createDataFrame([(1, *map(float, rng.normal(60, 12, 3)), 1.0) for _ in range(400)], "assembly_id long, x double, y double, z double, occupancy double")
    voxels = density.voxel_occupancy(atoms, 1.0)
    a, b = ({(x.ix, x.iy, x.iz): x.rho for x in density.smooth_density(voxels, 3.0, 1.0, m).where("rho > 1e-6").collect()} for m in ("relational", "fft"))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-6


def test_grid_density_is_near_the_exact_one(spark):
    rng = np.random.default_rng(1)
    atoms = spark.createDataFrame([(1, *map(float, rng.uniform(-30, 30, 3)), 1.0) for _ in range(6000)], "assembly_id long, x double, y double, z double, occupancy double")
    points = spark.createDataFrame([(1, k, *map(float, rng.uniform(-12, 12, 3))) for k in range(40)], POINTS)
    grid = density.smooth_density(density.voxel_occupancy(atoms, 2.0), 15.0, 2.0, "fft")
    near = {x.zone_id: x.density for x in density.interpolate_density(grid, points, 2.0).collect()}
    exact = {x.zone_id: x.density for x in spatial.exact_density(atoms, points, 15.0).collect()}
    assert max(abs(near[k] - exact[k]) for k in exact) < 2


def test_interpolation_is_zero_outside_and_when_empty(spark):
    grid = spark.createDataFrame([(1, 0, 0, 0, 8.0)], "assembly_id long, ix long, iy long, iz long, rho double")
    points = spark.createDataFrame([(1, 0, 0.5, 0.5, 0.5), (1, 1, 0.6, 0.5, 0.5), (2, 2, 0.5, 0.5, 0.5)], POINTS)
    assert {x.zone_id: x.density for x in density.interpolate_density(grid, points, 1.0).collect()} == {0: 8.0, 1: 0.0, 2: 0.0}


def test_zone_grid_of_six_atoms(spark):
    atoms = spark.createDataFrame([(1, *map(float, p)) for p in ((4, 0, 0), (-4, 0, 0), (0, 2, 0), (0, -2, 0), (0, 0, 1), (0, 0, -1))], "assembly_id long, x double, y double, z double")
    for axes in ("identity", "principal"):
        got = {tuple(round(v, 6) + 0.0 for v in (c.cx, c.cy, c.cz)) for c in spatial.zone_grid(atoms, 2.0, axes).collect()}
        assert got == {(x, y, 0.0) for x in (-4.0, -2.0, 0.0, 2.0, 4.0) for y in (-2.0, 0.0, 2.0)}


def test_radius_is_inclusive_and_density_gate_strict(spark):
    atoms = spark.createDataFrame([(1, 1, 3.0, 0.0, 0.0, 1.0), (1, 2, 3.001, 0.0, 0.0, 1.0)], "assembly_id long, atom_id long, x double, y double, z double, occupancy double")
    home = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0)], POINTS)
    assert [a.atom_id for a in spatial.atoms_within(home, atoms, 3.0).collect()] == [1]
    dirs = f.direction_sets(spark, "cube", 3.0)
    limit = 1 / spatial.sphere_volume_nm3(0.5)
    count = lambda m: spatial.zone_neighbors(home, dirs, lambda p: spatial.exact_density(atoms, p, 0.5), m).count()
    assert count(limit * 0.99) == 1 and count(2 * limit) == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + k, 1001 + k) for k in range(70)] + [(5000, 6000 + k) for k in range(100)] + [(9, 9), (7777, 7777), (None, 3)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {v: v for e in edges for v in e if v is not None}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a is not None:
            parent[root(a)] = root(b)
    assert got.keys() == {v for e in edges if None not in e for v in e}
    assert len({(root(v), got[v]) for v in got}) == len({root(v) for v in got}) == len(set(got.values()))
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize(
    ("sizes", "targets", "expected"),
    [
        ({"a": 1, "b": 1}, {"train": 1, "test": 1}, {"a": "train", "b": "test"}),
        ({"a": 8, "b": 1, "c": 1}, {"train": 0.8, "val": 0.1, "test": 0.1}, {"a": "train", "b": "val", "c": "test"}),
        ({"a": 5, "b": 3, "c": 2}, {"train": 0.5, "test": 0.5}, {"a": "train", "b": "test", "c": "test"}),
    ],
)
def test_allocate_splits(spark, sizes, targets, expected):
    groups = spark.createDataFrame(list(sizes.items()), "group_id string, zones long")
    assert {x.group_id: x.split for x in splits.allocate_splits(groups, targets, "argmax").collect()} == expected
    drawn = {x.group_id: x.split for x in splits.allocate_splits(groups, targets, "weighted", 3).collect()}
    assert drawn.keys() == expected.keys() and set(drawn.values()) <= set(targets)


def folded(sizes, targets):
    """The fold one group after another."""
    names, total = list(targets), sum(sizes.values())
    goal, have, out = [total * w / sum(targets.values()) for w in targets.values()], [0] * len(targets), {}
    for group, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        room = [g - h - n for g, h in zip(goal, have, strict=True)]
        if all(r <= 0 for r in room):
            room = [g - h for g, h in zip(goal, have, strict=True)]
        k = max(range(len(names)), key=lambda i: (room[i], -i))
        have[k] += n
        out[group] = names[k]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_allocation_by_histogram_is_the_fold(spark, seed):
    rng = np.random.default_rng(seed)
    n = [0, 1, 7, 60, 400, 3000][seed]
    sizes = {k: int(v) for k, v in enumerate(rng.geometric(0.3, n) if seed % 2 else rng.integers(0, 40, n))}
    targets = [{"train": 8.0, "val": 1.0, "test": 1.0}, {"a": 1.0, "b": 1.0}, {"a": 0.5, "b": 0.25, "c": 0.25, "d": 0.0}][seed % 3]
    groups = spark.createDataFrame(list(sizes.items()), "group_id long, zones long").repartition(4)
    assert {x.group_id: x.split for x in splits.allocate_splits(groups, targets, "argmax").collect()} == folded(sizes, targets)
    drawn = [{x.group_id: x.split for x in splits.allocate_splits(groups.repartition(k), targets, "weighted", 5).collect()} for k in (1, 3)]
    assert drawn[0] == drawn[1] and drawn[0].keys() == sizes.keys()
    if n > 1000:
        total = sum(sizes.values())
        for k, w in targets.items():
            share = sum(v for g, v in sizes.items() if drawn[0][g] == k) / total
            assert share == pytest.approx(w / sum(targets.values()), abs=0.02)


def test_fractions_and_dense_index(spark):
    rows = spark.createDataFrame([(k, float(k)) for k in range(1, 5)], "k long, v double")
    assert {r.k: r.f for r in tables.fraction_of_total(rows, "v", "f").collect()} == {1: 0.1, 2: 0.2, 3: 0.3, 4: 0.4}
    assert tables.fraction_of_total(rows.where("k < 0"), "v", "f").count() == 0
    many = spark.range(1000).selectExpr("id", "cast(hash(id) % 7 as int) AS g").repartition(9)
    got = sorted(tables.dense_index(many, ["g", "id"], "at", 5).collect(), key=lambda r: (r.g, r.id))
    assert [r["at"] for r in got] == list(range(5, 1005))
    assert tables.dense_index(many.where("id < 0"), ["g", "id"]).count() == 0


def test_vectors_of_no_length_are_an_error(spark):
    rows = spark.sql("SELECT named_struct('x', 0D, 'y', 0D, 'z', 0D) AS p, named_struct('x', 1D, 'y', 0D, 'z', 0D) AS q")
    for a, b in (("p", "q"), ("q", "p")):
        with pytest.raises(Exception, match="no length"):
            f.align_vectors(rows, a, b).collect()


def test_mmcif_with_missing_values_and_gzip(spark, tmp_path):
    import gzip

    head = "loop_\n" + "".join(f"_atom_site.{c}\n" for c in ("id", "type_symbol", "label_atom_id", "label_comp_id", "label_asym_id", "label_entity_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z"))
    body = "data_1ABC\n" + head + "1 C CA ALA A 1 5 1.5 2.5 3.5\n2 N N ALA A 1 . ? . 3.5\n#\n_entity.id 1\n_entity.type polymer\n"
    (tmp_path / "a.cif").write_text(body)
    with gzip.open(tmp_path / "b.cif.gz", "wt") as out:
        out.write(body.replace("1ABC", "2XYZ"))
    found = readers.ingest_mmcif(spark, f"file://{tmp_path}/*")
    atoms = sorted(found["asym_atoms"].collect(), key=lambda r: (r.pdb_id, r.atom_id))
    assert [(r.pdb_id, r.atom_id, r.seq_id, r.x, r.y, r.z, r.occupancy, r.model_id) for r in atoms[:2]] == [("1abc", 1, 5, 1.5, 2.5, 3.5, 1.0, "1"), ("1abc", 2, None, None, None, 3.5, 1.0, "1")]
    assert len(atoms) == 4 and atoms[3].pdb_id == "2xyz" and [r.type for r in found["entities"].collect()] == ["polymer"] * 2
    assert found["oper_map"].count() == found["polymers"].count() == 0


def test_direction_sets_are_unit_vectors():
    sizes = {"tetrahedron": 4, "cube": 6, "octahedron": 8, "dodecahedron": 12, "icosahedron": 20, "octahedron+cube": 14, "icosahedron+dodecahedron": 32, "icosphere2": 42, "icosphere3": 92}
    for name, n in sizes.items():
        found = f.directions(name)
        assert len({tuple(round(v, 6) for v in p) for p in found}) == len(found) == n
        assert all(math.isclose(sum(v * v for v in p), 1, abs_tol=1e-12) for p in found)


def test_rotations_align_vectors(spark):
    rng = np.random.default_rng(3)
    pairs = [(rng.normal(size=3), rng.normal(size=3)) for _ in range(50)] + [(v, -v * 2) for v in np.eye(3)] + [(np.array([1.0, 2, 3]), np.array([-1.0, -2, -3 + 1e-7]))]
    df = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in pairs], "a double, b double, c double, d double, e double, g double")
    df = df.select(f.vector("a", "b", "c").alias("p"), f.vector("d", "e", "g").alias("q"))
    for row in f.align_vectors(df, "p", "q").collect():
        p, q, m = np.array(row.p), np.array(row.q), np.array(row.rotation).reshape(3, 3)
        assert np.allclose(m @ m.T, np.eye(3), atol=1e-5) and np.linalg.det(m) == pytest.approx(1, abs=1e-5)
        assert np.allclose(m @ (q / np.linalg.norm(q)), p / np.linalg.norm(p), atol=1e-5)


def test_random_vectors_are_uniform(spark):
    df = r.sample_unit_vector(spark.range(4000).withColumnRenamed("id", "i"), 0).select("v.*").toPandas()
    for c in "xyz":
        v = np.sort(df[c].to_numpy())
        assert np.abs((v + 1) / 2 - np.arange(len(v)) / len(v)).max() < 0.03
    assert np.allclose((df**2).sum(axis=1), 1)


def test_image_sums_to_occupancy(spark):
    atoms = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, "C", True), (0, 1.0, 1.0, 1.0, 0.5, "Xx", False)], "i long, x double, y double, z double, occupancy double, element string, is_polymer boolean")
    grid = raster.Grid(5, 1.0, 2)
    voxels = raster.rasterize(raster.element_channels(raster.clip_to_image(atoms, grid), [["C"], ["*"]]), grid)
    image = raster.pack_image(raster.dense(voxels, atoms, grid), grid).collect()[0].image
    assert len(image) == 2 * 125 and sum(image[:125]) == pytest.approx(1) and sum(image[125:]) == pytest.approx(0.5)


def test_overlaps_are_shares_of_spheres():
    rng = np.random.default_rng(4)
    for radius, width in ((0.5, 1.0), (1.3, 1.0), (0.2, 1.0), (2.0, 1.5)):
        center = np.concatenate([rng.uniform(-3, 3, (20, 3)), [[0.0, 0.0, 0.0], [0.5 * width] * 3, [0.5 * width, 0.5 * width, 0.0]]])
        first, share = raster.overlaps(center, radius, width)
        assert share.min() > -1e-9 and np.allclose(share.sum((1, 2, 3)), 1, atol=1e-6)
        points = rng.uniform(-radius, radius, (400_000, 3))
        points = points[(points**2).sum(1) <= radius**2]
        for c, f0, s in zip(center[:20], first, share, strict=False):
            cell = np.floor((points + c) / width).astype(int) - f0
            counted = np.zeros(s.shape)
            np.add.at(counted, tuple(cell.T), 1 / len(points))
            assert np.abs(counted - s).max() < 0.005
    _, share = raster.overlaps(np.array([[0.0, 0.0, 0.0], [0.5, 0.5, 0.0], [0.5, 0.5, 0.5]]), 0.5, 1.0)
    assert sorted(share[0].ravel()) == pytest.approx([1 / 8] * 8) and sorted(share[1].ravel())[-2:] == pytest.approx([0.5, 0.5]) and share[2].max() == pytest.approx(1)


def test_images_of_samples_near_their_origin(spark):
    rng = np.random.default_rng(5)
    atoms = spark.createDataFrame([(k % 2, *map(float, rng.uniform(-20, 20, 3)), 1.0, "CNO"[k % 3]) for k in range(600)], "assembly_id long, x double, y double, z double, occupancy double, element string")
    grid, channels = raster.Grid(5, 1.5, 2), [["C"], ["*"]]
    frames = r.sample_frame(spark.createDataFrame([(i, i % 3, (float(i), 2.0, -3.0)) for i in range(7)], "i long, assembly_id long, origin struct<x:double,y:double,z:double>"), "origin")
    reach = (grid.half + grid.atom_radius) * 3**0.5
    seen = [raster.element_channels(raster.clip_to_image(sampling.apply_frames(atoms, frames, within=w), grid), channels) for w in (None, reach)]
    whole = raster.pack_image(raster.dense(raster.rasterize(seen[0], grid), frames, grid), grid)
    a, b = ({x.i: x.image for x in d.collect()} for d in (whole, raster.images(raster.rasterize(seen[1], grid), frames.select("i"), grid)))
    assert a.keys() == b.keys() == set(range(7)) and sum(map(sum, a.values())) > 5
    assert all(np.allclose(a[i], b[i], atol=1e-6) for i in a) and not any(b[2])


def test_parameters_are_checked():
    with pytest.raises(ValueError, match="either a distance or a padding"):
        sampling.NeighborParams()
    good = dict(spacing=1.0, density_radius=1.0, min_density=1.0, max_density=1.0, zone_radius=1.0, boundary_depth=1.0, solo=(0.1, 0.1), pair=(0.1, 0.1))
    for bad, message in (({"spacing": 0.0}, "positive"), ({"solo": (2.0, 0.1)}, "between 0 and 1"), ({"geometry": "cube"}, "none of them"), ({"extra": {"x": 1}}, "unknown keys")):
        with pytest.raises(ValueError, match=message):
            PickParams(**(good | bad))


def test_metadata(spark):
    schema = "key string, value string, encoding string"
    values = [None, 3, 2.5, "x", b"\x01", [1, {"a": 2}]]
    meta = spark.createDataFrame([(f"k{i}", *tables.encode_value(v)) for i, v in enumerate(values)], schema)
    assert [tables.metadata_value(meta, f"k{i}") for i in range(len(values))] == values
    with pytest.raises(KeyError):
        tables.metadata_value(meta, "none")
    with pytest.raises(ValueError, match="key exists"):
        tables.metadata_insert(meta, meta.limit(1))
    with pytest.raises(ValueError, match="differs"):
        tables.check_config(meta, meta.withColumn("value", meta.encoding))
    structure = spark.createDataFrame([("a",), ("b",)], "pdb_id string")
    with pytest.raises(ValueError, match="only on the left"):
        tables.update_splits(structure, spark.createDataFrame([("a", "t")], "pdb_id string, split string"))


def test_mmcif_tokens():
    text = "data_X\n# note\n_entity.id 1\n_entity.type 'poly mer'\nloop_\n_a.x\n_a.y\n1 'it''s'\n;two\nlines\n;\n?\n"
    tables_ = readers.cif_tables(text)
    assert tables_["_entity"] == [{"id": "1", "type": "poly mer"}]
    assert tables_["_a"] == [{"x": "1", "y": "it''s"}, {"x": "two\nlines", "y": None}]
    assert readers._operators("(1-3)") == ["1", "2", "3"] and readers._operators("1,2") == ["1", "2"]


def test_mmcif_rows_leave_before_the_file_is_read():
    def lines():
        yield from ["data_1ABC\n", "_entity.id 1\n", "_entity.type polymer\n", "loop_\n", "_atom_site.id\n", "_atom_site.Cartn_x\n"]
        for k in range(50):
            yield f"{k} {k}.5\n"
        raise OSError("the rest isn't there")

    rows = readers.cif_rows(lines())
    assert [next(rows)[1][2] for _ in range(50)] == list(range(50))
    with pytest.raises(OSError, match="isn't there"):
        next(rows)
    two = "data_A\n_entity.id 1\n_entity.type polymer\ndata_B\nloop_\n_entity.id\n_entity.type\n1 water\n2 'a b'\n"
    assert [(t, *r) for t, r in readers.cif_rows(two.splitlines())] == [("entities", "a", "1", "polymer"), ("entities", "b", "1", "water"), ("entities", "b", "2", "a b")]


def test_stored_directions_are_not_replaced(spark, tmp_path):
    path = f"file://{tmp_path}"
    assert store.load_direction_table(spark, path, "cube", 2.0).count() == store.load_direction_table(spark, path, "cube", 2.0).count() == 6
    with pytest.raises(ValueError, match="other neighbour directions"):
        store.load_direction_table(spark, path, "cube", 3.0)


def test_residue_list(spark, tmp_path):
    (tmp_path / "a").write_text("ATP\n  GOL\n")
    (tmp_path / "b").write_text("-\n")
    (tmp_path / "c").write_text("TOOLONG\n")
    assert readers.read_residue_list(spark, f"file://{tmp_path}/a") == ["ATP", "GOL"] and readers.read_residue_list(spark, f"file://{tmp_path}/b") == []
    with pytest.raises(ValueError, match="not a residue"):
        readers.read_residue_list(spark, f"file://{tmp_path}/c")


def test_novelty_can_keep_one_zone_of_an_assembly(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 3, "a"), (2, 3, "b"), (3, 4, "b")], "assembly_rank long, zone long, key string")
    every = {tuple(x) for x in splits.select_novel_zones(rows).collect()}
    one = {tuple(x) for x in splits.select_novel_zones(rows, True).collect()}
    assert every == {(1, 1), (1, 2), (2, 3)} and one == {(1, 1), (2, 3)}


def test_group_sizes_are_joined_once_before_they_are_dealt(spark, monkeypatch):
    """Ranges are drawn from a table and not from the plan of joins behind it, which would run twice."""
    seen = []
    monkeypatch.setattr(jobs.splits, "allocate_splits", lambda sizes, *more, own=splits.allocate_splits: seen.append(sizes._jdf.queryExecution().optimizedPlan().toString()) or own(sizes, *more))
    counts = spark.createDataFrame([(1, 2), (2, 3), (3, 5)], "pdb_id long, zones long")
    given, _ = jobs.assign_splits(counts, spark.createDataFrame([(1, 1), (2, 1)], "pdb_id long, cluster long"), {"a": 1.0, "b": 1.0}, "argmax")
    assert {r.pdb_id: r.split for r in given.collect()} == {1: "a", 2: "a", 3: "b"}
    assert "Join" not in seen[0] and "Aggregate" not in seen[0]


def test_zones_are_counted_before_they_are_joined(spark):
    """What meets assemblies is a row for each of them, not one for each zone."""
    zone = spark.createDataFrame([(k, k % 3) for k in range(30)] + [(99, None), (98, 77)], "zone_id long, assembly_id long")
    assembly = spark.createDataFrame([(0, 10), (1, 10), (2, 11)], "assembly_id long, struct_id long")
    structure = spark.createDataFrame([(10, "p"), (11, "q"), (12, "r")], "struct_id long, pdb_id string")
    found = splits.structure_zone_counts(zone, assembly, structure)
    assert {r.pdb_id: r.zones for r in found.collect()} == {"p": 20, "q": 10} and found.dtypes[1] == ("zones", "bigint")
    joins = found._jdf.queryExecution().optimizedPlan().toString().split("Join")
    assert any(line.lstrip(" +-:").startswith("Aggregate [assembly_id") for line in joins[-1].splitlines())

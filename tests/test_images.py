"""Images straight from atoms against voxel rows, and epochs without a shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from zoneforge.operators import raster, sampling
from zoneforge.plans import jobs

RNG = np.random.default_rng(6)


def test_stacks_are_normalised_voxel_rows(spark):
    rows = [(i, v, ["C", "N", "Xx"][int(k)], bool(k % 2), *map(float, RNG.uniform(-6, 6, 3)), float(0.5 + 0.5 * (k % 2))) for i in range(3) for v in (0, 1) for k in RNG.integers(0, 3, 30)]
    atoms = spark.createDataFrame([*rows, (0, 0, "C", True, None, 0.0, 0.0, 1.0)], "i long, view int, element string, is_polymer boolean, x double, y double, z double, occupancy double")
    samples = spark.createDataFrame([(i,) for i in range(4)], "i long")
    grid, mean, std = raster.Grid(5, 2.0, 3, 1.3), [0.1, 0.2, 0.3], [0.5, 2.0, 1.0]
    shown = raster.ligand_channel(raster.element_channels(atoms, [["C"], ["*"]]), "is_polymer", 2)
    found = {r.i: r.images for r in raster.image_stacks(shown, samples, grid, 2, mean, std).collect()}
    assert found.keys() == {0, 1, 2, 3}
    for view in (0, 1):
        voxels = raster.rasterize(shown.where(F.col("view") == view), grid)
        packed = raster.pack_image(raster.normalize_image(voxels, samples, grid, mean, std), grid)
        for r in packed.collect():
            assert np.allclose(found[r.i][view], r.image, atol=1e-5)
    assert np.allclose(found[3][1], np.repeat([-0.2, -0.1, -0.3], 125))
    alone = {r.i: r.images for r in raster.image_stacks(shown.where("view = 0").drop("view"), samples, grid).collect()}
    assert np.allclose(alone[1][0], np.array(found[1][0]) * np.repeat(std, 125) + np.repeat(mean, 125), atol=1e-5)


#: (channels, 1, 1, 3) images in order; mean and std; what comes out.
CASES = [([1, 2, 3], 0, 1, [1, 2, 3]), ([1, 2, 3], 1, 1, [0, 1, 2]), ([2, 4, 6], 0, 2, [1, 2, 3]), ([1, 2, 3, 10, 20, 30], [1, 10], 1, [0, 1, 2, 0, 10, 20]), ([2, 4, 6, 10, 20, 30], [2, 10], [2, 10], [0, 1, 2, 0, 1, 2])]


@pytest.mark.parametrize(("values", "mean", "std", "expected"), CASES)
def test_normalisation_by_channel(spark, values, mean, std, expected):
    channels = len(values) // 3
    grid = raster.Grid(3, 1.0, channels, 0.01)
    atoms = spark.createDataFrame([(0, [c], float(k - 1), 0.0, 0.0, float(values[3 * c + k])) for c in range(channels) for k in range(3)], "i long, channels array<int>, x double, y double, z double, occupancy double")
    (row,) = raster.image_stacks(atoms, atoms.select("i"), grid, 1, mean, std).collect()
    image = np.array(row.images[0]).reshape(channels, 3, 3, 3)
    assert np.allclose(image[:, :, 1, 1].ravel(), expected, atol=1e-5)


def test_samples_with_images(spark):
    """Two assemblies of two atoms far apart: an image that shows one of them sums to 1."""
    vec = "struct<x:double,y:double,z:double>"
    store = {
        "structure": spark.createDataFrame([(1, "p", "1", "val"), (2, "q", "1", "val")], "struct_id long, pdb_id string, model_id string, split string"),
        "assembly": spark.createDataFrame([(1, 1, "1"), (2, 2, "1")], "assembly_id long, struct_id long, pdb_id string"),
        "zone": spark.createDataFrame([(k, k // 2 + 1, ((k % 2) * 20.0, 0.0, 0.0)) for k in range(4)], f"zone_id long, assembly_id long, center {vec}"),
        "atoms": spark.createDataFrame([(a, 20.0 * k, 0.0, 0.0, "CN"[k], a == 1, 1.0) for a in (1, 2) for k in (0, 1)], "assembly_id long, x double, y double, z double, element string, is_polymer boolean, occupancy double"),
    }
    image = jobs.ImageParams(5, 1.0, (("C",), ("*",)), ligand="is_polymer", mean=(0.0, 0.0, 0.5), std=2.0)
    rows = jobs.make_samples(store, "val", 1.0, 0, 8, image=image).collect()
    assert len(rows) == 8
    for r in rows:
        total = np.array(r.image).reshape(3, -1).sum(1) * 2
        assert total[:2] == pytest.approx([1, 0] if r.zone_id % 2 == 0 else [0, 1], abs=1e-4) and total[2] == pytest.approx((r.assembly_id == 1) - 0.5 * 125, abs=1e-4)
    only = jobs.make_samples(store, "val", 1.0, 0, 4, image=jobs.ImageParams(5, 1.0, keep="element = 'N'")).collect()
    assert [round(sum(r.image)) for r in sorted(only, key=lambda r: r.i)] == [0, 1, 0, 1]
    pairs = jobs.make_samples(store, "val", 1.0, 0, 4, pair=sampling.NeighborParams(distance=20.0), image=jobs.ImageParams(5, 1.0)).collect()
    assert all(len(r.image_a) == len(r.image_b) == 125 and sum(r.image_a) == pytest.approx(1, abs=1e-4) for r in pairs)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_epochs_are_permutations_without_a_shuffle(spark, n):
    zones = spark.range(7)
    plans = {(e, advance): sampling.epoch_plan(7, e, n, 3, advance, zones) for e in (0, 1) for advance in (True, False)}
    assert "Exchange" not in plans[1, True]._jdf.queryExecution().executedPlan().toString()
    order = {k: [r.i for r in sorted(p.collect(), key=lambda r: r.pos)] for k, p in plans.items()}
    for (epoch, advance), own in order.items():
        start = epoch * n * advance
        assert sorted(own) == list(range(start, start + n))
    if n > 90:
        assert order[0, False] != order[1, False] and np.abs(np.corrcoef(order[0, False], range(n))[0, 1]) < 0.3 and sum(a == b for a, b in zip(order[0, False], order[1, False], strict=True)) < 10

"""Composite jobs: zones, splits, samples, curricula."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneforge.functions import frames as f
from zoneforge.functions.random import sample_frame, sample_in_cube
from zoneforge.functions.storage import materialize
from zoneforge.operators import density, filters, raster, sampling, spatial, splits, tables
from zoneforge.sources.store import append_scores


@dataclass(frozen=True)
class PickParams:
    """Settings of ``pick_training_zones``; ranges are checked on creation."""

    spacing: float
    density_radius: float
    min_density: float
    max_density: float
    zone_radius: float
    boundary_depth: float
    solo: tuple[float, float]
    pair: tuple[float, float]
    elements: tuple[str, ...] = ()
    nonbiological: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    voxel: float = 2.0
    coarse_voxel: float = density.COARSE
    coarse_from: int = density.LARGE
    axes: str = "principal"
    density_method: str = "exact"
    geometry: str | None = None
    distance: float | None = None
    neighbor_threshold: int = 0
    novelty: bool = True
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        for name in ("spacing", "density_radius", "zone_radius", "voxel", "coarse_voxel"):
            if not getattr(self, name) > 0:
                raise ValueError(f"{name} must be positive")
        if any(not 0 <= v <= 1 for v in (*self.solo, *self.pair)):
            raise ValueError("fractions lie between 0 and 1")
        if (self.geometry is None) != (self.distance is None) or (self.neighbor_threshold > 0 and self.geometry is None):
            raise ValueError("neighbours need geometry, distance and threshold, or none of them")
        if self.extra:
            raise ValueError(f"unknown keys: {', '.join(sorted(self.extra))}")


def _density(atoms: DataFrame, solid: DataFrame, params: PickParams) -> tuple[Callable[[DataFrame], DataFrame], DataFrame | None]:
    """What measures points by the density of ``solid``, and the grid if there is one. Assemblies of very many ``atoms`` have coarse voxels, in the same pass."""
    if params.density_method == "exact":
        return lambda points: spatial.exact_density(solid, points, params.density_radius), None
    sizes = density.coarsen_large(atoms, params.voxel, params.coarse_from, params.coarse_voxel)
    voxels = density.voxel_occupancy(density.with_resolution(solid, sizes, params.voxel))
    grid = materialize(density.smooth_density(voxels, params.density_radius, sizes=(params.voxel, params.coarse_voxel)), "grid")
    return lambda points: density.interpolate_density(grid, points), grid


def pick_training_zones(inputs: dict[str, DataFrame], params: PickParams) -> dict[str, DataFrame]:
    """Zones, their neighbours, subchains and pairs, and the atoms near them.

    inputs: atoms; asym (assembly_id, subchain_id, occupancy: totals of allowed subchains);
    and, for novelty, rank (assembly_id, assembly_rank), subchain_entity (assembly_id, subchain_id, entity_id, comp_id),
    cluster (entity_id, cluster_id), nonspecific (comp_id), and seen: keys (key) of earlier runs, None, or a function that gives what is new of a table of keys: with it new keys are given as novel_key. Cheap gates stand before dear ones: lists, elements, density, neighbours, subchains, novelty.
    """
    atoms = inputs["atoms"]
    if params.exclude:
        atoms = filters.exclude_structures(atoms, list(params.exclude))
    if params.elements:
        ok = filters.check_elements(atoms, list(params.elements)).where("ok")
        atoms = atoms.join(ok, "assembly_id", "left_semi")
    solid = filters.prune_nonbiological(atoms, list(params.nonbiological))
    measure, grid = _density(atoms, solid, params)
    if grid is not None:
        atoms, solid = (filters.gate_max_density(x, grid, params.max_density) for x in (atoms, solid))
    centers = spatial.zone_grid(atoms, params.spacing, params.axes)
    centers = tables.dense_index(centers.select("assembly_id", *[F.round(c, 6).alias(c) for c in spatial.CENTER]), ["assembly_id", *spatial.CENTER], "zone_id")
    zones = materialize(filters.gate_min_density(measure(centers), params.min_density), "zones")
    neighbors = None
    if params.neighbor_threshold > 0:
        dirs = f.direction_sets(atoms.sparkSession, params.geometry, params.distance)
        neighbors = materialize(spatial.zone_neighbors(zones.drop("density"), dirs, measure, params.min_density), "neighbors")
        zones = filters.gate_neighbor_count(zones, neighbors, params.neighbor_threshold)
    shares = materialize(spatial.zone_fractions(zones, atoms, inputs["asym"], params.zone_radius), "shares")
    solo = spatial.present(shares, *params.solo)
    pairs = spatial.subchain_pairs(spatial.present(shares, *params.pair))
    if params.novelty:
        where = zones.select("zone_id", "assembly_id")
        entity = inputs["subchain_entity"]
        own = lambda df, k="": df.join(where, "zone_id").join(entity.toDF("assembly_id", f"subchain_id{k}", f"entity{k}" if k else "entity_id", f"comp{k}" if k else "comp_id"), ["assembly_id", f"subchain_id{k}"]).drop("assembly_id")
        keys = splits.novelty_keys(own(solo).select("zone_id", "entity_id", "comp_id"), own(own(pairs, "_1"), "_2").select("zone_id", "entity_1", "comp_1", "entity_2", "comp_2"), inputs["cluster"], inputs["nonspecific"])
        seen = inputs.get("seen")
        if callable(seen):
            keys = seen(keys)
        elif seen is not None:
            keys = keys.join(seen.select("key"), "key", "left_anti")
        ranked = keys.join(where, "zone_id").join(inputs["rank"], "assembly_id").select("assembly_rank", F.col("zone_id").alias("zone"), "key")
        novel = splits.select_novel_zones(ranked).select(F.col("zone").alias("zone_id"))
        zones = materialize(zones.join(novel, "zone_id", "left_semi"), "novel")
        solo, pairs = (x.join(zones, "zone_id", "left_semi") for x in (solo, pairs))
        neighbors = neighbors.join(zones, "zone_id", "left_semi") if neighbors is not None else None
    out = {"zone": zones.select("zone_id", "assembly_id", F.struct(*[F.col(c).alias(c[1]) for c in spatial.CENTER]).alias("center")), "subchain": solo, "subchain_pair": pairs, "atoms": spatial.prune_distant_atoms(zones, atoms, params.zone_radius, params.boundary_depth)}
    if params.novelty and "seen" in inputs:
        out["novel_key"] = keys.select("key").distinct()
    return out if neighbors is None else out | {"zone_neighbor": neighbors}


def make_splits(store: dict[str, DataFrame], clusters: DataFrame, targets: dict[str, float], mode: str = "weighted", seed: int = 0, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(structure table with new splits, or as it is on a dry run; summary by split)."""
    counts = materialize(splits.structure_zone_counts(store["zone"], store["assembly"], store["structure"]), "counts")
    given, summary = assign_splits(counts, clusters, targets, mode, seed)
    structure = store["structure"] if dry_run else tables.update_splits(store["structure"], given)
    return structure, summary


def assign_splits(counts: DataFrame, clusters: DataFrame, targets: dict[str, float], mode: str = "weighted", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    groups = materialize(splits.connected_groups(counts.select("pdb_id"), clusters), "groups")
    sizes = materialize(splits.group_sizes(groups, counts), "sizes")  # it is dealt by range, which reads it twice
    allocated = splits.allocate_splits(sizes, targets, mode, seed)
    given = materialize(groups.join(allocated, "group_id").select("pdb_id", "split"), "splits")
    return given, splits.split_summary(given, counts, targets)


@dataclass(frozen=True)
class ImageParams:
    """How samples are shown: a channel for each list of elements, one more for atoms of which ``ligand`` (SQL) holds, of atoms that ``keep`` (SQL) lets pass."""

    length: int
    resolution: float
    channels: tuple[tuple[str, ...], ...] = (("*",),)
    radius: float | None = None
    ligand: str | None = None
    keep: str | None = None
    mean: float | tuple[float, ...] = 0.0
    std: float | tuple[float, ...] = 1.0

    @property
    def grid(self) -> raster.Grid:
        return raster.Grid(self.length, self.resolution, len(self.channels) + (self.ligand is not None), self.radius)


def make_samples(store: dict[str, DataFrame], split: str, size: float, start: int, n: int, max_difficulty: float = 1.0, pair: sampling.NeighborParams | None = None, image: ImageParams | None = None) -> DataFrame:
    """Samples ``start`` to ``start + n - 1`` of a split: frames, and normalised images if ``image`` says how (``image``, or ``image_a`` and ``image_b`` of pairs).

    Only the train split is filtered by the curriculum, and a limit of 1 or more filters nothing.
    """
    zones = splits.select_split(store["zone"], store["assembly"], store["structure"], split)
    if split == "train" and max_difficulty < 1:
        zones = splits.curriculum_filter(zones, splits.curriculum_easy(store["curriculum"], max_difficulty))
    drawn = sampling.sample_index(zones.join(store["zone"], "zone_id"), start, n)
    if pair is None:
        out = sample_frame(sample_in_cube(drawn, size), "origin")
        views = {"frame": "image"}
    else:
        dirs = [(r.dx, r.dy, r.dz) for r in f.unit_directions(store["neighbor"]).orderBy("neighbor_id").collect()] if "neighbor" in store else []
        if "zone_neighbor" in store:
            drawn = drawn.join(spatial.collect_neighbors(store["zone_neighbor"]), "zone_id", "left")
        out = sampling.neighbor_frames(drawn, dirs, pair, size)
        views = {"frame_a": "image_a", "frame_c": "image_b"}
    if image is None:
        return out
    out, grid = materialize(out, "samples"), image.grid
    atoms = store["atoms"] if image.keep is None else store["atoms"].where(image.keep)
    reach = (grid.half + grid.atom_radius) * 3**0.5
    seen = None
    for k, view in enumerate(views):
        near = raster.clip_to_image(sampling.apply_frames(atoms, out.select("i", "assembly_id", view), view, reach), grid)
        near = raster.element_channels(near, [list(c) for c in image.channels])
        near = near if image.ligand is None else raster.ligand_channel(near, image.ligand, len(image.channels))
        near = near.select("i", "channels", "x", "y", "z", "occupancy", F.lit(k).alias("view"))
        seen = near if seen is None else seen.unionByName(near)
    packed = raster.image_stacks(seen, out, grid, len(views), image.mean, image.std)
    return out.join(packed, "i").withColumns({name: F.col("images")[k] for k, name in enumerate(views.values())}).drop("images")


def make_curriculum(store: dict[str, DataFrame], scored: Callable[[DataFrame], DataFrame], replicates: int, size: float, batch: int, pair: sampling.NeighborParams | None = None) -> DataFrame:
    """The curriculum with new scores: train samples, ``replicates`` to a zone, full batches only.

    ``scored`` maps samples to (zone_id, random_seed, difficulty); seeds go on from the greatest stored.
    """
    n = splits.select_split(store["zone"], store["assembly"], store["structure"], "train").count()
    first = splits.curriculum_next_seed(store["curriculum"]).first()[0]
    full = n * replicates // batch * batch
    samples = make_samples(store, "train", size, first, full, 1.0, pair).withColumn("random_seed", F.col("i"))
    return append_scores(store["curriculum"], scored(samples))

"""Novel zones, related groups, splits and curricula."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zoneforge.operators.graph import components
from zoneforge.operators.tables import dense_index

#: Edges that one task may hold (about 100 bytes each) when the rounds on the cluster have left no more.
FEW_EDGES = 1_000_000


def select_novel_zones(candidates: DataFrame, dedupe_within: bool = False) -> DataFrame:
    """(assembly_rank, zone) of zones that show a key no assembly of lower rank shows.

    candidates: (assembly_rank, zone, key), a row for each key of a zone. A kept zone only
    adds its keys, so what has been seen by a rank is all keys of lower ranks: a key is new
    where its rank is the least. With ``dedupe_within`` the first zone of that assembly alone has it.
    A key shared by a third of all zones meets a partial aggregate and a join, no window.
    """
    rank = F.struct("assembly_rank", "zone") if dedupe_within else F.struct("assembly_rank")
    first = candidates.groupBy("key").agg(F.min(rank).alias("first"))
    return candidates.join(first, "key").where(rank == F.col("first")).select("assembly_rank", "zone").distinct()


def novelty_keys(solo: DataFrame, pairs: DataFrame, cluster: DataFrame, nonspecific: DataFrame) -> DataFrame:
    """(zone_id, key): clusters of the zone's subchains and unordered cluster pairs.

    solo: (zone_id, entity_id, comp_id); pairs: (zone_id, entity_1, comp_1, entity_2, comp_2).
    Nonspecific ligands go first; an entity without a cluster is a key of its own.
    """
    names = cluster.select("entity_id", F.concat(F.lit("c"), F.col("cluster_id").cast("string")).alias("name"))
    named = lambda df, entity, out: df.join(names.toDF(entity, out), entity, "left").withColumn(out, F.coalesce(out, F.concat(F.lit("e"), F.col(entity).cast("string"))))
    one = named(solo.join(nonspecific, "comp_id", "left_anti"), "entity_id", "key").select("zone_id", "key")
    two = pairs
    for k in ("1", "2"):
        two = two.join(nonspecific.select(F.col("comp_id").alias(f"comp_{k}")), f"comp_{k}", "left_anti")
        two = named(two, f"entity_{k}", f"key_{k}")
    two = two.select("zone_id", F.concat_ws("|", F.least("key_1", "key_2"), F.greatest("key_1", "key_2")).alias("key"))
    return one.unionByName(two)


def structure_zone_counts(zone: DataFrame, assembly: DataFrame, structure: DataFrame) -> DataFrame:
    """(pdb_id, zones); structures without zones are absent. Zones are counted by assembly before anything is joined."""
    own = zone.groupBy("assembly_id").agg(F.count(F.lit(1)).alias("zones"))
    joined = own.join(assembly.select("assembly_id", "struct_id"), "assembly_id").join(structure.select("struct_id", "pdb_id"), "struct_id")
    return joined.groupBy("pdb_id").agg(F.sum("zones").alias("zones"))


def connected_groups(structures: DataFrame, clusters: DataFrame) -> DataFrame:
    """(pdb_id, group_id): structures chained by shared clusters; group_id is the least structure of the group.

    A cluster links each member to its least one, so a cluster of any size is fewer edges than it has members, and one of a
    single structure, however many rows it has, is none: only what is linked goes through the rounds. Rows may repeat. Unknown
    structures link others and are then left out.
    """
    alike = structures.schema["pdb_id"].dataType == clusters.schema["pdb_id"].dataType
    node = (F.col("pdb_id") if alike else F.col("pdb_id").cast("string")).alias("node")
    members = clusters.select(node, "cluster").where("node is not null and cluster is not null")
    hubs = members.groupBy("cluster").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").drop("last")
    roots = components(members.join(hubs, "cluster").where("node <> hub"), "node", "hub", few=FEW_EDGES)
    own = structures.select("pdb_id", node).where("pdb_id is not null").distinct()
    linked = own.join(roots, "node").select("pdb_id", "root")
    least = linked.groupBy("root").agg(F.min("pdb_id").alias("group_id"))
    found = linked.join(least, "root").select("pdb_id", "group_id")
    return own.join(found, "pdb_id", "left").select("pdb_id", F.coalesce("group_id", "pdb_id").alias("group_id"))


def group_sizes(groups: DataFrame, counts: DataFrame) -> DataFrame:
    return groups.join(counts, "pdb_id").groupBy("group_id").agg(F.sum("zones").cast("long").alias("zones"))


def _before(goal: list[float], have: list[int], n: int, k: int, j: np.ndarray) -> np.ndarray:
    """How many groups of ``n`` zones are dealt before split k gets its group number j (from 0), by argmax.

    Split m's room before its i-th is goal - have - i n. The greatest room takes the next, the first on ties,
    so groups go in order of falling rooms, merged over the splits.
    """
    room, out = goal[k] - (have[k] + n * j), j.copy()
    for m in range(len(goal)):
        if m != k:
            ahead = lambda i, m=m: (goal[m] - (have[m] + n * i) >= room) if m < k else (goal[m] - (have[m] + n * i) > room)
            count = np.maximum(0, np.floor((goal[m] - have[m] - room) / n).astype(np.int64))
            count = np.where((count > 0) & ~ahead(count - 1), count - 1, count)
            out += np.where(ahead(count), count + 1, count)
    return out


def _dealt(goal: list[float], have: list[int], n: int, rank: np.ndarray) -> np.ndarray:
    """The split of the groups of these ranks among those of ``n`` zones."""
    out = np.zeros(len(rank), np.int64)
    for k in range(len(goal)):
        low, high = np.zeros(len(rank), np.int64), rank + 1
        while (low < high).any():
            mid = (low + high) // 2
            less = _before(goal, have, n, k, mid) < rank
            low, high = np.where((low < high) & less, mid + 1, low), np.where((low < high) & ~less, mid, high)
        out[_before(goal, have, n, k, low) == rank] = k
    return out


def _plan(sizes: list[tuple[int, int]], goal: list[float], mode: str, seed: int) -> dict[int, tuple]:
    """By size, largest first: what splits have before it (argmax), or the numbers that batches of its groups give each split (weighted)."""
    have, out = [0] * len(goal), {}
    for n, count in sizes:
        if n <= 0:
            out[n] = (list(have), None)
        elif mode == "argmax":
            out[n] = (list(have), None)
            for k in range(len(goal)):
                low, high = 0, count
                while low < high:
                    mid = (low + high) // 2
                    low, high = (mid + 1, high) if _before(goal, out[n][0], n, k, np.array([mid]))[0] < count else (low, mid)
                have[k] += n * low
        else:
            given, left = [], count
            rng = np.random.default_rng((seed % (1 << 32), n))
            while left:
                batch = min(left, max(1, count // BATCHES))
                room = [g - h - n for g, h in zip(goal, have, strict=True)]
                if all(r <= 0 for r in room):
                    room = [g - h for g, h in zip(goal, have, strict=True)]
                weight = np.maximum(room, 0.0)
                odds = weight / weight.sum() if weight.sum() > 0 else np.eye(len(goal))[int(np.argmax(room))]
                given.append(rng.multinomial(batch, odds))
                have = [h + n * int(x) for h, x in zip(have, given[-1], strict=True)]
                left -= batch
            out[n] = (None, np.array(given))
    return out


#: Draws of a size at most: its groups are drawn in so many batches, each by the room that splits have then.
BATCHES = 256


def allocate_splits(groups: DataFrame, targets: dict[str, float], mode: str = "weighted", seed: int = 0) -> DataFrame:
    """(group_id, split): largest groups first, each to a split by the room that splits have left.

    A split's weight is its room after taking the group, where positive; if none is, its room before.
    'argmax' takes the greatest (the first on ties), 'weighted' draws: numbers by size and batch from a multinomial of the
    weights, and which group gets which by a hash of seed and group. The order is that of (zones, group_id), for drawn ones (zones, hash).

    Only the histogram of sizes is folded, on the driver: different sizes that sum to the number of zones are
    at most the root of twice that number. A group finds its split from what splits had before its size and
    its rank among equals, both exact, where it lies.
    """
    names = list(targets)
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("group_id").cast("string")))
    order = [F.desc("zones"), "group_id"] if mode == "argmax" else [F.desc("zones"), hashed, "group_id"]
    ranked = dense_index(groups.select("group_id", F.coalesce("zones", F.lit(0)).cast("long").alias("zones")), order, "_at")
    sizes = sorted(((r.zones, r.n) for r in ranked.groupBy("zones").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total = sum(n * count for n, count in sizes)
    goal = [total * targets[k] / sum(targets.values()) for k in names]
    plan, first, at = _plan(sizes, goal, mode, seed), {}, 0
    for n, count in sizes:
        first[n], at = at, at + count
    shared = groups.sparkSession.sparkContext.broadcast((plan, first))

    def deal(frames):
        known, starts = shared.value
        for frame in frames:
            zones, out = frame["zones"].to_numpy(), np.zeros(len(frame), np.int64)
            for n in np.unique(zones).tolist():
                own = np.flatnonzero(zones == n)
                rank = frame["_at"].to_numpy()[own] - starts[n]
                have, given = known[n]
                if n <= 0:
                    out[own] = int(np.argmax([g - h for g, h in zip(goal, have, strict=True)]))
                elif given is None:
                    out[own] = _dealt(goal, have, n, rank)
                else:
                    out[own] = np.searchsorted(np.cumsum(given.ravel()), rank, side="right") % len(names)
            yield pd.DataFrame({"group_id": frame["group_id"], "split": [names[k] for k in out.tolist()]})

    return ranked.mapInPandas(deal, f"group_id {dict(groups.dtypes)['group_id']}, split string")


def split_summary(splits: DataFrame, counts: DataFrame, targets: dict[str, float]) -> DataFrame:
    """(split, structures, zones, struct_fraction, zone_fraction, target); a split that got nothing has 0."""
    spark = splits.sparkSession
    whole = sum(targets.values())
    goal = spark.createDataFrame([(k, v / whole) for k, v in targets.items()], "split string, target double")
    got = splits.join(counts, "pdb_id", "left").groupBy("split").agg(F.count(F.lit(1)).alias("structures"), F.sum("zones").alias("zones"))
    both = goal.join(got, "split", "left").select("split", F.coalesce("structures", F.lit(0)).alias("structures"), F.coalesce("zones", F.lit(0)).alias("zones"), "target")
    over = Window.partitionBy()
    return both.withColumn("struct_fraction", F.col("structures") / F.sum("structures").over(over)).withColumn("zone_fraction", F.col("zones") / F.sum("zones").over(over))


def select_split(zone: DataFrame, assembly: DataFrame, structure: DataFrame, split: str) -> DataFrame:
    own = structure.where(F.col("split") == split).select("struct_id")
    return zone.join(assembly.join(own, "struct_id").select("assembly_id"), "assembly_id").select("zone_id")


def zone_provenance(zone: DataFrame, assembly: DataFrame, structure: DataFrame) -> DataFrame:
    a = assembly.select("assembly_id", "struct_id", F.col("pdb_id").alias("assembly_pdb_id"))
    return zone.select("zone_id", "assembly_id").join(a, "assembly_id").join(structure.select("struct_id", "pdb_id", "model_id"), "struct_id").select("zone_id", "pdb_id", "model_id", "assembly_pdb_id")


def zone_lookup(zone_ids: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """For a set of zones: centre, and arrays of subchains, pairs and neighbours."""
    out = tables["zone"].join(zone_ids, "zone_id", "left_semi")
    parts = {"subchains": ("subchain", ["subchain_id", "symmetry_mate"]), "pairs": ("subchain_pair", ["subchain_id_1", "symmetry_mate_1", "subchain_id_2", "symmetry_mate_2"]), "neighbors": ("zone_neighbor", ["neighbor_id"])}
    for name, (table, cols) in parts.items():
        own = tables[table].join(zone_ids, "zone_id", "left_semi")
        item = F.struct(*cols) if len(cols) > 1 else F.col(cols[0])
        out = out.join(own.groupBy("zone_id").agg(F.sort_array(F.collect_list(item)).alias(name)), "zone_id", "left")
    return out


def curriculum_filter(zones: DataFrame, easy: DataFrame) -> DataFrame:
    return zones.join(easy.select("zone_id"), "zone_id", "left_semi")


def curriculum_easy(curriculum: DataFrame, max_difficulty: float) -> DataFrame:
    """Zones of a mean difficulty strictly below the limit; zones without scores are out."""
    return curriculum.groupBy("zone_id").agg(F.avg("difficulty").alias("difficulty")).where(F.col("difficulty") < max_difficulty)


def curriculum_next_seed(curriculum: DataFrame) -> DataFrame:
    return curriculum.agg((F.coalesce(F.max("random_seed"), F.lit(0)) + 1).alias("next_seed"))


def pending_structures(structure: DataFrame, responses: DataFrame) -> DataFrame:
    return structure.select("pdb_id").join(responses.select("pdb_id"), "pdb_id", "left_anti")


def annotation_join(header: DataFrame, payload: DataFrame) -> DataFrame:
    return header.join(payload, "pdb_id")

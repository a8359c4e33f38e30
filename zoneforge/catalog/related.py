"""Novelty, groups, splits, curricula, provenance, metrics, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from zoneforge import fixtures as fx
from zoneforge.catalog import query
from zoneforge.fixtures import table, with_sql
from zoneforge.functions.storage import materialize, new_path
from zoneforge.operators import sampling, splits
from zoneforge.plans import jobs
from zoneforge.sources.readers import parse_annotation_responses
from zoneforge.streaming import jobs as streams

TARGETS = {"train": 8.0, "val": 1.0, "test": 1.0}


@query(with_sql("fx_candidates") + ", f AS (SELECT key, min(assembly_rank) AS r FROM fx_candidates GROUP BY 1) SELECT DISTINCT assembly_rank, zone FROM fx_candidates JOIN f USING (key) WHERE assembly_rank = r")
def select_novel_zones(spark, sf):
    return splits.select_novel_zones(fx.candidates(spark, sf))


@query(with_sql("fx_zone", "fx_assembly", "fx_structure") + " SELECT s.pdb_id, count(*) AS zones FROM fx_zone z JOIN fx_assembly a ON a.assembly_id = z.assembly_id JOIN fx_structure s ON s.struct_id = a.struct_id GROUP BY 1")
def structure_zone_counts(spark, sf):
    return splits.structure_zone_counts(fx.zone(spark, sf), fx.assembly(spark, sf), fx.structure(spark, sf))


GROUPS = """, e AS (SELECT DISTINCT a.pdb_id AS a, b.pdb_id AS b FROM fx_clusters a JOIN fx_clusters b ON a.cluster = b.cluster),
reach AS (SELECT pdb_id AS a, pdb_id AS b FROM fx_struct_zones UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
grp AS (SELECT a AS pdb_id, min(b) AS group_id FROM reach GROUP BY 1), gs AS (SELECT group_id, CAST(sum(zones) AS BIGINT) AS zones FROM grp JOIN fx_struct_zones USING (pdb_id) GROUP BY 1)"""
_BASE = with_sql("fx_clusters", "fx_struct_zones")


def _groups(spark, sf):
    return splits.connected_groups(fx.struct_zones(spark, sf).select("pdb_id"), fx.cluster_rows(spark, sf))


@query(_BASE + GROUPS + " SELECT pdb_id, group_id FROM grp")
def connected_groups(spark, sf):
    return _groups(spark, sf)


@query(_BASE + GROUPS + " SELECT group_id, zones FROM gs")
def group_sizes(spark, sf):
    return splits.group_sizes(_groups(spark, sf), fx.struct_zones(spark, sf))


#: The fold in SQL: a row a size with what splits have after it. Of a size's groups the r-th goes to the split that has the r-th greatest room.
_ROOMS = "SELECT {own}, k, row_number() OVER (PARTITION BY s.zones ORDER BY CASE k WHEN 0 THEN g0 - (h0 + s.zones * j) WHEN 1 THEN g1 - (h1 + s.zones * j) ELSE g2 - (h2 + s.zones * j) END DESC, k) AS rn FROM st JOIN sz s ON s.step = st.step + 1, tot, (VALUES (0), (1), (2)) v(k), range(s.c) r(j)"
FOLD = f""", tot AS (SELECT sum(zones) * 0.8 AS g0, sum(zones) * 0.1 AS g1, sum(zones) * 0.1 AS g2 FROM gs), sz AS (SELECT zones, count(*) AS c, row_number() OVER (ORDER BY zones DESC) AS step FROM gs GROUP BY zones),
st AS (SELECT CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS h0, CAST(0 AS BIGINT) AS h1, CAST(0 AS BIGINT) AS h2 UNION ALL
 SELECT step, CAST(any_value(h0) + any_value(zones) * count(*) FILTER (k = 0) AS BIGINT), CAST(any_value(h1) + any_value(zones) * count(*) FILTER (k = 1) AS BIGINT), CAST(any_value(h2) + any_value(zones) * count(*) FILTER (k = 2) AS BIGINT)
 FROM ({_ROOMS.format(own="s.step, s.zones, s.c, h0, h1, h2")}) WHERE rn <= c GROUP BY step),
o AS (SELECT group_id, zones, row_number() OVER (PARTITION BY zones ORDER BY group_id) AS rn FROM gs),
alloc AS (SELECT group_id, CASE k WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM o JOIN ({_ROOMS.format(own="s.zones")}) USING (zones, rn)), given AS (SELECT pdb_id, split FROM grp JOIN alloc USING (group_id))"""
SUMMARY = """, got AS (SELECT split, count(*) AS structures, CAST(sum(zones) AS BIGINT) AS zones FROM given JOIN fx_struct_zones USING (pdb_id) GROUP BY 1)
SELECT t.split, coalesce(structures, 0) AS structures, coalesce(zones, 0) AS zones, target, round(coalesce(structures, 0) / sum(structures) OVER (), 6) AS struct_fraction, round(coalesce(zones, 0) / sum(zones) OVER (), 6) AS zone_fraction
FROM (VALUES ('train', CAST(0.8 AS DOUBLE)), ('val', CAST(0.1 AS DOUBLE)), ('test', CAST(0.1 AS DOUBLE))) t(split, target) LEFT JOIN got ON got.split = t.split"""


@query(_BASE + GROUPS + FOLD + " SELECT group_id, split FROM alloc")
def allocate_splits(spark, sf):
    sizes = materialize(splits.group_sizes(_groups(spark, sf), fx.struct_zones(spark, sf)), "sizes")
    return splits.allocate_splits(sizes, TARGETS, "argmax")


@query(_BASE + GROUPS + FOLD + SUMMARY)
def split_summary(spark, sf):
    counts = materialize(fx.struct_zones(spark, sf), "counts")
    _, summary = jobs.assign_splits(counts, fx.cluster_rows(spark, sf), TARGETS, "argmax")
    return summary.withColumns({c: F.round(c, 6) for c in ("struct_fraction", "zone_fraction")})


@query(_BASE + GROUPS + FOLD + " SELECT pdb_id, split FROM given")
def make_splits(spark, sf):
    counts = fx.struct_zones(spark, sf)
    structure = counts.select(F.col("pdb_id").alias("struct_id"), "pdb_id")
    zone = table(spark, sf, "lineitem").where("l_orderkey is not null").selectExpr("monotonically_increasing_id() AS zone_id", "l_orderkey AS assembly_id")
    assembly = structure.selectExpr("pdb_id AS assembly_id", "struct_id", "pdb_id")
    return jobs.make_splits({"zone": zone, "assembly": assembly, "structure": structure}, fx.cluster_rows(spark, sf), TARGETS, "argmax")[0].select("pdb_id", "split")


_STORE = with_sql("fx_zone", "fx_assembly", "fx_structure")


@query(_STORE + " SELECT zone_id FROM fx_zone z JOIN fx_assembly a ON a.assembly_id = z.assembly_id JOIN fx_structure s ON s.struct_id = a.struct_id WHERE split = 'val'")
def select_split(spark, sf):
    return splits.select_split(fx.zone(spark, sf), fx.assembly(spark, sf), fx.structure(spark, sf), "val")


@query(_STORE + " SELECT zone_id, s.pdb_id, model_id, a.pdb_id AS assembly_pdb_id FROM fx_zone z JOIN fx_assembly a ON a.assembly_id = z.assembly_id JOIN fx_structure s ON s.struct_id = a.struct_id")
def zone_provenance(spark, sf):
    return splits.zone_provenance(fx.zone(spark, sf), fx.assembly(spark, sf), fx.structure(spark, sf))


@query("""WITH z AS (SELECT DISTINCT l_orderkey AS zone_id FROM lineitem WHERE l_orderkey % 50 = 0), s AS (SELECT l_orderkey AS zone_id, list(l_linenumber ORDER BY l_linenumber) AS neighbors FROM lineitem WHERE l_suppkey > 10 GROUP BY 1)
SELECT zone_id, list_distinct(neighbors) IS NOT NULL AS has, len(neighbors) AS n FROM z LEFT JOIN s USING (zone_id)""")
def zone_lookup(spark, sf):
    lines = table(spark, sf, "lineitem")
    zone = lines.selectExpr("l_orderkey AS zone_id").distinct()
    near = lines.where("l_suppkey > 10").selectExpr("l_orderkey AS zone_id", "l_linenumber AS neighbor_id")
    sub = lines.selectExpr("l_orderkey AS zone_id", "cast(l_partkey as string) AS subchain_id", "l_linenumber AS symmetry_mate")
    pair = sub.selectExpr("zone_id", "subchain_id AS subchain_id_1", "symmetry_mate AS symmetry_mate_1", "subchain_id AS subchain_id_2", "symmetry_mate + 1 AS symmetry_mate_2")
    found = splits.zone_lookup(zone.where("zone_id % 50 = 0"), {"zone": zone, "subchain": sub, "subchain_pair": pair, "zone_neighbor": near})
    return found.select("zone_id", F.col("neighbors").isNotNull().alias("has"), F.when(F.col("neighbors").isNotNull(), F.size("neighbors")).cast("long").alias("n"))


_EASY = ", easy AS (SELECT zone_id, avg(difficulty) AS d FROM fx_curriculum GROUP BY 1 HAVING avg(difficulty) < 0.1)"


@query(with_sql("fx_curriculum") + _EASY + " SELECT zone_id, round(d, 6) AS difficulty FROM easy")
def curriculum_easy(spark, sf):
    return splits.curriculum_easy(fx.curriculum(spark, sf), 0.1).withColumn("difficulty", F.round("difficulty", 6))


@query(with_sql("fx_curriculum") + _EASY + " SELECT c_custkey AS zone_id FROM customer WHERE c_custkey IN (SELECT zone_id FROM easy)")
def curriculum_filter(spark, sf):
    zones = table(spark, sf, "customer").select(F.col("c_custkey").alias("zone_id"))
    return splits.curriculum_filter(zones, splits.curriculum_easy(fx.curriculum(spark, sf), 0.1))


@query(with_sql("fx_curriculum") + " SELECT coalesce(max(random_seed), 0) + 1 AS next_seed FROM fx_curriculum")
def curriculum_next_seed(spark, sf):
    return splits.curriculum_next_seed(fx.curriculum(spark, sf))


@query("SELECT p_partkey AS pdb_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def pending_structures(spark, sf):
    return splits.pending_structures(table(spark, sf, "part").select(F.col("p_partkey").alias("pdb_id")), table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("pdb_id")))


@query("SELECT o_orderkey AS pdb_id, o_orderstatus AS status, l_partkey AS entry FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def annotation_join(spark, sf):
    header = table(spark, sf, "orders").selectExpr("o_orderkey AS pdb_id", "o_orderstatus AS status")
    return splits.annotation_join(header, table(spark, sf, "lineitem").selectExpr("l_orderkey AS pdb_id", "l_partkey AS entry"))


_STATUS = "CASE WHEN http_status = 404 THEN 'error: not found' WHEN payload = 'oops' THEN 'error: malformed payload' ELSE 'ok' END"


@query(with_sql("fx_responses") + f" SELECT {_STATUS} AS status, count(*) AS total, count(*) FILTER (pdb_id % 3 = 0) AS fresh FROM fx_responses GROUP BY 1")
def status_summary(spark, sf):
    headers = parse_annotation_responses(fx.responses(spark, sf)).select("pdb_id", "status").distinct()
    return sampling.status_summary(headers, headers.where("pdb_id % 3 = 0"))


_SOFT = "list_sum(list_transform(logits, lambda v: exp(CAST(v AS DOUBLE) - list_max(logits))))"


@query(with_sql("fx_logits") + f", s AS (SELECT y, {_SOFT} AS t, list_max(logits) AS m, logits FROM fx_logits) SELECT y % 2 AS split, count(*) AS n, round(avg(m + ln(t) - CAST(logits[y + 1] AS DOUBLE)), 6) AS loss, round(avg(CAST(list_position(logits, m) - 1 = y AS DOUBLE)), 6) AS accuracy FROM s GROUP BY 1")
def classification_metrics(spark, sf):
    preds = fx.logits(spark, sf).withColumn("split", F.expr("y % 2"))
    return sampling.classification_metrics(preds, ["split"]).withColumns({c: F.round(c, 6) for c in ("loss", "accuracy")})


_ERROR = f"1 - exp(CAST(logits[y + 1] AS DOUBLE) - list_max(logits)) / {_SOFT}"


@query(with_sql("fx_logits") + f" SELECT i, round({_ERROR}, 6) AS difficulty FROM fx_logits")
def error_probability(spark, sf):
    return sampling.error_probability(fx.logits(spark, sf), "logits", "y").select("i", F.round("difficulty", 6).alias("difficulty"))


def _softmax_error(frames):
    import numpy as np

    for frame in frames:
        z = np.array(frame["logits"].tolist(), float)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        p = z[np.arange(len(z)), frame["y"].to_numpy()] / z.sum(axis=1) if len(z) else []
        yield frame.assign(difficulty=1 - p)[["i", "difficulty"]]


@query(with_sql("fx_logits") + f" SELECT i, round({_ERROR}, 6) AS difficulty FROM fx_logits")
def score_samples(spark, sf):
    return sampling.score_samples(fx.logits(spark, sf), _softmax_error, "i long, difficulty double").withColumn("difficulty", F.round("difficulty", 6))


@query(with_sql("fx_logits") + " SELECT i * 2 AS i, y FROM fx_logits WHERE y < 5")
def make_sample(spark, sf):
    return sampling.make_sample(fx.logits(spark, sf), lambda s: s.where("y < 5").select((F.col("i") * 2).alias("i"), "y"))


@query(with_sql("fx_responses") + """ SELECT CAST(pdb_id AS VARCHAR) AS pdb_id, CASE WHEN http_status = 404 THEN 'error: not found' WHEN payload = 'oops' THEN 'error: malformed payload' ELSE 'ok' END AS status,
 CASE WHEN http_status <> 404 AND payload <> 'oops' THEN TRY_CAST(payload AS JSON)->>'$.results[0].metadata.accession' END AS interpro_id FROM fx_responses""")
def stream_annotations(spark, sf):
    src, dst = new_path(spark, "responses"), new_path(spark, "annotations")
    rows = fx.responses(spark, sf)
    rows.where("pdb_id % 2 = 0").write.json(f"{src}/a")
    rows.write.json(f"{src}/b")
    return streams.stream_annotations(spark, f"{src}/*", dst).select("pdb_id", "status", "interpro_id")


@query(with_sql("fx_curriculum") + " SELECT zone_id, round(avg(difficulty), 6) AS difficulty, count(*) AS n FROM fx_curriculum GROUP BY 1")
def stream_curriculum(spark, sf):
    src = new_path(spark, "scores")
    fx.curriculum(spark, sf).repartition(3, "random_seed").write.parquet(src)
    return streams.stream_curriculum(spark, src).withColumn("difficulty", F.round("difficulty", 6))

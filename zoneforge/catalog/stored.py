"""Sources, sinks, metadata, maintenance, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from zoneforge import fixtures as fx
from zoneforge.catalog import query
from zoneforge.fixtures import table, with_sql
from zoneforge.functions import frames
from zoneforge.functions.storage import new_path
from zoneforge.operators import annotate, filters, tables
from zoneforge.sources import readers, store

_LINES = "SELECT concat(lpad(CAST(p_partkey%10000 AS VARCHAR),4,'0'), chr(CAST(65+p_partkey%26 AS INT)), lpad(CAST(p_size%100 AS VARCHAR),2,'0')) AS name, p_partkey, p_size, p_brand FROM part"
_NAME = "substr(name,1,4) AS pdb_id, substr(name,5,1) AS chain_id, CAST(substr(name,6,2) AS INT) AS domain_id"


def _named(spark, sf):
    return table(spark, sf, "part").selectExpr("concat(lpad(p_partkey % 10000, 4, '0'), char(cast(65 + p_partkey % 26 as int)), lpad(p_size % 100, 2, '0')) AS name", "p_partkey", "p_size", "p_brand")


def _text(spark, df, tag):
    path = new_path(spark, tag)
    df.write.text(path)
    return path


@query(with_sql("fx_atoms") + " SELECT concat('a', assembly_id) AS pdb_id, atom_id, subchain_id, entity_id, comp_id, seq_id, element, round(x,6) AS x, round(y,6) AS y, round(z,6) AS z, occupancy FROM fx_atoms")
def ingest_mmcif(spark, sf):
    fields = ["group_PDB", "id", "type_symbol", "label_atom_id", "label_comp_id", "label_asym_id", "label_entity_id", "label_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "auth_asym_id", "pdbx_PDB_model_num"]
    line = F.concat_ws(" ", F.lit("ATOM"), "atom_id", "element", F.lit("'C A'"), "comp_id", "subchain_id", "entity_id", "seq_id", *[F.round(c, 6) for c in "xyz"], "occupancy", "subchain_id", F.lit("1"))
    body = fx.atoms(spark, sf).select("assembly_id", line.alias("line")).groupBy("assembly_id").agg(F.concat_ws("\n", F.collect_list("line")).alias("lines"))
    head = "\nloop_\n" + "\n".join(f"_atom_site.{f}" for f in fields) + "\n"
    path = _text(spark, body.select(F.concat(F.lit("data_A"), F.col("assembly_id"), F.lit(head), "lines", F.lit("\n#\n"))), "cif")
    return readers.ingest_mmcif(spark, path)["asym_atoms"].select("pdb_id", "atom_id", "subchain_id", "entity_id", "comp_id", "seq_id", "element", "x", "y", "z", "occupancy")


@query(f"SELECT {_NAME}, CAST(substr(p_brand,7) AS INT) AS c, CAST(p_size%5 AS INT) AS a, CAST(p_size AS INT) AS t, CAST(p_partkey%7 AS INT) AS h FROM ({_LINES})")
def read_domain_list(spark, sf):
    lines = _named(spark, sf).selectExpr("concat_ws('   ', name, substr(p_brand, 7), p_size % 5, p_size, p_partkey % 7, '1 1.5') AS value")
    return readers.read_domain_list(spark, _text(spark, lines.unionByName(lines.limit(1).select(F.lit("# a comment").alias("value"))), "domains"))


@query(f"SELECT {_NAME}, list_concat(range(p_size, p_size+4), [p_size+9], range(p_size+10, p_size+13))::INT[] AS seq_ids FROM ({_LINES})")
def read_domain_ranges(spark, sf):
    lines = _named(spark, sf).selectExpr("concat(name, ' ', p_size, '-', p_size + 3, ',', p_size + 9, ',', p_size + 10, '-', p_size + 12) AS value")
    return readers.read_domain_ranges(spark, _text(spark, lines, "ranges"))


@query(with_sql("fx_clusters") + " SELECT CAST(pdb_id AS VARCHAR) AS pdb_id, CAST(cluster AS VARCHAR) AS cluster FROM fx_clusters")
def read_clusters(spark, sf):
    path = new_path(spark, "clusters")
    fx.clusters(spark, sf).write.option("header", False).csv(path)
    return readers.read_clusters(spark, path)


_PARSED = """, parsed AS (SELECT pdb_id, CASE WHEN http_status = 404 THEN 'error: not found' WHEN payload = 'oops' THEN 'error: malformed payload' ELSE 'ok' END AS status,
 CASE WHEN http_status = 404 OR payload = 'oops' THEN NULL ELSE payload->>'$.results[0].metadata.accession' END AS interpro_id,
 CASE WHEN http_status = 404 OR payload = 'oops' THEN NULL ELSE payload->>'$.results[0].metadata.type' END AS type FROM (SELECT pdb_id, http_status, CASE WHEN payload = 'oops' THEN payload ELSE payload END AS payload FROM fx_responses)) """
_PARSED = _PARSED.replace("payload->>'$", "TRY_CAST(payload AS JSON)->>'$")


@query(with_sql("fx_responses") + _PARSED + "SELECT * FROM parsed")
def parse_annotation_responses(spark, sf):
    return readers.parse_annotation_responses(fx.responses(spark, sf))


@query(with_sql("fx_responses") + _PARSED + "SELECT CAST(pdb_id AS VARCHAR) AS pdb_id, interpro_id AS cluster FROM parsed WHERE type IN ('domain','family')")
def write_clusters(spark, sf):
    path = new_path(spark, "clusters")
    readers.write_clusters(filters.filter_annotation_type(readers.parse_annotation_responses(fx.responses(spark, sf))), path)
    return readers.read_clusters(spark, path)


@query(with_sql("fx_responses") + _PARSED + "SELECT pdb_id, interpro_id FROM parsed WHERE type IN ('domain','family')")
def filter_annotation_type(spark, sf):
    return filters.filter_annotation_type(readers.parse_annotation_responses(fx.responses(spark, sf)))


@query(with_sql("fx_atoms") + " SELECT comp_id, count(*) AS n FROM fx_atoms WHERE comp_id IN ('ATP','GOL','PEG') GROUP BY comp_id")
def read_residue_list(spark, sf):
    atoms = fx.atoms(spark, sf)
    path = _text(spark, atoms.where(F.col("comp_id").isin("ATP", "GOL", "PEG")).select(F.concat(F.lit("  "), "comp_id").alias("value")).distinct(), "residues")
    return atoms.where(F.col("comp_id").isin(readers.read_residue_list(spark, path))).groupBy("comp_id").agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("fx_zone", "fx_assembly", "fx_structure") + " SELECT zone_id, z.assembly_id, s.pdb_id FROM fx_zone z JOIN fx_assembly a ON a.assembly_id = z.assembly_id JOIN fx_structure s ON s.struct_id = a.struct_id")
def write_dataset(spark, sf):
    path = new_path(spark, "store")
    all_tables = {"structure": fx.structure(spark, sf), "assembly": fx.assembly(spark, sf), "zone": fx.zone(spark, sf)}
    store.write_dataset({"structure": all_tables["structure"].where("struct_id % 2 = 0"), "zone": all_tables["zone"].where("zone_id % 3 = 0")}, path)
    store.write_dataset(all_tables, path)
    z, a, s = (store.read_table(spark, path, n) for n in ("zone", "assembly", "structure"))
    return z.join(a.select("assembly_id", "struct_id"), "assembly_id").join(s.select("struct_id", "pdb_id"), "struct_id").select("zone_id", "assembly_id", "pdb_id")


@query(with_sql("fx_atoms") + " SELECT assembly_id, count(*) AS n, min(atom_id) AS first_atom, round(sum(x*occupancy),6) AS weight FROM fx_atoms GROUP BY assembly_id")
def pack_atoms(spark, sf):
    packed = store.pack_atoms(fx.atoms(spark, sf))
    weight = F.aggregate("atoms", F.lit(0.0), lambda s, a: s + a["x"] * a["occupancy"])
    return packed.select("assembly_id", F.size("atoms").cast("long").alias("n"), F.col("atoms")[0]["atom_id"].alias("first_atom"), F.round(weight, 6).alias("weight"))


@query(with_sql("fx_atoms") + " SELECT * FROM fx_atoms")
def unpack_atoms(spark, sf):
    return store.unpack_atoms(store.pack_atoms(fx.atoms(spark, sf)))


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(repr(float(v)) if isinstance(v, float) else str(v) for v in r) + ")" for r in rows) + ")"


@query(with_sql("fx_atoms") + f" SELECT assembly_id, neighbor_id, round(avg(x) + dx, 6) AS x, round(avg(y) + dy, 6) AS y, round(avg(z) + dz, 6) AS z FROM fx_atoms, {_values([(i, *(15.0 * v for v in p)) for i, p in enumerate(frames.directions('cube'))])} d(neighbor_id, dx, dy, dz) GROUP BY assembly_id, neighbor_id, dx, dy, dz")
def load_direction_table(spark, sf):
    path = new_path(spark, "store")
    store.load_direction_table(spark, path, "cube", 15.0)
    dirs = store.load_direction_table(spark, path, "cube", 15.0)
    middle = fx.atoms(spark, sf).groupBy("assembly_id").agg(*[F.avg(c).alias(c) for c in "xyz"])
    return middle.crossJoin(F.broadcast(dirs)).select("assembly_id", "neighbor_id", *[F.round(F.col(c) + F.col(f"d{c}"), 6).alias(c) for c in "xyz"])


@query(with_sql("fx_curriculum") + " SELECT zone_id, random_seed, CASE WHEN random_seed%2=0 THEN difficulty ELSE difficulty + 1 END AS difficulty FROM fx_curriculum")
def append_scores(spark, sf):
    own = fx.curriculum(spark, sf)
    return store.append_scores(own.where("random_seed % 2 = 0"), own.withColumn("difficulty", F.col("difficulty") + 1))


def _print(t, cols) -> str:
    cells = ", ".join(f"coalesce(concat(length(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)), 'N')" for c in sorted(cols))
    return f"SELECT '{t}' AS \"table\", count(*) AS n, CAST(sum(CAST(concat('0x', substr(md5(concat({cells})), 1, 15)) AS HUGEINT)) % {1 << 60} AS BIGINT) AS fingerprint FROM {t}"


_PRINTED = {"nation": ["n_nationkey", "n_name", "n_regionkey"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], "part": ["p_partkey", "p_name", "p_brand", "p_size"]}


@query(" UNION ALL ".join(_print(t, c) for t, c in _PRINTED.items()))
def dataset_fingerprint(spark, sf):
    return store.dataset_fingerprint({t: table(spark, sf, t).select(*c) for t, c in _PRINTED.items()})


def _log(spark, sf):
    return fx.logits(spark, sf).selectExpr("i", "y AS y_true", "CASE WHEN i % 9 = 0 THEN 'skip' WHEN i % 3 = 0 THEN cast(y as string) ELSE '1' END AS y_guess", "cast(i % 4 as double) AS noise_distance", "cast(i % 2 * 10 as double) AS noise_angle")


_LOG = with_sql("fx_logits") + ", log AS (SELECT i, y AS y_true, CASE WHEN i%9=0 THEN 'skip' WHEN i%3=0 THEN CAST(y AS VARCHAR) ELSE '1' END AS y_guess, CAST(i%4 AS DOUBLE) AS noise_distance, CAST(i%2*10 AS DOUBLE) AS noise_angle FROM fx_logits) "


@query(_LOG + "SELECT max(i)+1 AS next_i FROM log")
def eval_log(spark, sf):
    path, log = new_path(spark, "log"), _log(spark, sf)
    store.eval_log_append(log.where("i % 2 = 0"), path)
    store.eval_log_append(log.where("i % 2 = 1"), path)
    return store.eval_log_next(store.eval_log_read(spark, path))


@query(_LOG + "SELECT noise_distance, noise_angle, count(*) AS n, round(avg(CAST(y_guess = CAST(y_true AS VARCHAR) AS DOUBLE)),6) AS accuracy, round(avg(CAST(y_guess='skip' AS DOUBLE)),6) AS skip_rate FROM log GROUP BY 1, 2")
def eval_log_summary(spark, sf):
    from zoneforge.operators.sampling import eval_log_summary as summary

    return summary(_log(spark, sf)).withColumns({c: F.round(c, 6) for c in ("accuracy", "skip_rate")})


_META = "WITH meta AS (SELECT c_name AS key, CAST(c_custkey AS VARCHAR) AS value, 'int' AS encoding FROM customer) "


def _meta(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_name AS key", "cast(c_custkey as string) AS value", "'int' AS encoding")


@query(_META + "SELECT key, value, encoding FROM meta")
def metadata_insert(spark, sf):
    m = _meta(spark, sf)
    return tables.metadata_insert(m.where("cast(value as long) % 3 <> 0"), m.where("cast(value as long) % 3 = 0"))


@query(_META + "SELECT key, CASE WHEN CAST(value AS BIGINT)%3=0 THEN 'new' ELSE value END AS value, CASE WHEN CAST(value AS BIGINT)%3=0 THEN 'str' ELSE encoding END AS encoding FROM meta")
def metadata_upsert(spark, sf):
    m = _meta(spark, sf)
    return tables.metadata_upsert(m, m.where("cast(value as long) % 3 = 0").selectExpr("key", "'new' AS value", "'str' AS encoding"))


_KEYS = [f"Customer#{k:09d}" for k in (1, 7, 50)]


@query(_META + f"SELECT key, value, encoding FROM meta WHERE key IN ({', '.join(repr(k) for k in _KEYS)})")
def metadata_select(spark, sf):
    return tables.metadata_select(_meta(spark, sf), _KEYS)


@query(_META + f"SELECT key, value, encoding FROM meta WHERE key <> '{_KEYS[0]}'")
def metadata_delete(spark, sf):
    return tables.metadata_delete(_meta(spark, sf), _KEYS[0])


@query("""SELECT p_name || p_partkey AS key, CASE WHEN p_partkey%7=0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS stored, CASE WHEN p_partkey%11=0 THEN NULL ELSE CAST(CASE WHEN p_partkey%5=0 THEN p_size+1 ELSE p_size END AS VARCHAR) END AS given,
CASE WHEN p_partkey%7=0 THEN 'missing in store' WHEN p_partkey%11=0 THEN 'missing in config' ELSE 'changed' END AS status FROM part WHERE NOT (p_partkey%7=0 AND p_partkey%11=0) AND (p_partkey%7=0 OR p_partkey%11=0 OR p_partkey%5=0)""")
def config_drift(spark, sf):
    p = table(spark, sf, "part").withColumn("key", F.concat("p_name", "p_partkey"))
    old = p.where("p_partkey % 7 <> 0").selectExpr("key", "cast(p_size as string) AS value")
    new = p.where("p_partkey % 11 <> 0").selectExpr("key", "cast(CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END as string) AS value")
    return tables.config_drift(old, new)


def _labels(n: int, name: str) -> str:
    return f"{name} AS (SELECT row_number() OVER (ORDER BY c, a) - 1 AS label, concat(c, '.', a) AS name FROM fx_domains GROUP BY c, a HAVING count(*) >= {n})"


@query(with_sql("fx_domains") + f", {_labels(15, 'o')}, {_labels(20, 'n')} SELECT CAST(coalesce(o.label, n.label) AS INT) AS label, o.name AS stored, n.name AS given FROM o FULL JOIN n ON o.label = n.label WHERE o.name IS DISTINCT FROM n.name")
def label_drift(spark, sf):
    d = fx.domains(spark, sf)
    stored, given = (annotate.frequent_classes(d, n).select("label", F.concat_ws(".", "c", "a").alias("name")) for n in (15, 20))
    return tables.label_drift(stored, given)


@query("SELECT c_custkey AS struct_id, concat('s', c_custkey) AS pdb_id, '1' AS model_id, concat('part', c_custkey%3) AS split FROM customer")
def update_splits(spark, sf):
    s = fx.structure(spark, sf)
    return tables.update_splits(s, s.select("pdb_id", F.concat(F.lit("part"), F.col("struct_id") % 3).alias("split"))).select("struct_id", "pdb_id", "model_id", "split")


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def check_unique(spark, sf):
    return tables.check_unique(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey%10<>0) GROUP BY 1")
def check_fk(spark, sf):
    return tables.check_fk(table(spark, sf, "lineitem"), "l_orderkey", table(spark, sf, "orders").where("o_orderkey % 10 <> 0"), "o_orderkey")


@query("SELECT o_orderkey, n FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1) WHERE n > 1 AND o_orderkey IN (SELECT o_orderkey FROM orders)")
def assert_no_fanout(spark, sf):
    return tables.assert_no_fanout(table(spark, sf, "orders"), table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"])


@query("SELECT DISTINCT p_partkey AS key FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def set_difference(spark, sf):
    return tables.set_difference(table(spark, sf, "part").select(F.col("p_partkey").alias("key")), table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("key")), ["key"])


@query("SELECT o_orderkey AS key, 'left' AS side FROM orders WHERE o_orderkey%6=0 AND o_orderkey%4<>0 UNION ALL SELECT o_orderkey, 'right' FROM orders WHERE o_orderkey%4=0 AND o_orderkey%6<>0")
def set_equality(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    return tables.set_equality(o.where("key % 6 = 0"), o.where("key % 4 = 0"), ["key"])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS index FROM orders")
def dense_index(spark, sf):
    return tables.dense_index(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "index")


@query("SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM orders GROUP BY 1")
def fraction_of_total(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return tables.fraction_of_total(counts, "n", "fraction").withColumn("fraction", F.round("fraction", 6))

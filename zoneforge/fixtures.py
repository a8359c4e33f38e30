"""Views of the driver's tables that stand for the engine's inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same views for DuckDB, as common table expressions.
SQL = {
    "fx_atoms": """SELECT CAST(label AS BIGINT) AS assembly_id, vec_id*21+k AS atom_id, chr(CAST(65+vec_id%4 AS INT)) AS subchain_id,
       CAST((vec_id%8 - vec_id%4)/4 AS INT) AS symmetry_mate, chr(CAST(65+vec_id%4 AS INT)) AS chain_id, CAST(vec_id%5+1 AS VARCHAR) AS entity_id,
       CASE vec_id%6 WHEN 0 THEN 'ALA' WHEN 1 THEN 'GLY' WHEN 2 THEN 'SER' WHEN 3 THEN 'ATP' WHEN 4 THEN 'GOL' ELSE 'PEG' END AS comp_id,
       CAST(vec_id%60+1 AS INT) AS seq_id,
       CASE WHEN k<13 THEN 'C' WHEN k<16 THEN 'N' WHEN k<19 THEN 'O' WHEN k=19 THEN 'S' WHEN label IN (3,7) THEN 'Se' ELSE 'P' END AS element,
       100*CAST(list_extract(embedding, CAST(3*k+1 AS INT)) AS DOUBLE) AS x, 100*CAST(list_extract(embedding, CAST(3*k+2 AS INT)) AS DOUBLE) AS y,
       100*CAST(list_extract(embedding, CAST(3*k+3 AS INT)) AS DOUBLE) AS z,
       CASE WHEN k%7=0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS occupancy, vec_id%5<>4 AS is_polymer FROM embeddings, range(21) t(k)""",
    "fx_clusters": "SELECT DISTINCT l_orderkey AS pdb_id, l_partkey*1000 + CAST(floor(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))/7) AS BIGINT) AS cluster FROM lineitem",
    "fx_struct_zones": "SELECT l_orderkey AS pdb_id, count(*) AS zones FROM lineitem GROUP BY l_orderkey",
    "fx_domains": "SELECT p_partkey AS pdb_id, CAST(substr(p_brand,7) AS INT) AS c, p_size%5 AS a, p_size AS t, CAST(p_partkey%7 AS INT) AS h FROM part",
    "fx_curriculum": "SELECT user_id AS zone_id, event_id AS random_seed, value/500 AS difficulty FROM events",
    "fx_candidates": "SELECT l_orderkey AS assembly_rank, l_linenumber AS zone, l_partkey AS key FROM lineitem",
    "fx_logits": "SELECT vec_id AS i, CAST(label AS INT) AS y, list_slice(embedding,1,10) AS logits FROM embeddings",
    "fx_zone": "SELECT DISTINCT l_orderkey*10+l_linenumber AS zone_id, l_orderkey AS assembly_id FROM lineitem",
    "fx_assembly": "SELECT o_orderkey AS assembly_id, o_custkey AS struct_id, concat('a', o_orderkey) AS pdb_id FROM orders",
    "fx_structure": "SELECT c_custkey AS struct_id, concat('s', c_custkey) AS pdb_id, '1' AS model_id, CASE c_custkey%4 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM customer",
    "fx_responses": """SELECT event_id AS pdb_id, CASE WHEN event_id%5=0 THEN 404 ELSE 200 END AS http_status,
       CASE WHEN event_id%5=1 THEN 'oops' ELSE concat('{"results":[{"metadata":{"accession":"IPR', CAST(user_id AS VARCHAR), '","type":"', CASE event_id%3 WHEN 0 THEN 'domain' WHEN 1 THEN 'family' ELSE 'site' END, '"}}]}') END AS payload FROM events""",
}


def with_sql(*names: str) -> str:
    """WITH clause of the views named, to be followed by more of them or by SELECT."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def atoms(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k"))
    v, k = F.col("vec_id"), F.col("k")
    chain = F.char((65 + v % 4).cast("int"))
    part = lambda i: F.lit(100) * F.element_at("embedding", (3 * k + i).cast("int")).cast("double")
    comp = F.element_at(F.array(*map(F.lit, ("ALA", "GLY", "SER", "ATP", "GOL", "PEG"))), (v % 6 + 1).cast("int"))
    element = F.when(k < 13, "C").when(k < 16, "N").when(k < 19, "O").when(k == 19, "S").when(F.col("label").isin(3, 7), "Se").otherwise("P")
    return e.select(
        F.col("label").cast("long").alias("assembly_id"), (v * 21 + k).alias("atom_id"), chain.alias("subchain_id"), ((v % 8 - v % 4) / 4).cast("int").alias("symmetry_mate"), chain.alias("chain_id"),
        (v % 5 + 1).cast("string").alias("entity_id"), comp.alias("comp_id"), (v % 60 + 1).cast("int").alias("seq_id"), element.alias("element"),
        part(1).alias("x"), part(2).alias("y"), part(3).alias("z"), F.when(k % 7 == 0, 0.5).otherwise(1.0).alias("occupancy"), (v % 5 != 4).alias("is_polymer"),
    )


def cluster_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Structures that share a part in a week, a row for each time they do: components stay small however many rows there are."""
    return table(spark, sf, "lineitem").selectExpr("l_orderkey AS pdb_id", "l_partkey * 1000 + floor(datediff(cast(l_shipdate as date), date'1992-01-01') / 7) AS cluster")


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    return cluster_rows(spark, sf).distinct()


def struct_zones(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("pdb_id")).agg(F.count(F.lit(1)).alias("zones"))


def domains(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("pdb_id"), F.expr("cast(substr(p_brand, 7) as int)").alias("c"), F.expr("p_size % 5").alias("a"), F.col("p_size").alias("t"), F.expr("cast(p_partkey % 7 as int)").alias("h"))


def curriculum(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr("user_id AS zone_id", "event_id AS random_seed", "value / 500 AS difficulty")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr("l_orderkey AS assembly_rank", "l_linenumber AS zone", "l_partkey AS key")


def logits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").cast("int").alias("y"), F.slice("embedding", 1, 10).alias("logits"))


def zone(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS zone_id", "l_orderkey AS assembly_id").distinct()


def assembly(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr("o_orderkey AS assembly_id", "o_custkey AS struct_id", "concat('a', o_orderkey) AS pdb_id")


def structure(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr("c_custkey AS struct_id", "concat('s', c_custkey) AS pdb_id", "'1' AS model_id", "CASE c_custkey % 4 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split")


def responses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id AS pdb_id", "CASE WHEN event_id % 5 = 0 THEN 404 ELSE 200 END AS http_status",
        """CASE WHEN event_id % 5 = 1 THEN 'oops' ELSE concat('{"results":[{"metadata":{"accession":"IPR', user_id, '","type":"', CASE event_id % 3 WHEN 0 THEN 'domain' WHEN 1 THEN 'family' ELSE 'site' END, '"}}]}') END AS payload""",
    )

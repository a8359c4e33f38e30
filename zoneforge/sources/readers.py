"""Text sources: domain tables, clusters, annotations, residue lists, mmCIF."""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from zoneforge import schemas
from zoneforge.functions.storage import materialize


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    return lines.where((F.col("line") != "") & ~F.col("line").startswith("#"))


def _name_parts(name):
    return [F.substring(name, 1, 4).alias("pdb_id"), F.substring(name, 5, 1).alias("chain_id"), F.substring(name, 6, 2).cast("int").alias("domain_id")]


def _checked(df: DataFrame, ok, message: str) -> DataFrame:
    """Fails the job on the first row that isn't ``ok``; costs no pass of its own."""
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def read_domain_list(spark: SparkSession, path: str) -> DataFrame:
    """Domain classes: white-space fields, of which the name (pdb 4, chain 1, domain 2) and four class numbers are read. The path may be a glob."""
    rows = _lines(spark, path).select(F.split("line", r"\s+").alias("f"))
    rows = _checked(rows, F.length(F.col("f")[0]) == 7, "a domain's name has 7 characters")
    return rows.select(*_name_parts(F.col("f")[0]), *[F.col("f")[i].cast("int").alias(c) for i, c in enumerate("cath", 1)])


def parse_ranges(ranges):
    """'2-4,8-10' as the numbers it holds; a lone number is itself."""
    parts = F.split(ranges, ",")
    bound = lambda p, k: F.regexp_extract(p, r"^\s*(-?\d+)(?:-(-?\d+))?\s*$", k)
    high = lambda p: F.when(bound(p, 2) == "", bound(p, 1)).otherwise(bound(p, 2))
    return F.flatten(F.transform(parts, lambda p: F.sequence(bound(p, 1).cast("int"), high(p).cast("int"))))


def read_domain_ranges(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path).select(F.split("line", r"\s+", 2).alias("f"))
    rows = _checked(rows, F.length(F.col("f")[0]) == 7, "a domain's name has 7 characters")
    return rows.select(*_name_parts(F.col("f")[0]), parse_ranges(F.col("f")[1]).alias("seq_ids"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CLUSTERS).option("header", False).csv(path)


def write_clusters(df: DataFrame, path: str) -> None:
    df.select("pdb_id", "interpro_id").write.option("header", False).csv(path)


def read_residue_list(spark: SparkSession, path: str) -> list[str]:
    """One residue a line, at most 5 characters; '-' alone means none. All of the list: names of 5 characters are a setting, not data."""
    rows = [r.line for r in _lines(spark, path).collect()]
    if rows == ["-"]:
        return []
    if bad := [r for r in rows if len(r) > 5]:
        raise ValueError(f"not a residue name: {bad[0]}")
    return rows


_PAYLOAD = "results array<struct<metadata:struct<accession:string,type:string>>>"


def parse_annotation_responses(df: DataFrame) -> DataFrame:
    """(pdb_id, status, interpro_id, type) from (pdb_id, http_status, payload): a row for each entry, or one with nulls."""
    parsed = df.withColumn("p", F.from_json("payload", _PAYLOAD))
    status = F.when(F.col("http_status").isin(204, 404), "error: not found").when(F.col("p.results").isNull(), "error: malformed payload").otherwise("ok")
    rows = parsed.withColumn("status", status).withColumn("e", F.explode_outer(F.when(F.col("status") == "ok", F.col("p.results"))))
    return rows.select("pdb_id", "status", F.col("e.metadata.accession").alias("interpro_id"), F.col("e.metadata.type").alias("type"))


_TOKEN = re.compile(r"""'(?:[^'\n]|'(?=\S))*'(?=\s|$)|"(?:[^"\n]|"(?=\S))*"(?=\s|$)|\S+""")


def cif_tokens(lines: Iterable[str]) -> Iterator[tuple[str, bool]]:
    """(token, quoted) of an mmCIF file's lines, as they come; semicolon fields are one token, comments none."""
    field: list[str] | None = None
    for line in lines:
        line = line.rstrip("\r\n")
        if field is not None:
            if line.startswith(";"):
                yield "\n".join(field), True
                field = None
            else:
                field.append(line)
        elif line.startswith(";"):
            field = [line[1:]]
        else:
            for m in _TOKEN.finditer(line):
                token = m[0]
                if token.startswith("#"):
                    break
                quoted = token[0] in "'\"" and len(token) > 1 and token[-1] == token[0]
                yield (token[1:-1], True) if quoted else (token, False)


def cif_records(lines: Iterable[str]) -> Iterator[tuple[str, str, dict[str, str | None]]]:
    """(block, category, row) of a CIF file; '.' and '?' are missing.

    Rows of a loop come as they are read, so no more than one is held; categories without a loop are small, and come at the end of their block.
    """
    block, single, fields, category, values = "", {}, None, "", []
    name: str | None = None
    naming = False
    for token, quoted in cif_tokens(lines):
        plain = not quoted
        if plain and naming and token.startswith("_"):
            category, _, field = token.partition(".")
            fields.append(field or category)
            continue
        naming = False
        if plain and token.lower() == "loop_":
            fields, values, naming, name = [], [], True, None
        elif plain and token.lower().startswith("data_"):
            yield from ((block, c, row) for c, row in single.items())
            block, single, fields, name = token[5:], {}, None, None
        elif plain and token.startswith("_"):
            fields, name = None, token
        else:
            value = None if plain and token in (".", "?") else token
            if fields:
                values.append(value)
                if len(values) == len(fields):
                    yield block, category, dict(zip(fields, values, strict=True))
                    values = []
            elif name is not None:
                own, _, field = name.partition(".")
                single.setdefault(own, {})[field] = value
                name = None
    yield from ((block, c, row) for c, row in single.items())


def cif_tables(text: str) -> dict[str, list[dict[str, str]]]:
    """Categories of a small CIF text as lists of rows."""
    out: dict[str, list[dict[str, str]]] = {}
    for _, category, row in cif_records(text.splitlines()):
        out.setdefault(category, []).append(row)
    return out


_CIF = {
    "asym_atoms": "pdb_id string, model_id string, atom_id long, subchain_id string, chain_id string, entity_id string, comp_id string, seq_id int, atom_name string, element string, x double, y double, z double, occupancy double",
    "entities": "pdb_id string, id string, type string",
    "polymers": "pdb_id string, entity_id string, type string",
    "assembly_gen": "pdb_id string, assembly string, subchain_id string, oper_id string",
    "oper_map": "pdb_id string, oper_id string, " + ", ".join(f"r{i}{j} double" for i in (1, 2, 3) for j in (1, 2, 3)) + ", t1 double, t2 double, t3 double",
}


def _operators(expression: str) -> list[str]:
    """'1,2', '1-3' and '(1-2)' as operator ids."""
    out = []
    for part in (expression or "").replace("(", "").replace(")", "").split(","):
        low, dash, high = part.strip().partition("-")
        out += [str(k) for k in range(int(low), int(high) + 1)] if dash and low.isdigit() and high.isdigit() else [part.strip()] * bool(part.strip())
    return out


def _number(kind, v, default=None):
    return default if v is None else kind(v)


def cif_rows(lines: Iterable[str]) -> Iterator[tuple[str, tuple]]:
    """(table, row) of the tables of ``_CIF``, as a file's lines come. Rows before the first block belong to none and are left out."""
    last, atoms = None, 0
    for block, category, r in cif_records(lines):
        if block != last:
            last, atoms = block, 0
        if not block:
            continue
        pdb_id, get = block.lower(), r.get
        if category == "_atom_site":
            atoms += 1
            yield "asym_atoms", (
                pdb_id, get("pdbx_PDB_model_num") or "1", _number(int, get("id"), atoms), get("label_asym_id"), get("auth_asym_id") or get("label_asym_id"), get("label_entity_id"), get("label_comp_id"),
                _number(int, get("label_seq_id")), get("label_atom_id"), get("type_symbol"), *(_number(float, get(f"Cartn_{c}")) for c in "xyz"), _number(float, get("occupancy"), 1.0),
            )
        elif category == "_entity":
            yield "entities", (pdb_id, get("id"), get("type"))
        elif category == "_entity_poly":
            yield "polymers", (pdb_id, get("entity_id"), get("type"))
        elif category == "_pdbx_struct_assembly_gen":
            for chain in (get("asym_id_list") or "").split(","):
                yield from (("assembly_gen", (pdb_id, get("assembly_id"), chain.strip(), o)) for o in _operators(get("oper_expression") or ""))
        elif category == "_pdbx_struct_oper_list":
            yield "oper_map", (pdb_id, get("id"), *(float(get(f"matrix[{i}][{j}]") or 0) for i in (1, 2, 3) for j in (1, 2, 3)), *(float(get(f"vector[{i}]") or 0) for i in (1, 2, 3)))


def cif_lines(data: bytes) -> Iterator[str]:
    """Lines of a file's bytes, plain or gzipped, decoded as they are asked for."""
    raw = io.BytesIO(data)
    return io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw, "utf-8", "replace")


def ingest_mmcif(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a folder (or glob) of mmCIF files, plain or gzipped: asym_atoms, entities, polymers, assembly_gen, oper_map.

    Each data block is a structure of its name. A file is one row of bytes (compressed, if it is) and is read once, line by
    line: rows leave as batches of 10 000, so what a task holds is the file's bytes and a batch. They go into one table with a struct for each kind of row, which is
    written; the five tables are scans of its columns.
    """
    parts = {name: [c.split(" ")[0] for c in schema.split(", ")] for name, schema in _CIF.items()}
    schema = ", ".join(f"{name} struct<{', '.join(':'.join(c.split(' ')) for c in columns.split(', '))}>" for name, columns in _CIF.items())

    kind = to_arrow_schema(_parse_datatype_string(schema))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = cif_rows(cif_lines(data.as_py()))
                while some := [{name: dict(zip(parts[name], r, strict=True))} for name, r in islice(rows, 10_000)]:
                    yield pa.RecordBatch.from_pylist(some, kind)

    parsed = materialize(spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, schema), "mmcif")
    return {name: parsed.where(F.col(name).isNotNull()).select(f"{name}.*") for name in _CIF}

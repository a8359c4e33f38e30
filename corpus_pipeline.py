"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneforge.functions.storage import materialize
from zoneforge.llm import exact_dedup, mixing, near_copies, packing, simhash, toxicity
from zoneforge.llm.common import read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; scored and filtered in one pass. A null or
    empty text scores the share of toxic labels; repeated rows are judged each; of an empty table nothing is left."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    column = next(c for c in (f"_score{k}" for k in range(len(docs.columns) + 1)) if c not in docs.columns)
    return toxicity.scored(docs, model, column).where(F.col(column) < 0.5).drop(column)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the least doc_id stays, null and empty texts are equal. Rows that repeat a doc_id stay
    or go together; rows of a null doc_id stay."""
    gone = exact_dedup.dedup(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the least doc_id stays, and of those that stay,
    the least of each component of texts whose five-word shingles are similar by 0.8 or more. Texts without a word have one
    fingerprint. Rows that repeat a doc_id stay or go together; rows of a null doc_id stay."""
    gone = simhash.near_dedup(docs).where("doc_id <> component_id").select("doc_id")
    docs = materialize(docs.join(gone, "doc_id", "left_anti").select(docs.columns), "linked_once")
    return docs.join(near_copies.near_copies(docs), "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, as its text; documents of which it takes nothing, such as null and empty ones, go,
    and of rows that repeat a doc_id (null is one) all but one."""
    return mixing.mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens; each of repeated rows is packed."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A learned score, XXH64 and a tokenizer are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

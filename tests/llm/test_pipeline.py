"""Every stage of the corpus pipeline against brute force on a small corpus, with odd rows and columns of clashing names."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm_operators import WORD, block_joins, brute_simhash, norm, water
from tokenizers import Tokenizer

import corpus_pipeline
from zoneforge.llm import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "toxic_score", "score", "keep_id", "fp", "pieces_taken", "size"]
FILLER = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(600)]


def corpus():
    rng = np.random.default_rng(11)
    base = " ".join(rng.choice(FILLER, 120))
    texts = [None, "", " \n", "one", base, base.replace(" ", "\n"), base + " more", " ".join(base.split()[:60] + ["changed"] + base.split()[61:]), "x" * 3000, " ".join(rng.choice(FILLER, 9000))]
    texts += [" ".join([*rng.choice(FILLER, 40), *(["vile"] if i % 5 == 0 else [])]) for i in range(400)]
    return {i: t for i, t in enumerate(texts)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = f"file://{tmp_path_factory.mktemp('corpus')}"
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), "a", 1.0, 2, 3, "p", None) for i, t in corpus().items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxic_score string, score double, keep_id long, fp long, pieces_taken string, size long")
    docs.repartition(3).write.parquet(f"{out}/documents.parquet")
    marks = [(i, 1, int("vile" in (t or ""))) for i, t in corpus().items() if i % 2]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    body, found = corpus(), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == COLUMNS and out.dtypes == docs.dtypes
            docs = corpus_pipeline.materialize(out, "stage")
            found[name] = {r.doc_id: r for r in docs.collect()}
            assert all(r.toxic_score == "a" and r.pieces_taken == "p" and r.size is None for r in found[name].values())
    scores = {r.doc_id: r.score for r in toxicity.score_documents(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    kept = {i: t for i, t in body.items() if scores[i] < 0.5}
    assert {i: r.text for i, r in found["toxicity"].items()} == kept
    assert sum("vile" in (t or "") for t in kept.values()) <= 4 and all(i in kept for i, t in body.items() if "vile" not in (t or ""))
    first = {}
    for i, t in sorted(kept.items()):
        first.setdefault(norm(t), i)
    assert {i: r.text for i, r in found["exact_dedup"].items()} == {i: kept[i] for i in first.values()}
    left = {i: kept[i] for i in sorted(first.values())}
    prints = {i: brute_simhash(t) for i, t in left.items()}
    sets = {i: {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if (ws := WORD.findall((t or "").lower())) else set() for i, t in left.items()}
    bits = lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2
    alike = lambda a, b: bool(sets[a]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])

    def least(ids, linked):
        root = {i: i for i in ids}
        pairs = [(a, b) for a in ids for b in ids if a < b and linked(a, b)]
        for _ in range(8):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return [i for i in ids if root[i] == i]

    want = least(least(list(left), bits), alike)
    near = found["simhash_near_dedup"]
    assert sorted(near) == want and all(near[i].text == left[i] for i in want) and len(want) < len(left)
    size, total, taken = {i: len(WORD.findall(left[i] or "")) for i in want}, defaultdict(int), defaultdict(int)
    for i in want:
        total[near[i].source] += size[i]
    mixed = found["mixing"]
    for i, r in mixed.items():
        n = len(WORD.findall(r.text))
        taken[near[i].source] += n
        assert 0 < n <= 3 * size[i] and set(WORD.findall(r.text)) <= set(WORD.findall(left[i])) and r.n_chars == len(r.text)
        if n == size[i] and r.text != left[i]:
            assert sorted(WORD.findall(r.text)) != []
    for source, target in water(total).items():
        assert abs(taken[source] - target) <= 1
    rows, fresh = out.collect(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(mixed)
    for i, own in pieces.items():
        ids, at = np.array([*fresh.encode(mixed[i].text, add_special_tokens=False).ids, 0], "<u4"), 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_is_its_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert k + 1 == len(corpus_pipeline.STAGES) or out.columns == docs.columns, name
        out.write.parquet(f"{folder}/by-hand-{k}")
        docs = spark.read.parquet(f"{folder}/by-hand-{k}")
    rows = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert rows(got) == rows(docs) and got.select("sequence_id").distinct().count() == docs.select("sequence_id").distinct().count()
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(got.columns)
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0 < got.count()


def test_mixing_broadcasts_no_blocks(spark, folder):
    assert block_joins(corpus_pipeline.mix_sources(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)) == ["SortMergeJoin"]


def test_stages_of_empty_and_repeated_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    none, some = docs.where("false"), docs.where("doc_id in (4, 5, 20)")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name
        own = stage(spark, some.unionByName(some.where("doc_id = 4")).withColumn("doc_id", F.when(F.col("doc_id") != 20, F.col("doc_id"))), folder)
        rows = own.collect()
        ids = {r.doc_id for r in rows}
        if name in ("toxicity", "exact_dedup", "simhash_near_dedup"):
            had = Counter((None if r.doc_id == 20 else r.doc_id, r.text) for r in [*some.collect(), *some.where("doc_id = 4").collect()])
            assert own.columns == docs.columns and Counter((r.doc_id, r.text) for r in rows) <= had, name
            assert name != "exact_dedup" or [r.doc_id for r in rows].count(None) == 1
        assert ids <= {4, 5, None} and (name == "exact_dedup" or 4 in ids or name == "simhash_near_dedup") and re.fullmatch("[a-z_]+", name)

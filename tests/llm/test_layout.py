"""What must hang on the rows alone, and what must come to an end."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from zoneforge.llm import bags, surrogates, toxicity


@pytest.fixture(scope="module")
def tables(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    some = docs.where("doc_id < 60")
    return docs.unionByName(some).unionByName(some.limit(20)).unionByName(some.limit(3).withColumn("doc_id", F.lit(None).cast("long"))), labels


def test_scores_hang_on_rows_alone(spark, tables):
    docs, labels = tables
    found = []
    for n in (1, 4, 16):
        dealt = docs.repartition(n, F.rand(n)) if n > 1 else docs.coalesce(1)
        found.append(sorted((str(r.doc_id), r.score, r.predicted) for r in toxicity.score_documents(dealt, labels).collect()))
    for other in found[1:]:
        assert [(i, p) for i, _, p in other] == [(i, p) for i, _, p in found[0]]
        assert np.allclose([s for _, s, _ in other], [s for _, s, _ in found[0]], rtol=0, atol=1e-9)


def test_of_texts_much_alike_one_counts(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    texts = [base] * 5 + ["one two three four", "one two three four", "other words here", None, ""]
    rows = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)] + [(5, "one two three four")] * 2, "doc_id long, text string")
    counts = [bags.frequencies(rows.repartition(n)) for n in (1, 3)]
    assert (counts[0][0] == counts[1][0]).all() and counts[0][1:] == counts[1][1:]
    total, docs, every = counts[0]
    assert every == 12 and docs == pytest.approx(3, abs=1e-4)
    doc, feature = bags.features(pa.array(["two", "here", "gamma"]))
    for k in range(3):
        assert total[feature[doc == k]] == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize("values", [[f"{a:x}::{b:x}" for a in range(16) for b in range(16)], [f"{a:x}::0" for a in range(16)]])
def test_short_addresses_settle(spark, values):
    entities = spark.createDataFrame([("ipv6", v) for v in sorted(set(values))], "kind string, value string").repartition(2)
    found = surrogates.assign(entities, b"key").collect()
    assert len({r.surrogate for r in found}) == len(found) == len(set(values))
    assert not {r.surrogate for r in found} & set(values)
    assert all(0 < len(g) <= 4 and set(g) <= set("0123456789abcdef") for r in found for g in r.surrogate.replace("::", ":").split(":")) and all(r.surrogate.replace("::", ":").count(":") < 8 for r in found)

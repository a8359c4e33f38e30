"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneforge.llm.bags import SIZE, Bag, averaged, bagged, counted, features, frequencies, fresh, lists, narrowed, sliced
from zoneforge.llm.common import configure, held_out, lean, materialize, restored, texts

#: Labelled toxic documents of the sample at most; rows of a slice of the unlabelled; least documents a feature is in.
POSITIVES, SLICE, LEAST_DOCS = 3000, 8000, 4
EPOCHS, RATE, DECAY, START = 80, 0.05, 1e-3, 0.3
#: Standard errors by which a feature's log ratio must differ from 0.
SIGNIFICANCE = 5.0


@dataclass(frozen=True)
class Model:
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, column: pa.Array) -> np.ndarray:
        doc, feature = features(column, self.weight != 0)
        return _sigmoid(np.bincount(doc, self.weight[feature], len(column)) + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(zp: np.ndarray, zu: np.ndarray, n: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(risk, its negative part before it is held at 0, gradients by the scores of positives and of unlabelled rows).

    risk = prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)), logistic loss; ``n``
    says how many documents an unlabelled row stands for. When the second part is negative, its
    gradient alone is followed, reversed, as the estimator asks.
    """
    share = n / n.sum()
    plus, minus = prior * np.mean(np.logaddexp(0, -zp)), prior * np.mean(np.logaddexp(0, zp))
    negative = float((share * np.logaddexp(0, zu)).sum() - minus)
    gp_plus, gp_minus, gu = -_sigmoid(-zp) * prior / len(zp), -_sigmoid(zp) * prior / len(zp), share * _sigmoid(zu)
    if negative >= 0:
        return plus + negative, negative, gp_plus + gp_minus, gu
    return plus, negative, -gp_minus, -gu


def train(positive: Bag, unlabelled: Bag, n: np.ndarray, scale: np.ndarray, prior: float, epochs: int = EPOCHS) -> np.ndarray:
    """Weights and bias (last) of a linear score under the non-negative risk, by Adam over all rows.

    Inputs are scaled by the log ratios of their document frequencies; from the same small weight for
    each the risk moves them.
    """
    width = len(scale)
    w, b = np.full(width, START), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for epoch in range(1, epochs + 1):
        _, _, gp, gu = risk(positive.dot(w * scale) + b, unlabelled.dot(w * scale) + b, n, prior)
        grad = np.append((positive.back(gp, width) + unlabelled.back(gu, width)) * scale + DECAY * (w - START) / max(1, width), gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
        w, b = w - step[:width], b - step[width]
    return np.append(w * scale, b)


def telling(found: list[np.ndarray], docs: list[int]) -> np.ndarray:
    """Log ratio of each feature's share of two groups of documents; 0 unless it is surely not 0."""
    rate = [(c + 0.5) / (n + 1) for c, n in zip(found, docs, strict=True)]
    ratio = np.log(rate[0] / rate[1])
    error = np.sqrt(1 / (found[0] + 0.5) + 1 / (found[1] + 0.5))
    return np.where((found[0] + found[1] >= LEAST_DOCS) & (np.abs(ratio) > SIGNIFICANCE * error), ratio, 0.0)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on at most ``POSITIVES`` labelled toxic documents, by a hash of doc_id, and on every document as unlabelled.

    Held-out rows are neither. Document frequencies are counted over all; of features only those that tell
    the positives from the rest are kept, so documents become short lists, equal ones of a slice
    one row. Every slice of about ``SLICE`` documents is trained on by a task of its own, with the same positives,
    and the weights of slices are averaged. The class prior is the toxic share of labels.
    """
    configure(docs.sparkSession)
    known = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held_out())
    share = known.where("toxic is not null").agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    prior = min(0.9, max(1e-3, share or 0.0))
    nothing = Model(np.zeros(SIZE), float(np.log(prior / (1 - prior))), prior)
    chosen = known.where("toxic = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(3))).limit(POSITIVES)
    rows = texts(docs).where(~held_out())
    sample = materialize(bagged(rows.join(F.broadcast(chosen), "doc_id", "left_semi")), "positives")
    heads = sample.select("doc_id", "keys").toArrow().sort_by("doc_id")
    if not len(heads):
        return nothing
    ids, found = heads["doc_id"].to_numpy(), np.array(heads["keys"].to_pylist(), np.int64).view(np.uint64).reshape(-1, 2)
    apart = ids[fresh(found, set())].tolist()
    count, n_docs, total = frequencies(rows)
    scale = telling([counted(sample, apart), count], [len(apart), n_docs])
    used = scale != 0
    place = np.where(used, np.cumsum(used) - 1, -1)
    positive = Bag.of(narrowed(sample, place).select("features").toArrow()["features"])
    shared = docs.sparkSession.sparkContext.broadcast((used, place, positive, scale[used]))

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, _, _ = shared.value
        for batch in batches:
            doc, feature = features(batch.column(1), own)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(doc, at[feature], batch.num_rows)], ["doc_id", "features"])

    def learn(table: pa.Table) -> pa.Table:
        _, _, toxic, size = shared.value
        got = train(toxic, Bag.of(table["features"]), table["n"].to_numpy(), size, prior)
        return pa.table({"weights": pa.array([got], pa.list_(pa.float64()))})

    slices = sliced(rows.mapInArrow(lean(compact), "doc_id long, features array<int>"), total, SLICE, "features")
    mean = averaged(slices.groupBy("slice").applyInArrow(learn, "weights array<double>"))
    weight = np.zeros(SIZE)
    weight[used] = mean[:-1]
    return Model(weight, float(mean[-1]), prior)


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs``, every column as it is, and ``column``: the score of each whole text. No shuffle."""
    configure(docs.sparkSession)
    schema = docs.select("*", F.lit(0.0).alias(column)).schema
    place = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(batch.column(place)), pa.float64())], [*batch.schema.names, column])

    return docs.mapInArrow(lean(run), schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5) of each document.

    A null or empty text scores by the prior alone. Labels of held-out rows
    (crc32(doc_id as text) mod 5 = 0) aren't read, and labels, lang, source and
    doc_id are no inputs. Without positives every document scores the prior. An empty
    table gives no rows; extra columns are ignored; repeated rows are scored each; a null doc_id isn't held out.
    """
    out = restored(scored(texts(docs), fit(docs, labels)))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

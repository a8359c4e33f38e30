"""A quality classifier by co-training of a text view and a metadata view."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneforge.llm import stats
from zoneforge.llm.bags import Bag, averaged, bagged, counted, features, fresh, lists, narrowed, sliced
from zoneforge.llm.common import configure, held_out, identified, materialize, restored
from zoneforge.llm.toxicity import telling

#: Labelled documents of the sample at most; rows of a slice of the unlabelled; rounds; share of the unlabelled that a view labels for the other in a round, and how sure it must be.
LABELLED, SLICE, ROUNDS, SHARE, SURE = 6000, 8000, 5, 0.05, 0.9
#: Bins of a number (by quantiles of the labelled sample), hashed places of a source, a language, and both together.
BINS, SOURCES, LANGUAGES, PAIRS = 10, 64, 64, 256
META = BINS + 1 + SOURCES + LANGUAGES + PAIRS
#: Steps of the first fit and of each later one, which goes on from the weights so far.
STEPS, MORE_STEPS, RATE, DECAY = 150, 40, 0.1, 1e-3
N_SHARES = len(stats.SHARES)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _line(z: np.ndarray, y: np.ndarray) -> tuple:
    """Weights of a logistic regression on few columns, by Newton's steps with a little decay; the offset last."""
    x = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return tuple(float(v) for v in w)


def fit_view(bag: Bag, y: np.ndarray, n: np.ndarray, width: int, w: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression over places, bias last; ``n`` says how many documents a row stands for."""
    steps, w = (STEPS, np.zeros(width + 1)) if w is None else (MORE_STEPS, w.copy())
    m, v, share = np.zeros(width + 1), np.zeros(width + 1), n / n.sum()
    for t in range(1, steps + 1):
        g = share * (_sigmoid(bag.dot(w[:-1]) + w[-1]) - y)
        grad = np.append(bag.back(g, width) + DECAY * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass
class Labelled:
    """The labelled sample: a bag for each view, labels, and the fold of each row.

    Fold 0 calibrates and combines, fold 1 judges whether a round helped, the rest is learned from.
    """

    views: tuple[Bag, Bag]
    widths: tuple[int, int]
    y: np.ndarray
    fold: np.ndarray

    def part(self, *folds: int) -> np.ndarray:
        """Marks of rows of these folds; of all, where they lack a kind."""
        own = np.isin(self.fold, folds)
        return own if len(set(self.y[own])) == 2 else np.ones(len(self.y), bool)

    def first(self) -> list[np.ndarray]:
        own = self.part(2, 3)
        return [fit_view(v.take(own), self.y[own], np.ones(own.sum()), k) for v, k in zip(self.views, self.widths, strict=True)]

    def line(self, k: int, w: np.ndarray) -> tuple[float, float]:
        own = self.part(0)
        return _line(self.views[k].take(own).dot(w[:-1])[:, None] + w[-1], self.y[own])

    def loss(self, k: int, w: np.ndarray) -> float:
        """Mean log loss of a calibrated view on the fold that judges."""
        own, (slope, offset) = self.part(1), self.line(k, w)
        z = slope * (self.views[k].take(own).dot(w[:-1]) + w[-1]) + offset
        return float(np.mean(np.logaddexp(0, np.where(self.y[own] == 1, -z, z))))


def cotrain(known: Labelled, start: list[np.ndarray], free: tuple[Bag, Bag], n: np.ndarray, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Weights of both views after they have taught each other on the unlabelled rows ``free``.

    In each round a view labels those unlabelled rows that it is surest of, of
    either kind as often as the labels have it, and the other view learns from them. A view goes
    back to what it was, without these labels, if its loss on the judging fold rises.
    """
    weights, given = [w.copy() for w in start], [np.full(len(n), -1), np.full(len(n), -1)]
    own = known.part(2, 3)
    bags, base = [v.take(own) for v in known.views], known.y.mean()
    best = [known.loss(k, weights[k]) for k in (0, 1)]
    for _ in range(rounds if len(n) else 0):
        taught = []
        for k in (0, 1):
            slope, offset = known.line(k, weights[k])
            p = _sigmoid(slope * (free[k].dot(weights[k][:-1]) + weights[k][-1]) + offset)
            rest, new = np.flatnonzero(given[1 - k] < 0), given[1 - k].copy()
            for label, share, sure in ((1, base, p), (0, 1 - base, 1 - p)):
                most = rest[np.argsort(-sure[rest], kind="stable")][: max(1, int(SHARE * len(rest) * share))]
                new[most[sure[most] >= SURE]] = label
            taught.append(new)
        for k in (0, 1):
            new = taught[1 - k]
            told = new >= 0
            if not (told & (given[k] < 0)).any():
                continue
            more = free[k].take(told)
            both = Bag(np.concatenate([bags[k].place, more.place]), np.concatenate([bags[k].row, more.row + bags[k].n]), bags[k].n + more.n)
            w = fit_view(both, np.concatenate([known.y[own], new[told]]), np.concatenate([np.ones(bags[k].n), n[told]]), known.widths[k], weights[k])
            loss = known.loss(k, w)
            if loss <= best[k]:
                weights[k], best[k], given[k] = w, loss, new
    return weights


def combine(known: Labelled, weights: list[np.ndarray]) -> tuple[list[tuple[float, float]], tuple[float, float, float]]:
    """(slope and offset of each view, weights of both calibrated views and an offset), from the fold kept apart."""
    own, lines = known.part(0), [known.line(k, w) for k, w in enumerate(weights)]
    z = [a * (v.take(own).dot(w[:-1]) + w[-1]) + b for v, w, (a, b) in zip(known.views, weights, lines, strict=True)]
    return lines, _line(np.stack(z, axis=1), known.y[own])


def names(source: list, lang: list) -> np.ndarray:
    """Hashed places of source, language and both."""
    place = lambda kind, x, size: xxhash.xxh32_intdigest(f"{kind}:{x}") % size
    at = BINS + 1
    return np.array([[at + place("s", s, SOURCES), at + SOURCES + place("l", g, LANGUAGES), at + SOURCES + LANGUAGES + place("p", (s, g), PAIRS)] for s, g in zip(source, lang, strict=True)], np.int64).reshape(-1, 3)


def shares(column: pa.Array) -> np.ndarray:
    found = stats.counts(column)
    return np.stack([found[a] / np.maximum(found[b], 1) for _, a, b in stats.SHARES], axis=1)


@dataclass
class Views:
    """Places of a batch in either view: binned shares and telling words of the text; binned n_chars, source and language as the table has them."""

    edges: np.ndarray
    char_edges: np.ndarray
    place: np.ndarray

    @property
    def widths(self) -> tuple[int, int]:
        return N_SHARES * BINS + int((self.place >= 0).sum()), META

    def binned(self, values: np.ndarray) -> np.ndarray:
        return np.stack([k * BINS + np.searchsorted(self.edges[:, k], values[:, k], side="left") for k in range(N_SHARES)], axis=1)

    def chars(self, values: list) -> np.ndarray:
        """The bin of n_chars; a null has the last place."""
        return np.array([BINS if v is None else int(np.searchsorted(self.char_edges, v, side="left")) for v in values], np.int64)

    def text(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) in order of rows."""
        n = len(column)
        doc, feature = features(column, self.place >= 0)
        row = np.concatenate([np.repeat(np.arange(n), N_SHARES), doc])
        at = np.concatenate([self.binned(shares(column)).ravel(), N_SHARES * BINS + self.place[feature]])
        order = np.argsort(row, kind="stable")
        return row[order], at[order]

    def meta(self, source: list, lang: list, chars: list) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate([self.chars(chars)[:, None], names(source, lang)], axis=1)
        return np.repeat(np.arange(len(at)), at.shape[1]), at.ravel()


@dataclass
class Model:
    views: Views
    weights: list[np.ndarray]
    lines: list[tuple[float, float]]
    mix: tuple[float, float, float]

    def scores(self, text: pa.Array, source: list, lang: list, chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = []
        for (row, at), w, (a, b) in zip((self.views.text(text), self.views.meta(source, lang, chars)), self.weights, self.lines, strict=True):
            z.append(a * (np.bincount(row, w[at], len(text)) + w[-1]) + b)
        return _sigmoid(z[0]), _sigmoid(z[1]), _sigmoid(self.mix[0] * z[0] + self.mix[1] * z[1] + self.mix[2])


def _rows(docs: DataFrame) -> DataFrame:
    chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(identified(), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), chars.alias("n_chars"))


def _labelled(docs: DataFrame, labels: DataFrame) -> tuple[Views, Labelled] | None:
    """Views and the labelled sample, at most ``LABELLED`` rows that aren't held out, by a hash of doc_id. None without labels of both kinds."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    chosen = known.where(~held_out()).orderBy(F.xxhash64("doc_id", F.lit(13))).limit(LABELLED)
    rows = _rows(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "source", "lang", "n_chars", "quality")
    sample = materialize(bagged(rows.select("doc_id", "text", "quality", "source", "lang", "n_chars", "text").toDF("doc_id", "text", "quality", "source", "lang", "n_chars", "body")), "labelled")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(shares(batch.column(batch.num_columns - 1))), pa.list_(pa.float64()))], [*batch.schema.names[:-1], "shares"])

    found = sample.select("doc_id", "quality", "source", "lang", "n_chars", "keys", "body").mapInArrow(measure, "doc_id long, quality int, source string, lang string, n_chars double, keys array<long>, shares array<double>").toArrow()
    y = found["quality"].to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
    ids = found["doc_id"].to_numpy()[order]
    new = fresh(np.array(found["keys"].to_pylist(), np.int64).view(np.uint64).reshape(-1, 2)[order], set())
    groups = [ids[new & (y[order] == k)].tolist() for k in (0, 1)]
    used = telling([counted(sample, g) for g in groups], [len(g) for g in groups]) != 0
    values, chars = np.array(found["shares"].to_pylist()), [c for c in found["n_chars"].to_pylist() if c is not None]
    steps = np.linspace(0, 1, BINS + 1)[1:-1]
    views = Views(np.quantile(values, steps, axis=0), np.quantile(chars, steps) if chars else np.zeros(0), np.where(used, np.cumsum(used) - 1, -1))
    words = narrowed(sample.select("doc_id", "features"), views.place).toArrow()
    by_id = dict(zip(words["doc_id"].to_pylist(), words["features"].to_pylist(), strict=True))
    text = pa.array([[*own, *(N_SHARES * BINS + x for x in by_id[i])] for own, i in zip(views.binned(values).tolist(), found["doc_id"].to_pylist(), strict=True)], pa.list_(pa.int32()))
    row, at = views.meta(found["source"].to_pylist(), found["lang"].to_pylist(), found["n_chars"].to_pylist())
    return views, Labelled((Bag.of(text), Bag(at, row, len(y))), views.widths, y.astype(float), np.array([xxhash.xxh32_intdigest(str(i)) % 4 for i in found["doc_id"].to_pylist()]))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Co-train on the labelled sample and on every document without a label that isn't held out.

    The first fit of both views and the labelled sample go to all tasks. Each slice of about ``SLICE`` unlabelled
    documents, as short lists of places, is a pool on which a task lets the views teach each other; weights of slices are
    averaged, and the fold kept apart calibrates each view and combines both.
    """
    configure(docs.sparkSession)
    own = _labelled(docs, labels)
    if own is None:
        return None
    views, known = own
    start = known.first()
    marked = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    free = _rows(docs).where(~held_out())
    shared = docs.sparkSession.sparkContext.broadcast((views, known, start))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value[0]
        for batch in batches:
            text, meta = found.text(batch.column(1)), found.meta(*(batch.column(i).to_pylist() for i in (2, 3, 4)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(lists(row, at, batch.num_rows) for row, at in (text, meta))], ["doc_id", "text_places", "meta_places"])

    def teach(table: pa.Table) -> pa.Table:
        _, sample, first = shared.value
        got = cotrain(sample, first, (Bag.of(table["text_places"]), Bag.of(table["meta_places"])), table["n"].to_numpy().astype(float))
        return pa.table({"weights": pa.array([np.concatenate(got)], pa.list_(pa.float64()))})

    rows = materialize(free.mapInArrow(places, "doc_id long, text_places array<int>, meta_places array<int>").join(marked, "doc_id", "left_anti"), "places")
    weights = start
    if total := rows.count():
        mean = averaged(sliced(rows, total, SLICE, "text_places", "meta_places").groupBy("slice").applyInArrow(teach, "weights array<double>"))
        weights = [mean[: len(start[0])], mean[len(start[0]) :]]
    return Model(views, weights, *combine(known, weights))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, text_score, meta_score, score, predicted, kept of each document (1: good quality).

    Quality labels of held-out rows (crc32(doc_id as text) mod 5 = 0) aren't read, their texts neither. Null
    texts count as empty, null sources and languages as names of their own, a null or missing n_chars as a length of its own. Without labels of both kinds
    all scores are one half and everything is kept. An empty table gives no rows; extra columns are ignored;
    repeated rows are scored each; a null doc_id has no label and isn't held out.
    """
    spark = configure(docs.sparkSession)
    shared = spark.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            half = np.full(batch.num_rows, 0.5)
            found = (half, half, half) if model is None else model.scores(batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3, 4)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found)], ["doc_id", "text_score", "meta_score", "score"])

    out = restored(_rows(docs).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double"))
    return out.select("doc_id", held_out().alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= 0.5).alias("kept"))

"""Quality rules as learned decision lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zoneforge.llm import stats
from zoneforge.llm.common import configure, restored, texts

#: Labelled rows that the rules are learned from; thresholds tried a statistic; conditions of a rule, rules of a list.
SAMPLE, CUTS, CONDITIONS, RULES = 8000, 24, 3, 12
#: Least share of bad rows among those that a rule takes, and least rows it takes, while pruning.
PRECISION, SUPPORT = 0.97, 5

#: A condition: statistic, whether above (else at or below), threshold. A rule: conditions that all hold.
Condition = tuple[str, bool, float]
Rule = tuple[Condition, ...]
FEATURES = ("n_words", *(name for name, _, _ in stats.SHARES))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, counts of each whole text, and their shares (0 where the divisor is 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = stats.counts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[c].astype(np.int64)) for c in stats.COUNTS)], ["doc_id", *stats.COUNTS])

    rows = texts(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in stats.COUNTS))
    return rows.select("*", *((F.col(a) / F.greatest(F.col(b), F.lit(1))).alias(name) for name, a, b in stats.SHARES))


def labelled(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """Statistics and quality of at most ``bound`` labelled documents, chosen by a hash of doc_id."""
    known = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(11))).limit(bound)
    return statistics(docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(chosen), "doc_id")


def _holds(x: dict[str, np.ndarray], rule: Rule) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, above, cut in rule:
        out &= x[name] > cut if above else x[name] <= cut
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray]) -> Rule:
    """Add the condition of most information gain until no good row is covered or none gains."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < CONDITIONS and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best, gain = None, 1e-9
        for name in FEATURES:
            for cut in cuts[name]:
                over = inside & (x[name] > cut)
                for above, part in ((True, over), (False, inside & ~over)):
                    p, n = (part & bad).sum(), (part & ~bad).sum()
                    if p and (got := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain, kept = (name, above, float(cut)), got, part
        if best is None:
            break
        rule, inside = (*rule, best), kept
    return rule


def _prune(x: dict[str, np.ndarray], bad: np.ndarray, rule: Rule) -> Rule:
    """Drop last conditions while (bad - good) / covered on rows not used to grow does not fall."""

    def worth(r: Rule) -> float:
        m = _holds(x, r)
        return ((m & bad).sum() - (m & ~bad).sum()) / max(1, m.sum())

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def _centred(x: dict[str, np.ndarray], rule: Rule) -> Rule:
    """Each threshold half way between the sample's values on either side of it."""
    out = []
    for name, above, cut in rule:
        low, high = x[name][x[name] <= cut], x[name][x[name] > cut]
        out.append((name, above, float((low.max() + high.min()) / 2) if len(low) and len(high) else cut))
    return tuple(out)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray) -> list[Rule]:
    """Sequential covering: grow a rule for bad rows on two thirds of what is left, prune it on
    the other third, keep it if it is precise, take away what it covers, go on."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < RULES and (left & bad).sum() >= SUPPORT:
        grow, check = left & (fold > 0), left & (fold == 0)
        cuts = {f: np.unique(np.quantile(x[f][grow & bad], np.linspace(0, 1, CUTS))) if (grow & bad).any() else np.zeros(0) for f in FEATURES}
        cuts = {f: np.unique(np.concatenate([c, np.quantile(x[f][grow], np.linspace(0, 1, CUTS))])) if grow.any() else c for f, c in cuts.items()}
        rule = _grow({f: v[grow] for f, v in x.items()}, bad[grow], cuts)
        if not rule:
            break
        if check.any():
            rule = _prune({f: v[check] for f, v in x.items()}, bad[check], rule)
        rule = _centred(x, rule)
        taken = left & _holds(x, rule)
        if (taken & bad).sum() < SUPPORT or (taken & bad).sum() < PRECISION * taken.sum():
            break
        rules.append(rule)
        left &= ~taken
    return rules


def fit(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """The ordered rules that the labelled sample gives; each takes low-quality documents. None without labels of both kinds."""
    configure(docs.sparkSession)
    rows = labelled(docs, labels).select("doc_id", "quality", *FEATURES).toArrow().sort_by("doc_id")
    x = {f: rows[f].to_numpy().astype(float) for f in FEATURES}
    bad = rows["quality"].to_numpy() == 0
    if not bad.any() or bad.all():
        return []
    return learn(x, bad, rows["doc_id"].to_numpy() % 3)


def expression(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the number of the first rule that holds (from 1), else 0."""
    out = None
    for number, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for name, above, cut in rule:
            holds = holds & ((F.col(name) > cut) if above else (F.col(name) <= cut))
        out = F.when(holds, number) if out is None else out.when(holds, number)
    return F.lit(0) if out is None else out.otherwise(0)


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, base counts, base_failed, rule (the first that holds, 0: none), kept.

    base_failed: under 10 words, or over a fifth of them in 5-word windows that
    the text repeats. kept: not base_failed and no rule holds. A null or
    empty text has no words and fails. Extra columns are ignored; repeated rows are
    judged each; an empty table gives no rows; without labels of both kinds the base alone decides.
    """
    rules = fit(docs, labels)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = statistics(docs).withColumn("base_failed", failed).withColumn("rule", expression(rules))
    return restored(rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule"))

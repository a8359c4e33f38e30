"""Phrases against brute force, and count transducers against dictionaries."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from zoneforge.llm import collocations
from zoneforge.llm.transducer import Transducer, union

SCHEMA = "doc_id long, text string, lang string, n long, rank string, score int"
RNG = np.random.default_rng(12)
WORDS = ["the", "of", "New", "york", "CITY", "é", "ÉA", "x\x01", "a", "b", "c-d", " ", "漢字"]


def brute(rows, least=10, top=2000, covered=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        longer = Counter()
        for p, a in counts.items():
            if len(p) == 3 and a >= least:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], a)
        for p, a in counts.items():
            if len(p) > 1 and a >= least and not (p in longer and 100 * longer[p] >= covered * a):
                cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), p, k))
        for rank, (score, a, text, p, k) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, text.decode(), -a, counts[p[:k]], counts[p[k:]], n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    seps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!", " ? ", "\r", "\x0b"]
    text = lambda n: "".join(RNG.choice(WORDS) + RNG.choice(seps) for _ in range(n))
    own = [(["en", "de", None, "und"][i % 4], text(int(RNG.integers(0, 120)))) for i in range(120)]
    own += [("en", None), ("en", ""), (None, " . , "), ("fr", "one two three " * 9), ("fr", "one two three"), ("es", "New York City " * 40), ("es", "new york " * 7)]
    return own + [("en", text(3000)), ("en", "of the a " * 50), ("en", "of the a " * 50)]


@pytest.mark.parametrize(("sizes", "top", "least"), [({}, 2000, 10), ({"CHUNK": 50, "COUNTED": 40, "WORDS": 5, "GRAMS": 60, "BLOCK": 7, "RANGE": 30}, 2000, 10), ({"COUNTED": 300, "GRAMS": 100, "BLOCK": 50}, 5, 2)])
def test_phrases_are_brute_force(spark, rows, sizes, top, least, monkeypatch):
    for name, value in sizes.items():
        monkeypatch.setattr(collocations, name, value)
    docs = spark.createDataFrame([(i, t, lang, 1, "r", 2) for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(4)
    found = collocations.phrases(docs, least=least, top=top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = brute(rows, least, top)
    assert sorted(tuple(r) for r in found.collect()) == expected
    assert len({r[0] for r in expected}) == 5 and any(len(r[2].split(" ")) == 3 for r in expected)


def test_scores_are_exact_beyond_64_bits():
    a = np.array([3_000_000_017], np.int64).astype(object)
    assert (1_000_000 * a**2 // (a * (a + 1)))[0] == 999_999


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_transducers_are_dictionaries(depth):
    rng = np.random.default_rng(depth)
    made, total = [], Counter()
    for _ in range(6):
        counts = Counter(tuple(f"w{i}".encode() for i in rng.integers(0, 12, depth)) for _ in range(200))
        words = sorted({w for g in counts for w in g})
        grams = sorted(counts)
        own = Transducer.of(words, np.array([[words.index(w) for w in g] for g in grams]), np.array([counts[g] for g in grams]))
        again = Transducer.from_bytes(own.to_bytes())
        paths, n = again.paths()
        assert [tuple(again.words[i] for i in p) for p in paths.tolist()] == grams and n.tolist() == [counts[g] for g in grams]
        made.append(again)
        total += counts
    words, grams, n = union(made, 3)
    assert {tuple(words[i] for i in g): c for g, c in zip(grams.tolist(), n.tolist(), strict=True)} == {g: c for g, c in total.items() if c >= 3}
    both = Transducer.of(*union(made))
    asked = sorted({tuple(f"w{i}".encode() for i in rng.integers(0, 14, depth)) for _ in range(300)})
    names = sorted({w for g in asked for w in g})
    query = Transducer.of(names, np.array([[names.index(w) for w in g] for g in asked]), np.zeros(len(asked), np.int64))
    assert both.compose(query).tolist() == [total[g] for g in asked]
    # suffixes that are alike are kept once
    alike = Transducer.of([b"a", b"b", b"c"], np.array([[0, 2], [1, 2]]), np.array([5, 5]))
    assert len(alike.levels[1][1]) == 1


def test_a_full_filter_only_lets_more_through(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_BITS", 64)
    docs = spark.createDataFrame([(i, t, lang, 1, "r", 2) for i, (lang, t) in enumerate(rows)], SCHEMA)
    assert sorted(tuple(r) for r in collocations.phrases(docs).collect()) == brute(rows)


def test_an_empty_table(spark):
    assert collocations.phrases(spark.createDataFrame([], SCHEMA)).collect() == []


def test_later_passes_number_frequent_words_alone():
    """Words that the filter leaves out share one number and part n-grams; languages do not mix."""
    keys = [collocations._gram_hash([collocations._hashes([w])], lang) for w, lang in ((b"a", "x"), (b"b", "x"), (b"a", "y"))]
    first = np.zeros(1 << 10, np.uint64)
    for key in keys:
        for slot in collocations._slots(key, 64 * len(first)):
            first[int(slot[0]) >> 6] |= np.uint64(1) << (slot[0] & np.uint64(63))
    shard = collocations.Shard(2, first)
    rows = [row for lang, text in (("x", "a b rare1 a  b. a"), ("y", "a b"), ("x", "b rare2 a b")) for row in shard.add(lang, text)]
    rows += list(shard.flush())
    assert not rows or all(r[0] == "x" for r in rows)
    grams, counts = collocations.Transducer.from_bytes(rows[0][4]).paths()
    assert len(rows) == 1 and rows[0][1] == [b"a", b"b"] and counts.tolist() == [3] and len(grams) == 1
    shard = collocations.Shard(2, first)
    for k in range(1000):
        list(shard.add("x", f"a b r{k}"))
    shard._count()
    assert len(shard.ids) < 20

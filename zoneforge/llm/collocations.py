"""Phrases whose words stand together more often than they would by themselves, from count transducers."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zoneforge.llm.common import configure, materialize
from zoneforge.llm.runs import splitters
from zoneforge.llm.transducer import Transducer, summed, union
from zoneforge.llm.words import mix

#: Least count of a candidate, phrases given for a language, score of a phrase that never stands apart.
LEAST, TOP, SCALE = 10, 2000, 1_000_000
#: A candidate goes if a longer one that holds it has this share of its count, in hundredths.
COVERED = 50
#: Bytes of text cut at a time; words that are numbered, and counted, at a time; words and n-grams that a task holds before it sends them.
CHUNK, NUMBERED, COUNTED, WORDS, GRAMS = 1 << 20, 1 << 16, 1 << 20, 600_000, 1_500_000
#: N-grams of a transducer that is sent, and for each range that is joined.
BLOCK, RANGE = 1 << 15, 2_000_000
#: Most bits of the filter of frequent n-grams (16 MB). With more of them it lets more through, which costs time alone.
FILTER_BITS = 1 << 27
_PROBES = 3
_MARKS = bytes.maketrans(b"\t.,;:!?\r\x0b\x0c", b" \n\n\n\n\n\n\n\n\n")
#: Ids of what stands between spaces side by side, of the end of a piece, and of all words that the filter leaves out.
_NONE, _STOP, _RARE = 0, 1, 2
_FACTORS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


class _Ids(dict):
    """Words by number; a new one takes the next."""

    def __init__(self):
        super().__init__({b"": _NONE, b"\n": _STOP, b" ": _RARE})

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        return i


def stream(text: str) -> Iterator[list[bytes]]:
    """A text's words with a line end after each piece, and empty ones; a long text comes in chunks, cut between words."""
    data = text.encode("utf-8", "surrogatepass").lower().translate(_MARKS)
    at = 0
    while at < len(data):
        ends = [x for x in (data.find(c, at + CHUNK) for c in (b" ", b"\n")) if x >= 0] if len(data) - at > CHUNK else []
        end = min(ends, default=len(data))
        yield data[at:end].replace(b"\n", b" \n ").split(b" ")
        at = end
    yield [b"\n"]


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, 12) for w in words], np.uint64)


def _gram_hash(columns: list[np.ndarray], lang: str) -> np.ndarray:
    """A hash of n-grams (columns of hashes of words) of a language; a key of the filter."""
    total = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 13))
    for h, factor in zip(columns, _FACTORS, strict=False):
        total = mix(total + h * factor)
    return total


def _slots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    step = (keys >> np.uint64(40)) | np.uint64(1)
    return [(keys + np.uint64(i) * step) % np.uint64(bits) for i in range(_PROBES)]


def _holds(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for slot in _slots(keys, 64 * len(table)):
        out &= (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


class Shard:
    """Counts of one task's n-grams by language, sent on as transducers of blocks in order.

    ``table`` is the filter of frequent (n-1)-grams, ``first`` that of frequent words: with it a rarer word gets no number of its own, so
    the numbers of words stay few.
    """

    def __init__(self, n: int, table: np.ndarray | None, first: np.ndarray | None = None):
        self.n, self.table, self.first = n, table, table if n == 2 else first
        self.clear()

    def clear(self) -> None:
        self.ids = _Ids()
        self.hash = np.zeros(len(self.ids), np.uint64)
        self.known: dict[str, dict[bytes, int]] = {}
        self.unread: dict[str, list[bytes]] = {}
        self.waiting: dict[str, list[np.ndarray]] = {}
        self.found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.n_unread = self.n_waiting = self.n_found = 0

    def add(self, lang: str, text: str) -> Iterator[tuple]:
        """Count a text's n-grams; what a full shard sends on."""
        for words in stream(text):
            self.unread.setdefault(lang, []).extend(words)
            self.n_unread += len(words)
            if self.n_unread > NUMBERED:
                self._number()
            if self.n_waiting > COUNTED:
                self._count()
            if len(self.ids) > WORDS or self.n_found > GRAMS:
                yield from self.flush()

    def _number(self) -> None:
        """Words become numbers."""
        for lang, words in self.unread.items():
            if self.first is None:
                own = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
            else:
                known = self.known.setdefault(lang, {b"": _NONE, b"\n": _STOP})
                own = np.fromiter(map(known.get, words, repeat(_RARE)), np.int64, len(words))
                new = np.flatnonzero(own == _RARE)
                new = new[_holds(self.first, _gram_hash([_hashes([words[i] for i in new.tolist()])], lang))]
                for i in new.tolist():
                    own[i] = known[words[i]] = self.ids[words[i]]
            own = own[own != _NONE]
            self.waiting.setdefault(lang, []).append(own)
            self.n_waiting += len(own)
        self.unread, self.n_unread = {}, 0

    def _count(self) -> None:
        """Count what waits; of each language the last words stay, for n-grams that go on."""
        self._number()
        if self.n == 3:
            words = list(self.ids)[len(self.hash) :]
            self.hash = np.concatenate([self.hash, _hashes(words)]) if words else self.hash
        for lang, parts in self.waiting.items():
            x = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            if len(x) >= self.n:
                self._grams(lang, x)
            self.waiting[lang] = [x[max(0, len(x) - self.n + 1) :]] if self.n > 1 else []
        self.n_waiting = 0
        if self.n_found > GRAMS:
            self.found = {lang: [summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))] for lang, parts in self.found.items()}
            self.n_found = sum(len(parts[0][0]) for parts in self.found.values())

    def _grams(self, lang: str, x: np.ndarray) -> None:
        ok = x > _RARE
        if self.n == 1:
            counts = np.bincount(x[ok])
            keys = np.flatnonzero(counts)
            counts = counts[keys]
        else:
            start = np.flatnonzero(ok[:-1] & ok[1:])
            if self.n == 2:
                # a pair is frequent only if both its words are
                keys = (x[start] << 31) | x[start + 1]
            else:
                good = np.zeros(len(x), bool)
                good[start] = _holds(self.table, _gram_hash([self.hash[x[start]], self.hash[x[start + 1]]], lang))
                start = np.flatnonzero(good[:-2] & good[1:-1])
                keys = (x[start] << 42) | (x[start + 1] << 21) | x[start + 2]
            keys, counts = np.unique(keys, return_counts=True)
        self.found.setdefault(lang, []).append((keys, counts.astype(np.int64)))
        self.n_found += len(keys)

    def flush(self) -> Iterator[tuple]:
        """(lang, first n-gram, n-grams, their counts' sum, transducer) of each block."""
        self._count()
        bits = {1: 31, 2: 31, 3: 21}[self.n]
        words = list(self.ids)
        order = sorted(range(len(words)), key=words.__getitem__)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        words = [words[i] for i in order]
        for lang, parts in self.found.items():
            keys, counts = summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            columns = [rank[(keys >> (bits * (self.n - 1 - d))) & ((1 << bits) - 1)] for d in range(self.n)]
            by = np.lexsort(columns[::-1])
            yield from blocks(lang, words, np.stack(columns, 1)[by], counts[by])
        tails = {lang: [words[rank[i]] for part in parts for i in part.tolist()] for lang, parts in self.waiting.items()}
        self.clear()
        self.waiting = {lang: [np.array([self.ids[w] for w in tail], np.int64)] for lang, tail in tails.items()}


def blocks(lang: str, words: list[bytes], grams: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    for k in range(0, len(grams), BLOCK):
        part, n = grams[k : k + BLOCK], counts[k : k + BLOCK]
        yield lang, [words[i] for i in part[0].tolist()], len(part), int(n.sum()), Transducer.of(words, part, n).to_bytes()


_SHARD = "lang string, first array<binary>, n long, weight long, automaton binary"
_SHARD_TYPES = {"lang": pa.string(), "first": pa.list_(pa.binary()), "n": pa.int64(), "weight": pa.int64(), "automaton": pa.binary()}


def _rows(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))


def shards(docs: DataFrame, n: int, table: np.ndarray | None = None, first: np.ndarray | None = None) -> DataFrame:
    """Transducers of the n-grams of each task's texts, by language, in blocks in order. ``table`` is the filter of frequent
    (n-1)-grams, ``first`` that of words: an n-gram that holds a rarer one isn't frequent either and stays out."""
    sent = docs.sparkSession.sparkContext.broadcast((table, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(n, *sent.value)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in shard.add(lang, text.as_py()):
                    yield _rows([row], _SHARD_TYPES)
        for row in shard.flush():
            yield _rows([row], _SHARD_TYPES)

    rows = docs.where(F.length(F.col("text").cast("string")) > 0).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _SHARD)


def _cut(lang: str, own: Transducer, cuts: list[tuple]) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
    """(part, words, n-grams, counts) of the ranges between ``cuts`` that a transducer reaches into."""
    grams, counts = own.paths()
    at = lambda i: (lang, tuple(own.words[k] for k in grams[i].tolist()))
    low = 0
    while low < len(grams):
        part = bisect_right(cuts, at(low))
        high = len(grams) if part == len(cuts) else bisect_left(range(len(grams)), cuts[part], low, key=at)
        yield part, own.words, grams[low:high], counts[low:high]
        low = high


_COUNT_TYPES = {"part": pa.int32(), **_SHARD_TYPES}


def joined(found: DataFrame, least: int) -> tuple[DataFrame, list[tuple]]:
    """(part, lang, first, n, weight, automaton): all shards' n-grams with counts of ``least`` or more, and the cuts of their ranges.

    Shards are cut at n-grams that part them evenly, so what begins with a very common word is in
    many ranges; each range is one union.
    """
    spark = found.sparkSession
    total = found.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE + 1)
    cuts = splitters(found, ("lang", "first"), parts, 12)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part, words, grams, counts in _cut(lang, Transducer.from_bytes(data), cuts):
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "lang": [lang], "automaton": pa.array([Transducer.of(words, grams, counts).to_bytes()], pa.binary())})

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        for (part, lang), own in groupby(rows, lambda r: r[:2]):
            held, have = [], 0
            for *_, data in own:
                held.append(Transducer.from_bytes(data))
                have += len(held[-1].levels[-1][1])
                if len(held) > 1 and have > RANGE:
                    held = [Transducer.of(*union(held))]
                    have = 0
            for row in blocks(lang, *union(held, least)):
                yield _rows([(part, *row)], _COUNT_TYPES)

    pieces = found.select("lang", "automaton").mapInArrow(cut, "part int, lang string, automaton binary")
    return pieces.repartition(parts, "part").sortWithinPartitions("part", "lang").mapInArrow(unite, f"part int, {_SHARD}"), cuts


def frequent(counts: DataFrame) -> np.ndarray:
    """The filter (64-bit words) of all n-grams of ``counts``; it has FILTER_BITS at most, whatever the corpus."""
    n = counts.agg(F.sum("n")).first()[0] or 0
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Transducer.from_bytes(data)
                grams, hashed = own.paths()[0], _hashes(own.words)
                slots = np.concatenate(_slots(_gram_hash([hashed[c] for c in grams.T], lang), bits))
                order = np.argsort(slots)
                slots = slots[order]
                first = np.flatnonzero(np.concatenate([[True], slots[1:] >> np.uint64(6) != slots[:-1] >> np.uint64(6)]))
                word = np.bitwise_or.reduceat(np.uint64(1) << (slots & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array((slots[first] >> np.uint64(6)).astype(np.int64)), pa.array(word.view(np.int64))], ["slot", "word"])

    found = counts.select("lang", "automaton").mapInArrow(run, "slot long, word long").groupBy("slot").agg(F.bit_or("word").alias("word")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[found.column("slot").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    return table


#: Columns of the parts that a candidate of so many words asks for, by name: the left and right part of each cut.
_ASKED = {2: {"l1": (0, 1), "r1": (1, 2)}, 3: {"l1": (0, 1), "r1": (1, 3), "l2": (0, 2), "r2": (2, 3)}}
_CANDIDATE = {"lang": pa.string(), "words": pa.int64(), "phrase": pa.string(), "head": pa.string(), "tail": pa.string(), "a": pa.int64(), "l": pa.int64(), "r": pa.int64(), "score": pa.int64()}


def candidates(levels: dict[int, tuple[DataFrame, list[tuple]]], scale: int = SCALE) -> DataFrame:
    """Candidates of 2 and 3 words with the counts of their lowest cut.

    Each block of candidates asks for its parts by an automaton of them for each range; there it is composed with the
    range's counts, and the answers go back to the block.
    """
    named = {n: materialize(df.withColumn("block", F.monotonically_increasing_id()), f"counts{n}") for n, (df, _) in levels.items()}
    spark = named[1].sparkSession
    cuts = {n: c for n, (_, c) in levels.items()}
    ask_types = {"level": pa.int32(), "part": pa.int32(), "lang": pa.string(), "source": pa.int32(), "block": pa.int64(), "kind": pa.string(), "automaton": pa.binary()}
    ask_schema = "level int, part int, lang string, source int, block long, kind string, automaton binary"

    def asking(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lang, data, block in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    own = Transducer.from_bytes(data)
                    grams = own.paths()[0]
                    for kind, (s, e) in _ASKED[n].items():
                        part = np.unique(grams[:, s:e], axis=0)
                        query = Transducer.of(own.words, part, np.zeros(len(part), np.int64))
                        yield _rows([(e - s, to, lang, n, block, kind, Transducer.of(words, g, c).to_bytes()) for to, words, g, c in _cut(lang, query, cuts[e - s])], ask_types)

        return run

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True))
        for _, own in groupby(rows, lambda r: r[:3]):
            known: list[Transducer] = []
            for _, part, _, source, block, kind, data in own:
                item = Transducer.from_bytes(data)
                if not source:
                    known.append(item)
                else:
                    counts = sum((k.compose(item) for k in known), np.zeros(len(item.paths()[1]), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([source], pa.int32()), pa.array([block]), pa.array([kind]), pa.array([part], pa.int32()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], ["source", "block", "kind", "part", "data"])

    asked = [named[n].select("lang", "automaton", "block").mapInArrow(asking(n), ask_schema) for n in _ASKED]
    counts = [named[n].select(F.lit(n).alias("level"), "part", "lang", F.lit(0).alias("source"), "block", F.lit("").alias("kind"), "automaton") for n in (1, 2)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = counts[0].unionByName(counts[1]).unionByName(asked[0]).unionByName(asked[1])
    met = met.repartition(parts, "level", "part", "lang").sortWithinPartitions("level", "part", "lang", "source")
    answers = met.mapInArrow(answer, "source int, block long, kind string, part int, data binary")
    own = [named[n].select(F.lit(n).alias("source"), "block", F.lit("").alias("kind"), F.lit(-1).alias("part"), F.col("automaton").alias("data"), "lang") for n in _ASKED]
    back = own[0].unionByName(own[1]).unionByName(answers.withColumn("lang", F.lit(None).cast("string")))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True))
        for (n, _), own in groupby(rows, lambda r: r[:2]):
            *_, data, lang = next(own)
            block = Transducer.from_bytes(data)
            grams, a = block.paths()
            counts = {kind: np.concatenate([np.frombuffer(r[4], "<i8") for r in some]) for kind, some in groupby(own, lambda r: r[2])}
            sides = {kind: counts[kind][np.unique(grams[:, s:e], axis=0, return_inverse=True)[1].ravel()] for kind, (s, e) in _ASKED[n].items()}
            top = scale * a.astype(object) ** 2  # whole numbers of any size
            score = np.stack([(top // (sides[f"l{k}"].astype(object) * sides[f"r{k}"].astype(object))).astype(np.int64) for k in range(1, n)], 1)
            k = score.argmin(1)  # the first of the lowest
            at = np.arange(len(a))
            left, right = (np.stack([sides[f"{side}{j}"] for j in range(1, n)], 1)[at, k] for side in "lr")
            text = [[block.words[i].decode("utf-8", "surrogatepass") for i in row] for row in grams.tolist()]
            join = lambda s, e: [" ".join(t[s:e]) for t in text]
            columns = [[lang] * len(a), [n] * len(a), join(0, n), join(0, n - 1), join(1, n), a, left, right, score[at, k]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CANDIDATE.values(), strict=True)], list(_CANDIDATE))

    schema = ", ".join(f"{c} {'string' if t == pa.string() else 'long'}" for c, t in _CANDIDATE.items())
    back = back.repartition(parts, "source", "block").sortWithinPartitions("source", "block", "kind", "part")
    return back.mapInArrow(scored, schema)


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED, scale: int = SCALE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the ``top`` phrases of 2 and 3 words that stand together most.

    Counts of words, then pairs, then triples: each pass keeps n-grams whose parts are frequent, which all candidates
    are. A null language is ``und``, a null or empty text has no words, rows that repeat count each; an empty table gives no
    rows; extra columns are ignored.
    """
    configure(docs.sparkSession)
    levels: dict[int, tuple[DataFrame, list[tuple]]] = {}
    table, first, sizes = None, None, None
    for n in (1, 2, 3):
        found = materialize(shards(docs, n, table, first), f"shards{n}")
        if n == 1:
            sizes = found.groupBy("lang").agg(F.sum("weight").alias("n"))
        counts, cuts = joined(found, least)
        levels[n] = materialize(counts, f"grams{n}"), cuts
        table = frequent(levels[n][0]) if n < 3 else None
        first = table if n == 1 else first
    every = materialize(candidates(levels, scale), "candidates")
    inner = every.where("words = 3").select("lang", F.explode(F.array("head", "tail")).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = every.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < covered * F.col("a")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]'), lambda w: w <> '') AS w FROM pieces),
g1 AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(w) AS p FROM words) GROUP BY ALL),
g2 AS (SELECT lang, w1, w2, count(*) AS f FROM (SELECT lang, w[i] AS w1, w[i + 1] AS w2 FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM words)) GROUP BY ALL),
g3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM words)) GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT g.lang, g.w1 || ' ' || g.w2 AS phrase, g.f AS a, 1 AS k, x.f AS l, y.f AS r FROM g2 g JOIN g1 x ON x.lang = g.lang AND x.p = g.w1 JOIN g1 y ON y.lang = g.lang AND y.p = g.w2 WHERE g.f >= 10
  UNION ALL
  SELECT g.lang, g.w1 || ' ' || g.w2 || ' ' || g.w3, g.f, 1, x.f, y.f FROM g3 g JOIN g1 x ON x.lang = g.lang AND x.p = g.w1 JOIN g2 y ON y.lang = g.lang AND y.w1 = g.w2 AND y.w2 = g.w3
  UNION ALL
  SELECT g.lang, g.w1 || ' ' || g.w2 || ' ' || g.w3, g.f, 2, x.f, y.f FROM g3 g JOIN g2 x ON x.lang = g.lang AND x.w1 = g.w1 AND x.w2 = g.w2 JOIN g1 y ON y.lang = g.lang AND y.p = g.w3),
scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM g3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM g3) GROUP BY ALL),
kept AS (SELECT c.* FROM lowest c LEFT JOIN longer o ON o.lang = c.lang AND o.phrase = c.phrase WHERE o.f IS NULL OR 100 * o.f < 50 * c.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r.r AS r, CAST(n AS BIGINT) AS n, score FROM ranked r JOIN (SELECT lang, sum(f) AS n FROM g1 GROUP BY lang) s ON s.lang = r.lang WHERE rank <= 2000
"""

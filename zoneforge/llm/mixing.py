"""Mixing sources to target weights in fixed-length blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zoneforge.llm.common import NULL_ID, configure, identified, lean, materialize, restored
from zoneforge.llm.words import SPACE, bounds, mix, raw, spread

#: Words of a block, blocks of an output shard, weights in turn, most repeats, seed of draws and permutations.
BLOCK, SHARD, WEIGHTS, REPEATS, SEED = 64, 1024, (5.0, 2.0, 1.0), 3, 20
#: Shards that are drawn together; sources that a mix may name (their shares are one row each, on the driver too).
CHUNK, SOURCES = 16, 1_000_000
ROUNDS = 4


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words outside ``[\\x20\\x09-\\x0D]``; null text: 0), digest of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw(batch.column(2))
            starts = ~SPACE[data]
            follows = np.empty(len(data), bool)
            if len(data):
                follows[0], follows[1:] = False, starts[:-1]
                follows[at[:-1][at[:-1] < len(data)]] = False
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spread(starts & ~follows, at)), batch.column(3)], ["doc_id", "source", "size", "digest"])

    rows = docs.select(identified(), F.col("source").cast("string"), F.col("text").cast("string"), F.xxhash64("text").alias("digest"))
    return rows.mapInArrow(run, "doc_id long, source string, size long, digest long")


def offsets(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, size, digest) and at: words of the source before the document, in order of doc_id.

    Rows are dealt by range of (source, doc_id), so a source of a third of all
    rows lies in many tasks; each sums its own, and only the sums of tasks meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, 0
        for batch in batches:
            source, size = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            at = []
            for s, n in zip(source, size, strict=True):
                if s != last:
                    last, done = s, 0
                at.append(done)
                done += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "inner_at"])

    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "source", "doc_id").withColumn("task", F.spark_partition_id()).sortWithinPartitions("source", "doc_id")
    schema = ranged.select("*", F.lit(0).cast("long").alias("inner_at")).schema
    local = materialize(ranged.mapInArrow(run, schema), "offsets")
    sums = local.groupBy("source", "task").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.select(F.col("source").alias("s"), F.col("task").alias("t"), F.coalesce(before, F.lit(0)).alias("base"))
    joined = local.join(base, (F.col("task") == F.col("t")) & F.col("source").eqNullSafe(F.col("s")))
    return joined.select("doc_id", "source", "size", "digest", (F.col("base") + F.col("inner_at")).alias("at"))


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target: weights share the sum of sizes, none above ``repeats`` times its size.

    Sources stand in code-point order, null last, and take ``weights`` in turn.
    With sources in order of size / weight, the first k are at their limit and
    the rest share what is left by weight: sums over one row a source decide k.
    """
    own = rows.groupBy("source").agg(F.sum("size").cast("double").alias("have"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    own = own.withColumn("turn", turn).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int")))
    whole, order = Window.partitionBy(F.lit(1)), Window.partitionBy(F.lit(1)).orderBy(F.col("have") / F.col("w"), "turn")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    limit = F.col("have") * repeats
    own = own.select("*", F.sum("have").over(whole).alias("all"), F.coalesce(F.sum(limit).over(upto), F.lit(0.0)).alias("used"), (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))).alias("left_w"))
    own = own.withColumn("share", (F.col("all") - F.col("used")) / F.col("left_w"))
    share = F.when(limit > F.col("share") * F.col("w"), F.col("share"))
    level = F.first(share, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return own.select("source", F.col("have").cast("long").alias("source_size"), F.least(limit, F.coalesce(F.col("w") * level, limit)).alias("target"))


def permute(index: np.ndarray, count: int, key: int, inverse: bool = False) -> np.ndarray:
    """``index`` under a pseudorandom permutation of range(count): a Feistel network that walks on from values beyond it."""
    half = np.uint64(max(1, (int(count - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    turn = lambda x, k: mix(x + np.uint64((key + k * 0x9E3779B97F4A7C15) % (1 << 64))) & mask
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            left, right = (right ^ turn(left, k), left) if inverse else (right, left ^ turn(right, k))
        out[todo] = left << half | right
        todo = todo[out[todo] >= count]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Share:
    """What the mix has of a source: its words, their blocks, slots, and the words of the last slot's block that are taken."""

    key: str
    words: int
    blocks: int
    slots: int
    last: int
    code: int

    @classmethod
    def of(cls, key: str, words: int, wanted: int, block: int, seed: int) -> Share:
        """The fewest slots that hold ``wanted`` words; the last gives no more of its block than is wanted."""
        code, blocks = xxhash.xxh64_intdigest(key.encode(), seed), -(-words // block)
        if not wanted:
            return cls(key, words, blocks, 0, 0, code)
        whole, rest = divmod(wanted, words)
        short = block * blocks - words
        at = int(permute(np.array([blocks - 1]), blocks, code, inverse=True)[0])
        have = lambda n: block * n - (short if at < n else 0)
        n = -(-rest // block)
        n += have(n) < rest
        slots = whole * blocks + n
        last = (slots - 1) % blocks
        return cls(key, words, blocks, slots, have(last + 1) - have(last) - (have(n) - rest), code)


def shares_of(rows: DataFrame, block: int, seed: int) -> tuple[DataFrame, list[Share]]:
    """(source_key, source_size, target) and the shares of the mix in order of source_key: one row a source, SOURCES at most."""
    named = targets(rows).withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    named = materialize(named, "shares")
    if named.count() > SOURCES:
        raise ValueError(f"a mix takes {SOURCES} sources at most; name groups of them")
    found = sorted(named.collect(), key=lambda r: r.source_key)
    return named, [Share.of(r.source_key, r.source_size, round(r.target), block, seed) for r in found if r.source_size]


def _draw(chunk: int, total: int, shard: int, odds: np.ndarray, seed: int) -> Iterator[tuple[int, np.ndarray, np.random.Generator]]:
    """(shard, slots of each source) of a chunk's shards: one multinomial draw over sources for each, seeded by the shard alone."""
    for k in range(chunk * CHUNK, min((chunk + 1) * CHUNK, -(-total // shard))):
        rng = np.random.default_rng((seed, k))
        yield k, rng.multinomial(min(shard, total - k * shard), odds), rng


def slots(spark: SparkSession, shares: list[Share], shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The mix, one row per slot: shard, slot (place in the shard), source_key, block, words (0: all of the block, else its first).

    Every shard has ``shard`` slots, the last what is left. A shard draws how many each source gets from one
    multinomial; a source's slots are numbered over all shards, by the sums of the chunks of shards before,
    and slot k is block ``permute(k mod blocks)``, so passes over a source follow one another and the
    times of its blocks differ by one at most. Draws give some sources more slots than
    they are due and others as many less: numbers from the due one on go, in
    order, to those that lack some. The draw is made twice, so no row for each shard and source is stored.
    """
    total, due = sum(s.slots for s in shares), np.array([s.slots for s in shares], np.int64)
    names = "shard long, slot int, source_key string, block long, words int"
    if not total:
        return spark.createDataFrame([], names)
    odds, chunks = due / total, -(-total // (shard * CHUNK))
    tasks = -(-chunks // 16)
    drawn = spark.range(0, chunks, 1, tasks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(c, sum(n for _, n, _ in _draw(c, total, shard, odds, seed))) for c in batch.column(0).to_pylist()]
            source = np.tile(np.arange(len(due), dtype=np.int32), len(found))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([c for c, _ in found], len(due))), pa.array(source), pa.array(np.concatenate([n for _, n in found]))], ["chunk", "source", "n"])

    counts = materialize(drawn.mapInArrow(count, "chunk long, source int, n long"), "draws")
    before = F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select("chunk", "source", F.coalesce(before, F.lit(0)).alias("first"))
    # few rows, each of many slots: as many tasks as the draw has, which adaptive execution would put together by bytes
    firsts = firsts.repartition(tasks, "chunk").groupBy("chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("source", "first"))), lambda x: x["first"]).alias("firsts"))
    got = np.zeros(len(due), np.int64)
    for source, n in counts.groupBy("source").agg(F.sum("n")).collect():
        got[source] = n
    over, lack = np.cumsum(np.maximum(got - due, 0)), np.cumsum(np.maximum(due - got, 0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = np.array(first, np.int64)
                for k, n, rng in _draw(chunk, total, shard, odds, seed):
                    source = np.repeat(np.arange(len(n)), n)
                    number = np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n) + at[source]
                    at += n
                    moved = np.flatnonzero(number >= due[source])
                    rank = number[moved] - due[source[moved]] + over[source[moved]] - np.maximum(got - due, 0)[source[moved]]
                    to = np.searchsorted(lack, rank, side="right")
                    source[moved], number[moved] = to, due[to] - (lack[to] - rank)
                    block, words = np.empty(len(source), np.int64), np.zeros(len(source), np.int32)
                    for i in np.unique(source).tolist():
                        own, share = np.flatnonzero(source == i), shares[i]
                        block[own] = permute(number[own] % share.blocks, share.blocks, share.code)
                        words[own[number[own] == share.slots - 1]] = share.last
                    keys = pa.DictionaryArray.from_arrays(pa.array(source.astype(np.int32)), pa.array([s.key for s in shares])).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(source), k)), pa.array(rng.permutation(len(source)).astype(np.int32)), keys, pa.array(block), pa.array(words)], ["shard", "slot", "source_key", "block", "words"])

    return firsts.mapInArrow(place, names)


def pieces(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents with source_size and target, their pieces: doc_id, digest, at, n, times, extra).

    Words of a source, in order of doc_id, are cut into blocks of ``block``; a
    piece is what a document has of one block, ``times`` how often the mix has all of it, ``extra``
    how many of its first words it has once more.
    """
    spark = configure(docs.sparkSession)
    rows = materialize(sizes(docs).groupBy("doc_id").agg(F.min(F.struct("source", "size", "digest")).alias("r")).select("doc_id", "r.*"), "sizes")
    placed = offsets(rows)
    known, shares = shares_of(rows, block, seed)
    times = slots(spark, shares, shard, seed).groupBy("source_key", "block").agg(F.count_if(F.col("words") == 0).alias("times"), F.max("words").alias("last"))
    placed = placed.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    small = len(shares) <= 100_000
    owned = placed.select("doc_id", "size", "source_key").join(F.broadcast(known) if small else known, "source_key")
    cut = placed.where("size > 0").select(
        "doc_id", "digest", "source_key", "at", "size",
        F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"),
    )
    low = F.greatest(F.col("block") * block, "at")
    cut = cut.select("doc_id", "digest", "source_key", "block", low.alias("low"), (low - F.col("at")).alias("at"), (F.least((F.col("block") + 1) * block, F.col("at") + F.col("size")) - low).alias("n"))
    extra = F.greatest(F.lit(0), F.least(F.col("n"), F.col("last") - (F.col("low") - F.col("block") * block)))
    # slots come from few rows, and Spark takes their number for that of the blocks, which grows with the words: without the hint it broadcasts them
    return owned, cut.hint("merge").join(times, ["source_key", "block"]).select("doc_id", "digest", "at", "n", "times", extra.alias("extra")).where("times > 0 or extra > 0")


def mix_documents(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    ``taken`` counts the words that the mix takes of the document, repeats
    included: at most 3 times its size, and over a source its target to the nearest whole word. Null or empty texts have size 0 and are never
    taken; a null source is a source of its own, the last. Of rows that
    repeat a doc_id one counts, the least by source, size and digest; a null doc_id is an id. An empty table gives no rows; extra columns are
    ignored; the same rows give the same mix however they are dealt out.
    """
    owned, cut = pieces(docs, block, shard, seed)
    taken = cut.groupBy("doc_id").agg(F.sum(F.col("n") * F.col("times") + F.col("extra")).alias("taken"))
    return restored(owned.join(taken, "doc_id", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mixed_texts(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """``docs``, with each text cut to what the mix takes of it; repeats follow as further passes.

    A document whose every piece is taken once stays as it is. Pieces of a pass
    that were neighbours keep the space between them; others, and passes, are parted by a
    newline. Documents of which nothing is taken go. n_chars, where it is a column, is counted anew. Of rows
    that repeat a doc_id the one that the mix counts stays. Null texts have nothing to take and go, extra columns stay as they are.
    """
    _, cut = pieces(docs, block, shard, seed)
    plan = cut.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_list(F.struct("at", "n", "times", "extra"))).alias("p"))
    plan = plan.select(F.col("doc_id").alias("_zf_doc"), F.col("digest").alias("_zf_digest"), F.col("p").alias("_zf_pieces"))
    own = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    joined = own.join(plan, (F.coalesce(own["doc_id"], F.lit(NULL_ID)) == F.col("_zf_doc")) & (F.xxhash64(own["text"].cast("string")) == F.col("_zf_digest")))
    joined = joined.dropDuplicates(["_zf_doc"]).select(*docs.columns, "_zf_pieces")
    place, schema = docs.columns.index("text"), own.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw(batch.column(place))
            first, end, doc = bounds(data, at)
            base, body = np.searchsorted(doc, np.arange(batch.num_rows + 1)).tolist(), data.tobytes()
            out = []
            for i, plan in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                passes = []
                for k in range(max(p["times"] + (p["extra"] > 0) for p in plan)):
                    spans: list[list[int]] = []
                    for p in plan:
                        n = p["n"] if p["times"] > k else p["extra"] if p["times"] == k else 0
                        if n and spans and spans[-1][1] == p["at"]:
                            spans[-1][1] += n
                        elif n:
                            spans.append([p["at"], p["at"] + n])
                    if spans == [[0, base[i + 1] - base[i]]]:
                        passes.append(body[at[i] : at[i + 1]])
                    else:
                        passes += [body[first[base[i] + a] : end[base[i] + b - 1]] for a, b in spans]
                out.append(b"\n".join(passes).decode("utf-8", "replace"))
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    mixed = joined.mapInArrow(lean(run), schema)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else mixed

"""Substring dedup by fixed-block anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneforge.llm.common import configure, gathered, materialize, restored, texts
from zoneforge.llm.words import BASE, OTHER_BASE, bounds, mix, raw, windows, word_hashes

#: Words of a window.
WINDOW = 35
#: Bytes of text whose windows a task sends at once; bytes of text to a task of the exchange, for a corpus of up to 1 GB; keys that a bucket sorts at once.
FLUSH, SHARE, SORTED = 2 << 20, 4 << 20, 1_000_000
SECOND_BASE = 0x94D049BB133111EB
_ROWS = "bucket int, docs binary, counts binary, keys binary, more binary, places binary, flags binary"
_NAMES = ["bucket", "docs", "counts", "keys", "more", "places", "flags"]
_PACKED = "grp int, docs binary, starts binary, lengths binary"
_RUNS = "doc_id long, starts binary, lengths binary"


def anchor(window: int) -> int:
    return (window + 1) // 2


def _runs(at: np.ndarray, doc: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Ascending positions as runs of neighbours: starts and lengths, and with ``doc`` each run's own."""
    step = np.ones(len(at), bool)
    step[1:] = np.diff(at) != 1
    if doc is not None:
        step[1:] |= doc[1:] != doc[:-1]
    new = np.flatnonzero(step)
    out = at[new], np.diff(np.concatenate([new, [len(at)]]))
    return out if doc is None else (*out, doc[new])


def _by_group(ids: np.ndarray, place: np.ndarray, groups: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Places in order of (id, place) as runs, packed by group of documents."""
    starts, lengths, owner = _runs(place, ids)
    group = (mix(owner.astype(np.int64).view(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(groups + 1))
    for g in np.flatnonzero(np.diff(cuts)).tolist():
        own = order[cuts[g] : cuts[g + 1]]
        yield g, _column(owner[own], 8), _column(starts[own], 4), _column(lengths[own], 4)


def _column(values: np.ndarray, width: int) -> bytes:
    """Little-endian numbers byte by byte of significance: what repeats lies together for the codec."""
    raw_bytes = np.ascontiguousarray(values).astype("<u8").view(np.uint8).reshape(-1, 8)
    return raw_bytes[:, :width].T.tobytes()


def _numbers(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def _send(ids: np.ndarray, doc: np.ndarray, place: np.ndarray, key: np.ndarray, more: np.ndarray | None, flag: np.ndarray, buckets: int, groups: int, width: int) -> Iterator[pa.RecordBatch]:
    """One packed row a bucket, and runs of places that the batch itself shows to repeat.

    A key that the batch holds often is sent once and flagged 2: each of its places is known as a repeat here already.
    """
    order = np.lexsort((more, key)) if more is not None else np.argsort(key, kind="stable")
    k, m = key[order], None if more is None else more[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) if m is None else (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(k)]]))
    flags = np.maximum.reduceat(flag[order], first) if len(first) else flag[:0]
    many = np.zeros(len(k), bool)
    many[order] = np.repeat(size > 1, size)
    own = np.flatnonzero(many)
    rows = [(-1 - g, docs, b"", b"", b"", starts, lengths) for g, docs, starts, lengths in _by_group(ids[doc[own]], place[own].astype(np.int64), groups)] if len(own) else []
    at = order[first]
    flags = flags | np.where(size > 1, 2, 0).astype(np.uint8)
    bucket = (key[at] >> np.uint64(20)) % np.uint64(buckets)
    by = np.lexsort((place[at], doc[at], bucket))
    at, flags, bucket = at[by], flags[by], bucket[by]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    for b in range(buckets):
        s = slice(cuts[b], cuts[b + 1])
        if s.start < s.stop:
            owners, count = np.unique(doc[at[s]], return_counts=True)
            rows.append(
                (b, _column(ids[owners], 8), count.astype("<u4").tobytes(), _column(key[at[s]], width), b"" if more is None else _column(more[at[s]], 8), _column(place[at[s]], 4), np.packbits(flags[s, None] >> np.array([0, 1], np.uint8) & 1).tobytes())
            )
    if rows:
        kinds = [pa.int32(), *[pa.binary()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)


def _answer(width: int, anchored: bool, groups: int):
    """What a bucket answers: places of keys that occur twice (and, if anchored, that a reference block has).

    A bucket is read as a stream. At every ``SORTED`` keys it is sorted, what is settled is answered and goes, and of
    each key one row stays, so a passage of a third of all documents is no more to hold than any other.
    Answers are packed by group of documents, so their number hangs on buckets and groups, not on documents.
    """
    kinds = [pa.int32(), *[pa.binary()] * 3]

    def packed(rows: list) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["grp", "docs", "starts", "lengths"])

    def settle(held: list[tuple[np.ndarray, ...]]) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
        """What is left to hold, and documents and places that are answered. Columns: key, more, document, place, times, reference, waits."""
        k, m, d, p, w, r, wait = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((m, k)) if m.any() else np.argsort(k, kind="stable")
        new = np.ones(len(k), bool)
        new[1:] = (k[order[1:]] != k[order[:-1]]) | (m[order[1:]] != m[order[:-1]])
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate([first, [len(k)]]))
        times, seen = np.add.reduceat(w[order], first), np.logical_or.reduceat(r[order], first)
        found = (times > 1) & seen if anchored else times > 1
        hit = order[np.repeat(found, size) & wait[order]]
        at = order[first]
        w, r = w.copy(), r.copy()
        alone = size == 1
        stays = order[np.repeat(~found & ~alone, size) & wait[order]]
        w[stays] = 0
        heads = (k[at], m[at], d[at], p[at], np.where(alone, w[at], np.minimum(times, 2)), seen, wait[at] & alone & ~found)
        return tuple(np.concatenate([a, b[stays]]) for a, b in zip(heads, (k, m, d, p, w, r, wait), strict=True)), d[hit], p[hit]

    def answers(d: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((p, d))
        return packed(list(_by_group(d[order], p[order].astype(np.int64), groups)))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = key[0].as_py()
        if own < 0:
            for batch in batches:
                yield packed([(-1 - own, *row) for row in zip(*(batch.column(c).to_pylist() for c in ("docs", "places", "flags")), strict=True)])
            return
        held: list[tuple[np.ndarray, ...]] = []
        have = kept = 0
        for batch in batches:
            for row in batch.to_pylist():
                k = _numbers(row["keys"], width)
                m = _numbers(row["more"], 8) if row["more"] else np.zeros(len(k), np.uint64)
                d = np.repeat(_numbers(row["docs"], 8).view(np.int64), np.frombuffer(row["counts"], "<u4"))
                flags = np.unpackbits(np.frombuffer(row["flags"], np.uint8))[: 2 * len(k)].reshape(-1, 2).astype(bool)
                held.append((k, m, d, _numbers(row["places"], 4), 1 + flags[:, 1].astype(np.int64), flags[:, 0], ~flags[:, 1]))
                have += len(k)
            if have - kept > SORTED:
                rest, d, p = settle(held)
                held, have, kept = [rest], len(rest[0]), len(rest[0])
                yield answers(d, p)
        if held:
            _, d, p = settle(held)
            yield answers(d, p)

    return run


def _gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Packed answers of a group of documents as one row a document."""
    doc = np.concatenate([_numbers(x, 8) for x in table["docs"].to_pylist()]).view(np.int64)
    starts, lengths = (np.concatenate([_numbers(x, 4) for x in table[c].to_pylist()]) for c in ("starts", "lengths"))
    order = np.argsort(doc, kind="stable")
    doc, starts, lengths = doc[order], starts[order].astype("<u4"), lengths[order].astype("<u4")
    cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    stop = [*cut[1:].tolist(), len(doc)]
    ranges = list(zip(cut.tolist(), stop, strict=True))
    return pa.table(
        [pa.array(doc[cut]), pa.array([starts[a:b].tobytes() for a, b in ranges], pa.binary()), pa.array([lengths[a:b].tobytes() for a, b in ranges], pa.binary())],
        ["doc_id", "starts", "lengths"],
    )


def _words(column: pa.Array, *bases: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (one for each base), document and place of each word, and the number of words from it to its document's end."""
    data, at = raw(column)
    first, end, doc = bounds(data, at)
    count = np.bincount(doc, minlength=len(column))
    start = np.cumsum(count) - count
    place = np.arange(len(doc)) - start[doc]
    return [word_hashes(data, first, end, base=base) for base in bases], doc, place, count[doc] - place


def _marked(starts: bytes, lengths: bytes, size: int) -> np.ndarray:
    """Positions below ``size`` that the runs cover."""
    step = np.zeros(size + 1, np.int64)
    s, n = np.frombuffer(starts, "<u4").astype(np.int64), np.frombuffer(lengths, "<u4").astype(np.int64)
    np.add.at(step, np.minimum(s, size), 1)
    np.add.at(step, np.minimum(s + n, size), -1)
    return np.cumsum(step[:size]) > 0


def _around(mark: np.ndarray, before: int, after: int) -> np.ndarray:
    """Positions from ``before`` below to ``after`` above a marked one."""
    at = np.flatnonzero(mark)
    step = np.zeros(len(mark) + 1, np.int64)
    np.add.at(step, np.maximum(at - before, 0), 1)
    np.add.at(step, np.minimum(at + after + 1, len(mark)), -1)
    return np.cumsum(step[:-1]) > 0


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, starts, lengths): runs of starts of windows of ``window`` words that occur more than once.

    Tasks and buckets of the exchange are as many as the bytes of the text ask for.

    1. Index: each document is cut into reference blocks of (window + 1) / 2
       words, side by side, so any window holds one whole. Probe: every rolling run of that
       length is looked up; block and probe meet by hash in a bucket. A
       probe that a block has, and that occurs twice, is a hit.
    2. Extend: the windows around hits, in either direction, are what a maximal repeat of
       ``window`` words or more can consist of. They meet in turn by 128 bits: two windows
       of 64 over hashes of the words that are independent of each other. Windows that
       occur twice, joined with their neighbours, are the maximal repeats.
    No pairs are made: a passage of a third of all documents is sent once a
    batch, and each place gets one answer.
    """
    configure(docs.sparkSession)
    rows, length = texts(docs), anchor(window)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // int(SHARE * max(1, total / 1e9) ** (1 / 3))))
    buckets = 2 * groups

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 1, FLUSH):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            (hashes,), doc, place, left = _words(batch.column(1), BASE)
            whole = np.flatnonzero(left >= length)
            if len(whole):
                keys = windows(hashes, length)[whole] >> np.uint64(16)
                yield from _send(ids, doc[whole], place[whole], keys, None, (place[whole] % length == 0).astype(np.uint8), buckets, groups, 6)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 1, FLUSH):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            (hashes, others), doc, place, left = _words(batch.column(1), BASE, OTHER_BASE)
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            wanted = np.zeros(len(doc), bool)
            for i, (starts, lengths) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                mark = _marked(starts, lengths, cut[i + 1] - cut[i])
                wanted[cut[i] : cut[i + 1]] = _around(mark, window - length, 0)
            whole = np.flatnonzero(wanted & (left >= window))
            if len(whole):
                keys, more = windows(hashes, window)[whole], windows(others, window, SECOND_BASE)[whole]
                yield from _send(ids, doc[whole], place[whole], keys, more, np.zeros(len(whole), np.uint8), buckets, groups, 8)

    def met(sent: DataFrame, answer) -> DataFrame:
        answered = sent.repartition(groups, "bucket").groupBy("bucket").applyInArrow(answer, _PACKED)
        return answered.repartition(groups, "grp").groupBy("grp").applyInArrow(_gather, _RUNS)

    hits = materialize(met(rows.mapInArrow(probe, _ROWS), _answer(6, True, groups)), "hits")
    near = hits.hint("merge").join(rows, "doc_id").select("doc_id", "text", "starts", "lengths")
    return materialize(met(near.mapInArrow(extend, _ROWS), _answer(8, False, groups)), "repeats")


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and the removed spans of words.

    Words are runs outside ``[\\x20\\x09-\\x0D]``. A word goes if a window of ``window`` words
    over it occurs anywhere else, in the same document or another; windows
    are judged on the input. Documents shorter than a window, null and empty texts keep all
    they have. Every copy goes, the first included. An empty table gives no rows; extra
    columns are ignored; rows that repeat a doc_id (a null one is an id, too) lose the words at the
    places that any of them loses.
    """
    found = repeats(docs, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw(batch.column(1))
            first, end, doc = bounds(data, at)
            body, edge = data.tobytes(), np.searchsorted(doc, np.arange(batch.num_rows + 1))
            total, gone, digests, spans = [], [], [], []
            for i, (starts, lengths) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                a, b = first[edge[i] : edge[i + 1]], end[edge[i] : edge[i + 1]]
                out = _around(_marked(starts, lengths, len(a)), 0, window - 1) if starts else np.zeros(len(a), bool)
                kept = ~out
                digests.append(hashlib.sha256(b" ".join([body[x:y] for x, y in zip(a[kept].tolist(), b[kept].tolist(), strict=True)])).hexdigest())
                total.append(len(a))
                gone.append(int(out.sum()))
                spans.append([{"start": int(s), "n": int(n)} for s, n in zip(*_runs(np.flatnonzero(out)), strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, kind)], ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])

    rows = texts(docs).hint("merge").join(found, "doc_id", "left").select("doc_id", "text", "starts", "lengths")
    return restored(rows.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,n:long>>"))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM s),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM d, range(35) r(j) WHERE n > 1),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS body, count(*) AS n FROM t ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

"""Aligning the tokens of two tokenizers by galloping intersection of where they end."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneforge.llm.common import configure, materialize, restored, texts
from zoneforge.llm.tokens import _byte_letters

#: Tokenizers of both sides: a tokenizers file (byte-level) and a sentencepiece model.
SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: The first side's vocabulary as ranks.
RANKS = "byte_bpe_50k.tiktoken"
#: Id pairs whose counts every task holds (20 bytes each); rarer ones beyond so many are joined.
HELD = 2_000_000
#: Characters of a text, and bytes of ids, that are aligned at a time; id pairs counted before they are sent on.
SEGMENT, TOGETHER, FLUSH = 1 << 20, 1 << 18, 1_000_000
#: Every so many searches begin at a guess, those between at what the one before them found.
STEP = 16


def gallop(values: np.ndarray, sorted_: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each value the first place in ``sorted_`` that holds as much or more; there must be one.

    Each search starts at its guess ``at``, strides away from it by 1, 2, 4, ... until the value is passed,
    and halves the last stride. All searches stride together, those that are done leave.
    """
    last = len(sorted_) - 1
    below = sorted_[at] < values
    low, high = np.where(below, at, -1), np.where(below, last, at)  # sorted_[low] < value <= sorted_[high]
    active, stride = np.arange(len(values)), 1
    while len(active):
        up = below[active]
        probe = np.where(up, np.minimum(low[active] + stride, last), np.maximum(high[active] - stride, 0))
        less = sorted_[probe] < values[active]
        low[active[less]] = probe[less]
        high[active[~less]] = probe[~less]
        # a search ends its strides when the probe falls on the other side of the value, or at the first place
        active = active[np.where(up, less, ~less & (probe > 0))]
        stride *= 2
    active = np.flatnonzero(high - low > 1)
    while len(active):
        middle = (low[active] + high[active]) >> 1
        less = sorted_[middle] < values[active]
        low[active[less]] = middle[less]
        high[active[~less]] = middle[~less]
        active = active[high[active] - low[active] > 1]
    return high


def _starts(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)])


def _flat(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (n of them), one after another."""
    at = _starts(n)
    return np.arange(at[-1]) + np.repeat(start - at[:-1], n)


def _before(at: np.ndarray, n: int) -> np.ndarray:
    """How many of ``at`` (ascending) are less than 0, 1, ..., n - 1."""
    marks = np.zeros(n + 1, np.int64)
    marks[at + 1] = 1
    return np.cumsum(marks)[:n]


def pair_bits(len_a: np.ndarray) -> int:
    """Bits of an id of a: what an id of b is shifted by in the key of a pair."""
    return max(1, (len(len_a) - 1).bit_length())


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0 to n - 1, left-aligned with room for a mark, and how many they are."""
    if n not in _shown:
        every = np.arange(n)
        digits = len(str(n - 1))
        length = 1 + sum((every >= 10**d).astype(np.int64) for d in range(1, digits))
        _shown[n] = np.stack([every // 10 ** np.maximum(length - 1 - d, 0) % 10 + 48 for d in range(digits + 1)], 1).astype(np.uint8), length
    return _shown[n]


_shown: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Aligned:
    """Token ids of some pieces of text by both sides, aligned.

    ``a`` and ``b`` are the ids of all pieces, ``n_a`` and ``n_b`` how many each piece has; lengths are bytes of
    tokens. Both sides of a piece cover the same bytes. The side with fewer tokens drives: each of its ends is searched among the ends of the
    other. Ends found are common and cut groups; the difference of two neighbours' ranks is the
    range of tokens that the one between overlaps.
    """

    def __init__(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray):
        shift = pair_bits(len_a)
        self.a, self.b, self.n, self.ids = a, b, len(n_a), max(len(len_a), len(len_b))
        self.at_a, self.at_b = _starts(n_a), _starts(n_b)
        # both sides have the same bytes, so running ends over all pieces can be compared
        ends_a, ends_b = np.cumsum(len_a[a], dtype=np.int64), np.cumsum(len_b[b], dtype=np.int64)
        own, other, links, piece = [], [], [], []
        for drives, (at, n, ends), (to_at, to_n, to_ends) in (
            (n_a <= n_b, (self.at_a, n_a, ends_a), (self.at_b, n_b, ends_b)),
            (n_a > n_b, (self.at_b, n_b, ends_b), (self.at_a, n_a, ends_a)),
        ):
            chosen = np.flatnonzero(drives & (n > 0))
            lane = _flat(at[:-1][chosen], n[chosen])
            if not len(lane):
                continue
            who = np.repeat(chosen, n[chosen])
            value = ends[lane]
            heads = slice(None, None, STEP)
            guess = to_at[who[heads]] + (lane[heads] - at[who[heads]]) * to_n[who[heads]] // n[who[heads]]
            near = np.repeat(gallop(value[heads], to_ends, guess), STEP)[: len(lane)]
            rank = gallop(value, to_ends, near)
            common = to_ends[rank] == value
            first = np.empty(len(lane), np.int64)
            first[1:] = (rank + common)[:-1]
            heads = _starts(n[chosen])[:-1]
            first[heads] = to_at[chosen]
            width = rank - first + 1
            mine, theirs = np.repeat(lane, width), _flat(first, width)
            by_a = n is n_a
            links.append((mine, theirs) if by_a else (theirs, mine))
            piece.append(np.repeat(who, width))
            hit = (lane[common], rank[common])
            own.append(hit[not by_a])
            other.append(hit[by_a])
        none = [np.zeros(0, np.int64)]
        self.common_a, self.common_b = np.sort(np.concatenate(own or none)), np.sort(np.concatenate(other or none))
        left, right = (np.concatenate([x[k] for x in links] or none) for k in (0, 1))
        #: One key for each linked pair of tokens, id of b above id of a, and its piece.
        self.keys = (b[right] << shift) | a[left]
        self.piece = np.concatenate(piece or none)
        self.n_links = np.bincount(self.piece, minlength=self.n)
        self.n_groups = np.diff(np.searchsorted(self.common_a, self.at_a))

    def groups(self) -> Iterator[tuple[int, int, int, int]]:
        """Ranges (from, to of ``a``; from, to of ``b``) of the groups, in order."""
        low = (0, 0)
        for high in zip((self.common_a + 1).tolist(), (self.common_b + 1).tolist(), strict=True):
            yield low[0], high[0], low[1], high[1]
            low = high

    def written(self) -> list[bytes]:
        """Each piece as ``a1,a2|b1;a3|b2,b3``: ids and marks are put in place all at once."""
        total = len(self.a) + len(self.b)
        if not total:
            return [b""] * self.n
        ids, marks = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
        place_a = np.arange(len(self.a)) + np.concatenate([[0], self.common_b + 1])[_before(self.common_a, len(self.a))]
        place_b = np.arange(len(self.b)) + (self.common_a + 1)[_before(self.common_b, len(self.b))]
        ids[place_a], ids[place_b] = self.a, self.b
        marks[place_a[self.common_a]], marks[place_b[self.common_b]] = ord("|"), ord(";")
        shown, length = _decimals(self.ids)
        cells, size = shown[ids], length[ids]
        cells[np.arange(total), size] = marks
        flat = cells[np.arange(cells.shape[1]) <= size[:, None]].tobytes()
        ends = _starts(size + 1)[self.at_a + self.at_b].tolist()
        return [flat[s : max(s, e - 1)] for s, e in zip(ends[:-1], ends[1:], strict=True)]


#: Bytes of a text that is cut into words: 0 in a word, 1 a space or line end, 2 what sends the text to the usual way.
_KIND = np.full(256, 2, np.uint8)
_KIND[0x21:0x7F] = _KIND[0x80:0xC0] = _KIND[0xC3:0xD4] = 0
_KIND[[0x20, 0x0A]] = 1


def regular(data: bytes) -> bool:
    """Whether words of a text (of Latin, Greek or Cyrillic letters, digits and marks) are parted by lone spaces and line ends."""
    kind = _KIND[np.frombuffer(data, np.uint8)]
    gaps = np.flatnonzero(kind)
    return not len(gaps) or bool(gaps[0] > 0 and gaps[-1] < len(data) - 1 and kind.max() == 1 and (np.diff(gaps) > 1).all())


class Sides:
    """Ids of both tokenizers for a text with a space before it, or nothing where either does not give back its bytes.

    The first side has two libraries for one vocabulary; the quicker one takes regular texts, for which both cut the same words. No token
    of either side begins before a lone space or line end and ends after it, so a long regular text is cut there.
    """

    def __init__(self, side_a: str = SIDE_A, side_b: str = SIDE_B, ranks: str | None = RANKS):
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.first = Tokenizer.from_file(public_tokenizers.path(side_a))
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(side_b))
        letters = {c: b for b, c in _byte_letters().items()}
        known = self.first.get_vocab(with_added_tokens=True)
        bytes_a = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        piece = lambda i: bytes([int(self.second.id_to_piece(i)[3:5], 16)]) if self.second.is_byte(i) else self.second.id_to_piece(i).replace("▁", " ").encode()
        bytes_b = [piece(i) for i in range(self.second.get_piece_size())]
        self.len_a, self.len_b = (np.array([len(x) for x in side], np.int64) for side in (bytes_a, bytes_b))
        self.bytes = [(np.frombuffer(b"".join(side), np.uint8), _starts(n)) for side, n in ((bytes_a, self.len_a), (bytes_b, self.len_b))]
        self.space = self.second.piece_to_id("▁")
        #: Struct and numpy codes of ids.
        self.kinds = tuple("H" if len(x) <= 1 << 16 else "I" for x in (bytes_a, bytes_b))
        self.quick = None
        if ranks:
            import tiktoken

            with open(public_tokenizers.path(ranks), "rb") as file:
                table = {base64.b64decode(x): int(i) for x, i in map(bytes.split, file)}
            self.quick = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def _gives_back(self, side: int, ids: np.ndarray, data: bytes) -> bool:
        """Whether the tokens' bytes, joined, are ``data``."""
        flat, at = self.bytes[side]
        ids = ids.astype(np.int64)
        n = at[ids + 1] - at[ids]
        return int(n.sum()) == len(data) and flat[_flat(at[ids], n)].tobytes() == data

    def _second(self, part: str) -> np.ndarray:
        """Ids of a part that begins with a space or line end. The model puts the mark of a space before every
        text: it stands for a space that is left out, and is dropped before a line end, where it is a token of its own."""
        ids = self.second.encode(part[1:] if part[0] == " " else part, num_threads=1)
        return np.array(ids if part[0] == " " else ids[1:] if ids[0] == self.space else [], f"<{self.kinds[1]}")

    def _usual(self, text: str, data: bytes) -> list[tuple[bytes, bytes]]:
        ids = (self.first.encode(" " + text, add_special_tokens=False).ids, self.second.encode(text, num_threads=1))
        found = [np.array(x, f"<{k}") for x, k in zip(ids, self.kinds, strict=True)]
        return [(found[0].tobytes(), found[1].tobytes())] if all(self._gives_back(k, found[k], data) for k in (0, 1)) else []

    def encode(self, text: str | None) -> list[tuple[bytes, bytes]]:
        """The text's ids in segments (a's, b's) of whole words; no segment for a text without tokens."""
        if not text:
            return []
        if self.quick is None or not regular(text.encode("utf-8", "surrogatepass")):
            return self._usual(text, (" " + text).encode("utf-8", "surrogatepass"))
        segments, at = [], 0
        while at < len(text):
            # a segment begins at the start, or at the space or line end before a word
            cut = [x for x in (text.find(c, at + SEGMENT) for c in " \n") if x > 0] if len(text) - at > SEGMENT else []
            end = min(cut, default=len(text))
            part = text[at:end] if at else " " + text[:end]
            a = np.array(self.quick.encode_ordinary(part), f"<{self.kinds[0]}")
            b = self._second(part)
            if not self._gives_back(1, b, part.encode()):
                return self._usual(text, (" " + text).encode())
            segments.append((a.tobytes(), b.tobytes()))
            at = end
        return segments


_made: dict[tuple[str, str], Sides] = {}


def sides(side_a: str, side_b: str) -> Sides:
    """The process's own, made once. Another first side than the default one goes without ranks."""
    if (side_a, side_b) not in _made:
        _made[side_a, side_b] = Sides(side_a, side_b, RANKS if side_a == SIDE_A else None)
    return _made[side_a, side_b]


def _aligned(both: Sides, parts: list[tuple[bytes, bytes]]) -> Aligned:
    kinds = [np.dtype(f"<{k}") for k in both.kinds]
    a, b = (np.frombuffer(b"".join([p[k] for p in parts]), kinds[k]).astype(np.int64) for k in (0, 1))
    n_a, n_b = (np.array([len(p[k]) // kinds[k].itemsize for p in parts], np.int64) for k in (0, 1))
    return Aligned(a, n_a, b, n_b, both.len_a, both.len_b)


def _some(parts: list[tuple[int, tuple[bytes, bytes]]], size: int = TOGETHER) -> Iterator[list[tuple[int, tuple[bytes, bytes]]]]:
    """Neighbouring parts until they have ``size`` bytes of ids."""
    held, have = [], 0
    for part in parts:
        held.append(part)
        have += len(part[1][0]) + len(part[1][1])
        if have >= size:
            yield held
            held, have = [], 0
    if held:
        yield held


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(keys, return_inverse=True)
    return found, np.bincount(where, n, len(found)).astype(np.int64)


def _packed(keys: np.ndarray, times: np.ndarray, bits: int) -> bytes:
    """Pairs in order and how often each: steps between keys and counts, byte by byte of all, which compresses well."""
    wide = "<u4" if bits <= 32 else "<u8"
    planes = [x.astype(wide).view(np.uint8).reshape(len(x), -1).T.tobytes() for x in (np.diff(keys, prepend=0), times)]
    return b"".join(planes)


def _unpacked(data: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    size = 4 if bits <= 32 else 8
    both = np.frombuffer(data, np.uint8).reshape(2, size, -1)
    step, times = (np.ascontiguousarray(x.T).view(f"<u{size}").ravel().astype(np.int64) for x in both)
    return np.cumsum(step), times


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_TOKENS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pair long, n long"


def tokens(docs: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B) -> DataFrame:
    """Of each document: counts, the digest of its groups, and its linked id pairs; and of each task, its id pairs with their counts.

    Texts are encoded once: this is one table, whose rows are either documents (``pair`` is null) or pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, seen, have = sides(side_a, side_b), [], 0
        bits = pair_bits(both.len_a) + pair_bits(both.len_b)
        schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("groups_sha256", pa.string()), ("links", pa.binary()), ("pair", pa.int64()), ("n", pa.int64())])

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _summed(*(np.concatenate(x) for x in zip(*seen, strict=True)))

        def pairs(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            empty = [pa.nulls(len(keys), f.type) for f in list(schema)[:-2]]
            return pa.RecordBatch.from_arrays([*empty, pa.array(keys), pa.array(n)], schema=schema)

        for batch in batches:
            found = [both.encode(text) for text in batch.column(1).to_pylist()]
            counts, digests = np.zeros((4, len(found)), np.int64), [hashlib.sha256() if x else None for x in found]
            links: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in found]
            for some in _some([(i, part) for i, parts in enumerate(found) for part in parts]):
                own, own_doc = _aligned(both, [p for _, p in some]), np.array([i for i, _ in some])
                for row, n in enumerate((np.diff(own.at_a), np.diff(own.at_b), own.n_groups, own.n_links)):
                    np.add.at(counts[row], own_doc, n)
                for (i, part), text in zip(some, own.written(), strict=True):
                    if part is not found[i][0]:
                        digests[i].update(b";")
                    digests[i].update(text)
                keys, times = np.unique((own.piece << bits) | own.keys, return_counts=True)
                edge = np.searchsorted(keys, np.arange(len(some) + 1) << bits).tolist()
                keys &= (1 << bits) - 1
                for (i, _), x, y in zip(some, edge[:-1], edge[1:], strict=True):
                    links[i].append((keys[x:y], times[x:y]))
                seen.append(_summed(keys, times))
                have += len(seen[-1][0])
                if have > 2 * FLUSH:
                    seen = [merged()]
                    have = len(seen[0][0])
                    if have > FLUSH:
                        yield pairs(*seen[0])
                        seen, have = [], 0
            packed = [_packed(*(x[0] if len(x) == 1 else _summed(*(np.concatenate(y) for y in zip(*x, strict=True)))), bits) if x else b"" for x in links]
            shas = pa.array(["" if d is None else d.hexdigest() for d in digests], pa.string())
            none = pa.nulls(len(found), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), shas, pa.array(packed, pa.binary()), none, none], schema=schema)
        if seen:
            yield pairs(*merged())

    return texts(docs).mapInArrow(run, _TOKENS)


def pair_counts(found: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B) -> DataFrame:
    """pair, n (links of the corpus that hold it), best (no pair of its id of b has more). Ids of b bound the table that is broadcast."""
    sums = materialize(found.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    id_b = F.shiftright("pair", pair_bits(sides(side_a, side_b).len_a))
    most = sums.groupBy(id_b.alias("b")).agg(F.max("n").alias("most"))
    return sums.join(F.broadcast(most), id_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(found: DataFrame, counts: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B, held: int = HELD) -> DataFrame:
    """Documents with n_best and count_sum over their links.

    Every task holds the counts of at most ``held`` pairs: all, if there are no more, or those of more than
    1/held of all links, of which there are fewer than ``held``. Links of other pairs go through a join, a row for a pair of a document.
    """
    spark, both = found.sparkSession, sides(side_a, side_b)
    bits = pair_bits(both.len_a) + pair_bits(both.len_b)
    total, n = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    all_held = n <= held
    own = counts if all_held else counts.where(F.col("n") > total / held)
    table = own.toArrow()
    order = np.argsort(table.column("pair").to_numpy())
    sent = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy(zero_copy_only=False)[order] for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, often, best = sent.value
        for batch in batches:
            own = [_unpacked(x, bits) for x in batch.column(0).to_pylist()]
            n = np.array([len(k) for k, _ in own], np.int64)
            keys, times = (np.concatenate([x[k] for x in own] or [np.zeros(0, np.int64)]) for k in (0, 1))
            doc = np.repeat(np.arange(len(own)), n)
            if len(pairs):
                at = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
                known = pairs[at] == keys
                value, top = np.where(known, often[at], 0), known & best[at]
            else:
                known = top = np.zeros(len(keys), bool)
                value = np.zeros(len(keys), np.int64)
            edge = _starts(n)
            sums = [np.diff(np.concatenate([[0], np.cumsum(x * times, dtype=np.int64)])[edge]) for x in (top, value)]
            kept = batch.columns[1:]
            none = [pa.nulls(len(own), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, sums), *none], names)
            if not all_held:
                left = np.flatnonzero(~known)
                none = [pa.nulls(len(left), c.type) for c in kept[1:]] + [pa.nulls(len(left), pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([kept[0].take(pa.array(doc[left])), *none, pa.array(keys[left]), pa.array(times[left])], names)

    columns = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    names = [*columns, "n_best", "count_sum", "pair", "times"]
    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names)
    out = found.where("pair IS NULL").select("links", *columns).mapInArrow(run, schema)
    if not all_held:
        out = materialize(out, "links")
        rare = out.where("pair IS NOT NULL").select("row", "pair", "times").join(counts.where(F.col("n") <= total / held), "pair")
        rare = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
        out = out.where("pair IS NULL").join(rare, "row", "left")
        out = out.withColumns({c: F.col(c) + F.coalesce(more, F.lit(0)) for c, more in (("n_best", "more_best"), ("count_sum", "more_sum"))})
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def align(docs: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B, held: int = HELD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document.

    A text, with a space before it, is encoded by both sides. Texts that are null, empty or not given back byte by
    byte have no tokens: zeros and an empty digest. One row for each row, also where a doc_id repeats or is null;
    an empty table gives no rows; extra columns are ignored. Strings of special tokens are plain text.
    """
    configure(docs.sparkSession)
    found = materialize(tokens(docs, side_a, side_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    return restored(scored(found, materialize(pair_counts(found, side_a, side_b), "counts"), side_a, side_b, held))

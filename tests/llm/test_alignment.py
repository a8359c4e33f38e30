"""Aligned tokens of two tokenizers against an alignment byte by byte."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from zoneforge.llm import alignment
from zoneforge.llm.tokens import _byte_letters

SCHEMA = "doc_id long, text string, lang string, pair long, row string, n long"
TEXTS = [
    None, "", " ", "\n", "a", "word", "two  spaces", " lead", "tail ", "tail\n", "a\nb c", "\na", "a\n\nb", "tab\there", "nbsp\xa0x", "don't it's WE'LL", "<|endoftext|>", "a <|endoftext|> b", "<s> </s><unk>", "▁ mark",
    "x▁y", "naïve façade œuvre Ångström", "日本語のテキスト 漢字", "😀 emoji 👩‍👩‍👧", "ﬁ ligature Ａ", "é combining", "null\x00byte \x01", "123456 7,8.90 $3", "http://x.example/?q=1&r=2#z", "ß" * 50, "the the the the", "  line", "x" * 300,
    "mixed\ncase Text, with: marks! and? (brackets) [more] {x}", "A\rB", "᠎ y", "a ­ b", "ends with space mark ▁", "ελληνικά και Русский текст, ąęłść", "× ÷ ±",
]
RNG = np.random.default_rng(13)
TEXTS += [" ".join(RNG.choice(["the", "alpha", "béta,", "don't", "ε.", "x1", "漢字", "over\nline", "(b)", "😀"], int(n))) for n in RNG.integers(1, 60, 25)]
TEXTS += [" ".join(RNG.choice(["the", "alpha", "béta,"], 4000)), "the alpha the", "the alpha the"]


def brute(texts):
    first = Tokenizer.from_file(public_tokenizers.path(alignment.SIDE_A))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.SIDE_B))
    back = {c: b for b, c in _byte_letters().items()}
    aligned = []
    for text in texts:
        ids_a, ids_b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        bytes_a = [bytes(back[c] for c in first.id_to_token(i)) for i in ids_a]
        pieces = [second.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces, strict=True)]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            aligned.append(None)
            continue
        owners = [[k for k, x in enumerate(side) for _ in x] for side in (bytes_a, bytes_b)]
        links = sorted(set(zip(*owners, strict=True)))
        ends = [set(np.cumsum([len(x) for x in side]).tolist()) for side in (bytes_a, bytes_b)]
        groups, low = [], 0
        for high in sorted(ends[0] & ends[1]):
            groups.append("|".join(",".join(str(ids[k]) for k in sorted(set(owner[low:high]))) for ids, owner in zip((ids_a, ids_b), owners, strict=True)))
            low = high
        aligned.append((len(ids_a), len(ids_b), groups, [(ids_a[i], ids_b[k]) for i, k in links]))
    counts = Counter(x for own in aligned if own for x in own[3])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for own in aligned:
        if own is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = own
            out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, t, None, 1, "r", 2) for i, t in enumerate(TEXTS)] + [(None, "the alpha", None, 1, "r", 2), (3, "the alpha", "en", 1, "r", 2)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def expected():
    ids = [*range(len(TEXTS)), None, 3]
    return sorted(((i, *r) for i, r in zip(ids, brute([*TEXTS, "the alpha", "the alpha"]), strict=True)), key=repr)


@pytest.mark.parametrize(("held", "segment"), [(alignment.HELD, alignment.SEGMENT), (40, 200), (1, 1)])
def test_alignment_is_brute_force(spark, table, expected, held, segment, monkeypatch):
    monkeypatch.setattr(alignment, "SEGMENT", segment)
    found = alignment.align(table, held=held)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected
    assert sum(r[1] > 0 for r in expected) > 40


def test_segments_of_long_texts(monkeypatch):
    both = alignment.Sides()
    text = TEXTS[-3].replace(" alpha the", "\nalpha the")
    whole = both.encode(text)
    monkeypatch.setattr(alignment, "SEGMENT", 500)
    parts = both.encode(text)
    assert len(parts) > 10 and tuple(b"".join(x) for x in zip(*parts, strict=True)) == whole[0]
    own = alignment._aligned(both, parts)
    assert b";".join(own.written()) == alignment._aligned(both, whole).written()[0]
    groups = list(own.groups())
    assert len(groups) == own.n_groups.sum() and groups[-1][1] == len(own.a) and groups[-1][3] == len(own.b)


def test_gallop_finds_first_not_below():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 1000):
        long = np.cumsum(rng.integers(1, 6, n))
        values = rng.integers(0, long[-1] + 1, 200)
        guess = rng.integers(0, n, 200)
        assert (alignment.gallop(values, long, guess) == np.searchsorted(long, values)).all()


def test_an_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA)).collect() == []

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from zoneforge.llm import bags, tokens
from zoneforge.llm.common import lean
from zoneforge.llm.tokens import Encoder
from zoneforge.llm.words import bounds, raw, windows, word_hashes

TEXTS = ["", None, " ", "a", "Hello  there\nyou", "x\n\ny", " lead", "trail ", "tab\tand nbsp", "ÉTÉ été straße", "don't we'll 123 a.b\n c", "<|endoftext|> x", "a\r\nb", "é ́x", "日本 語"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_tokenizer(name):
    encoder = Encoder(name)
    rng = np.random.default_rng(0)
    more = ["".join(rng.choice(list("ab é.'s\n 1"), 40)) for _ in range(300)]
    more += [" ".join("".join(rng.choice(list("thEanreöÀßÿ*.!|<>_^`~'5"), rng.integers(1, 9))) for _ in range(12)) for _ in range(400)]
    for got, text in zip(encoder.encode(TEXTS + more), TEXTS + more, strict=True):
        want = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, repr(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_are_those_of_a_fresh_tokenizer(name):
    texts = ["foo <|endoftext|> bar", "<|startoftext|>a b\nc<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|ENDOFTEXT|> z", "<|endoftext |> z", "plain words", *filter(None, TEXTS)]
    fresh = Tokenizer.from_file(public_tokenizers.path(name))
    for got, text in zip(Encoder(name).encode(texts), texts, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids, repr(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aé \n\t.x日", max_size=30), max_size=6))
def test_words_of_a_batch(texts):
    data, at = raw(pa.array(texts, pa.string()))
    first, end, doc = bounds(data, at)
    body = data.tobytes()
    got = [[body[a:b].decode() for a, b, d in zip(first, end, doc, strict=True) if d == i] for i in range(len(texts))]
    assert got == [t.split() for t in texts]
    hashes = word_hashes(data, first, end)
    seen = {}
    for h, w in zip(hashes.tolist(), [w for ws in got for w in ws], strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("length", [1, 2, 3, 5, 18, 35])
def test_windows_hash_runs(length):
    rng = np.random.default_rng(length)
    words = rng.integers(0, 3, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = windows(words, length)
    assert len(got) == len(words) - length + 1
    runs = [tuple(words[i : i + length].tolist()) for i in range(len(got))]
    assert len(set(runs)) == len(set(got.tolist())) == len(set(zip(runs, got.tolist(), strict=True)))


def test_features_of_a_batch_take_little_memory_and_come_in_order():
    """What a batch of 4 MB takes in between stays under 64 MB; pieces give what the texts give one by one."""
    texts = [f"word{k % 977} Other{k % 31} {'x' * (k % 40)} " * 60 for k in range(2200)] + [None, "", "a" * (3 << 20), ""]
    column = pa.array(texts, pa.string())
    bags.features(pa.array(["once"]))  # tables of powers stay
    tracemalloc.start()
    doc, feature = bags.features(column)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20 and (np.diff(doc << bags.FEATURE_BITS | feature) > 0).all()
    for k in (0, 7, 1500, 2199, 2200, 2201, 2202, 2203):
        assert bags.features(column.slice(k, 1))[1].tolist() == feature[doc == k].tolist()


def test_tasks_without_a_tokenizer_drop_those_of_earlier_ones(monkeypatch):
    monkeypatch.setattr(tokens, "_made", {"left": object()})
    assert list(lean(lambda batches: (len(tokens._made) for _ in batches))([1, 2])) == [0, 0]

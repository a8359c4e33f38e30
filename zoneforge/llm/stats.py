"""Statistics of whole texts, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from zoneforge.llm.words import SPACE, bounds, mix, raw, spread, windows, word_hashes

#: Words of a window of n_repeat_words.
REPEAT = 5
_BLANK = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_lines", "n_distinct")


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


_SYMBOLS, _DIGITS, _MARKS = _table("#*$%&|<>"), _table("0123456789"), _table("!?")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_START = np.ones(256, bool)
_START[0x80:0xC0] = False


def dup_lines(text: str | None) -> int:
    """Lines that hold a word and equal an earlier line."""
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text; null has none of anything."""
    n = len(column)
    data, at = raw(column)
    first, end, doc = bounds(data, at)
    hashes = word_hashes(data, first, end)
    total = np.bincount(doc, minlength=n)
    edge = np.concatenate([[0], np.cumsum(total)])
    left = edge[doc + 1] - np.arange(len(doc))
    salt = mix(doc.astype(np.uint64) + np.uint64(1))
    whole = np.flatnonzero(left >= REPEAT)
    keys = windows(hashes, REPEAT)[whole] ^ salt[whole] if len(whole) else np.zeros(0, np.uint64)
    _, where, often = np.unique(keys, return_inverse=True, return_counts=True)
    step = np.zeros(len(doc) + 1, np.int64)
    twice = whole[often[where] > 1] if len(whole) else whole
    np.add.at(step, twice, 1)
    np.add.at(step, twice + REPEAT, -1)
    distinct = np.unique(hashes ^ salt, return_index=True)[1] if len(doc) else np.zeros(0, np.int64)
    return {
        "n_words": total,
        "word_chars": spread(~SPACE[data] & _START[data], at),
        "n_symbols": spread(_SYMBOLS[data], at),
        "n_dup_lines": np.array([dup_lines(t) for t in column.to_pylist()], np.int64),
        "n_repeat_words": np.bincount(doc[np.cumsum(step[:-1]) > 0], minlength=n),
        "n_upper": spread(_UPPER[data], at),
        "n_digits": spread(_DIGITS[data], at),
        "n_marks": spread(_MARKS[data], at),
        "n_lines": spread(data == 0x0A, at) + (np.diff(at) > 0),
        "n_distinct": np.bincount(doc[distinct], minlength=n),
    }


#: Shares that rules and classifiers look at: name, count, what it is divided by.
SHARES = (
    ("symbol_share", "n_symbols", "n_words"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("upper_share", "n_upper", "word_chars"),
    ("digit_share", "n_digits", "word_chars"),
    ("mark_share", "n_marks", "n_words"),
    ("distinct_share", "n_distinct", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("word_length", "word_chars", "n_words"),
)

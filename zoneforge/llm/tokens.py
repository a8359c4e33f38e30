"""Ids of whole texts by public tokenizers, with a bounded memory of words."""

from __future__ import annotations

import os
import re
import struct

import numpy as np

#: Words whose ids are kept until there are more, and their most characters.
KEPT, LONGEST = 250_000, 64
#: Letters that normalisation leaves alone but for case, and punctuation without the apostrophe.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself if printable, else the next from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Little-endian 32-bit ids of texts: what ``Tokenizer.encode(text, add_special_tokens=False)`` gives.

    Neither tokenizer lets a token begin before a lone space or newline and end after it, so a
    text is cut there, and words seen before keep their ids. A new word of letters, or letters and then
    marks, goes to the tokenizer's model as the one or two pieces that its pre-tokenizer would make;
    any other is encoded in the usual way, and so is the whole of a text with
    other white space or runs of it, or with the string of an added token.
    """

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        #: Whether the tokenizer folds case and drops white space before it cuts words.
        self.folds = self.tokenizer.normalizer is not None
        self.simple = re.compile(f"([{_LETTERS}]+)([{_MARKS}]*)")
        self.letters = _byte_letters()
        self.newline = self._plain(["\n"])[0]
        self.pack = [struct.Struct(f"<{n}I").pack for n in range(4 * LONGEST)]
        #: Ids of pieces: words without their marks share one.
        self.pieces: dict[str, bytes] = {}
        self.head, self.after = _Words(self, ""), _Words(self, " ")

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            plain = piece if piece.isascii() and piece[0] != " " else piece.encode().decode("latin-1").translate(self.letters)
            found = [t.id for t in self.model.tokenize(plain)]
            ids = self.pieces[piece] = self.pack[len(found)](*found)
        return ids

    def learn(self, word: str, before: str) -> bytes | None:
        """Ids of a word at the head of a line or after a space; None for what makes its text odd."""
        if len(word) <= LONGEST:
            if word.isascii() and word.isalpha():
                return self._piece(before + (word.lower() if self.folds else word))
            m = self.simple.fullmatch(word)
            if m is not None:
                head, marks = m.groups()
                head = self._piece(before + (head.lower() if self.folds else head))
                return head + self._piece(marks) if marks else head
        return self._plain([before + word])[0] if word.split() == [word] else None

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out, head, after, newline = [], self.head, self.after, self.newline
        for text in texts:
            try:
                if not text:
                    out.append(b"")
                elif any(token in text for token in self.added):
                    out.append(self._plain([text])[0])
                elif self.folds:
                    out.append(b"".join(map(head.__getitem__, text.replace("\n", " ").split(" "))))
                else:
                    lines = [line.split(" ") for line in text.split("\n")]
                    out.append(newline.join([b"".join([head[words[0]], *map(after.__getitem__, words[1:])]) for words in lines]))
            except TypeError:
                out.append(self._plain([text])[0])
            for known in (head, after, self.pieces):
                if len(known) > KEPT:
                    known.clear()
        return out


class _Words(dict):
    """Ids of words; one that is missing is learned."""

    def __init__(self, owner: Encoder, before: str):
        super().__init__()
        self.owner, self.before = owner, before

    def __missing__(self, word: str) -> bytes | None:
        ids = self.owner.learn(word, self.before)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids


_made: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The process's own encoder: a Python worker that runs many tasks loads a tokenizer once."""
    if name not in _made:
        _made[name] = Encoder(name)
    return _made[name]


def forget() -> None:
    """Drop the process's encoders and their words, for tasks of a worker that encoded before and now does other work."""
    _made.clear()

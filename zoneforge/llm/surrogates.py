"""Personal data replaced by keyed surrogates of the same kind and form."""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zoneforge.llm.common import configure, materialize, restored, sized_lookup, texts

#: Setting that has the key, as text. Whoever has the key can tell which surrogate a value gets, so there is none in the code.
KEY_SETTING = "zoneforge.surrogates.key"

#: Country codes of two digits; 1 and 7 have one, all others three; fixed values.
TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: What secrets begin with that says whose they are; fixed values.
MARKS = re.compile("AKIA|gh[pousr]_|sk-")
#: Titles by gender; fixed values.
FEMALE = frozenset("Mrs Ms Miss Frau Madame Mme Señora Sra Госпожа".split())
#: Given names by script and gender; fixed values of our own choosing.
GIVEN = {
    ("latin", "f"): "Alma Berta Clara Dora Elsa Flora Greta Hilda Irma Julia Klara Lena Mara Nora Olga Paula Rita Sara Thea Vera".split(),
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jakob Karl Leo Martin Nils Oskar Paul Rolf Simon Tom Viktor".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Инна Клара Лидия Мария Нина Ольга Полина Рита София".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Семён".split(),
}
#: Given names by gender that show a person without a title before a capital word; fixed values of our own choosing.
KNOWN = {
    "f": "Alice Anna Barbara Carol Charlotte Chloe Claire Diana Elena Elizabeth Emily Emma Eva Hannah Helen Jane Jennifer Jessica Julia Karen Laura Linda Lisa Maria Marie Mary Michelle Nancy Olivia Patricia Rachel Rebecca Sarah Sophie Susan".split(),
    "m": "Adam Alexander Andrew Anthony Antonio Benjamin Charles Christopher Daniel David Edward Eric Francisco Frank George Hans Henry Jack James Jason John Jonathan José Joseph Juan Kevin Klaus Lucas Martin Matthew Michael Nicholas Patrick Paul Peter Pierre Richard Robert Ryan Samuel Stephen Steven Thomas Timothy William".split(),
}

#: Kinds and patterns, in order of precedence.
PATTERNS = (
    ("email", r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("secret", r"(?i:(?:token|secret|api_?key|password|passwd)\s*[=:]\s*[\"']?)(?P<secret>[A-Za-z0-9_\-./+]{12,})|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}|\bsk-[A-Za-z0-9]{20,}"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ip", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?<![\w-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])"),
    ("phone", r"(?<![\w])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,11}(?!\w)|(?<![\w])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"),
    ("ipv6", r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:.])"),
    ("birth", r"(?i:\b(?:dob|date of birth|birth ?date|born(?: on)?|geboren(?: am)?|née? le)\s*[:=]?\s*)(?P<date>\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?!\w)"),
    ("address", r"\b\d{1,5} (?:[A-Z][a-z]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square)\b"),
    ("person", r"\b(?P<title>Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Господин|Госпожа)\.? (?P<name>[^\W\d_a-zа-я]\w+(?:[ -][^\W\d_a-zа-я]\w+){0,2})"),
    ("named", rf"\b(?P<first>{'|'.join(sorted({*' '.join(map(' '.join, KNOWN.values())).split()}))}) (?P<last>[A-Z][a-z]+(?:-[A-Z][a-z]+)?)\b"),
)
_COMPILED = {kind: re.compile(body) for kind, body in PATTERNS}
_DIGIT = re.compile(r"\d")
#: What a text must hold for a kind to be looked for at all, where that isn't a digit: every match of the kind's pattern has one.
_CUES = {
    "email": re.compile("@"),
    "secret": re.compile(r"(?i:token|secret|api_?key|passw)|AKIA|gh[pousr]_|sk-"),
    "ipv6": re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f:]"),
    "named": re.compile("|".join(sorted({x[:3] for names in KNOWN.values() for x in names}))),
    "person": re.compile("M(?:r|s|iss|onsieur|adame|me)|Herr|Frau|Señor|Sr|Господин|Госпожа"),
}

#: Syllables of family names by script; fixed values of our own choosing.
SYLLABLES = {"latin": "ba be bo da de do fa fe ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo".split(), "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва ве во".split()}


class Stream:
    """Keyed pseudorandom numbers that hang on a kind, a value and an attempt alone."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.state, self.left = hmac.new(key, f"{kind}\0{value}\0{attempt}".encode(), hashlib.sha256).digest(), b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.state = hashlib.sha256(self.state).digest()
            self.left = self.state
        out, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return out % n


#: Draws of a value before its surrogates grow.
PATIENCE = 3


def _script(c: str) -> tuple[str, str]:
    """Script, by the name's first word, and class of a letter."""
    return unicodedata.name(c, "").split(" ")[0].split("-")[0], unicodedata.category(c)


@cache
def _alphabets() -> dict[tuple[str, str], list[str]]:
    """Letters by script and class; of small ones those that survive capitals and back."""
    out = defaultdict(list)
    for c in map(chr, range(0x80, 0x20000)):
        if c.isalpha() and (not c.islower() or len(c.upper()) == 1 and c.casefold() == c == c.upper().casefold()):
            out[_script(c)].append(c)
    return out


def _shift(text: str, s: Stream) -> str:
    """Each digit and letter becomes another of its class and script; the rest stays."""
    out = []
    for c in text:
        if c.isdigit() and c.isascii():
            out.append(str(s.below(10)))
        elif c.isascii() and c.isalpha():
            out.append(chr((0x41 if c.isupper() else 0x61) + s.below(26)))
        elif c.isdecimal():
            out.append(chr(ord(c) - unicodedata.decimal(c) + s.below(10)))
        elif "а" <= c.lower() <= "я" or c in "ёЁ":
            d = chr(0x430 + s.below(32))
            out.append(d.upper() if c.isupper() else d)
        elif c.isalpha():
            script = _script(c)
            letters = _alphabets().get(script) if script[0] != "LATIN" else None
            if letters:
                out.append(letters[s.below(len(letters))])
            else:
                out.append(chr((0x41 if c.isupper() else 0x61) + s.below(26)))
        else:
            out.append(c)
    return "".join(out)


def _drawn(text: str, s: Stream, attempt: int) -> str:
    """A shifted text; letters if it has nothing to shift. After some attempts it grows by one like its last at each."""
    if not any(c.isalpha() or c.isdecimal() for c in text):
        text = "a" * len(text)
    last = next(c for c in reversed(text) if c.isalpha() or c.isdecimal()) if text else ""
    return _shift(text + last * max(0, attempt - PATIENCE + 1), s)


def luhn(digits: str) -> int:
    total = sum(x if i % 2 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(map(int, reversed(digits))))
    return -total % 10


def mod97(iban: str) -> int:
    """Remainder that is 1 for a right IBAN."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def canonical(kind: str, text: str) -> str:
    """What mentions of one entity share: letters folded, digits without their spacing; a name part carries gender and script."""
    if kind in ("phone", "card", "ssn"):
        return ("+" if text[0] == "+" else "") + re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    return text if kind in ("secret", "birth") else text.casefold()


def _phone(value: str, s: Stream, attempt: int) -> str:
    """The country code, if there is one, stays."""
    if value[0] != "+":
        return _drawn(value, s, attempt)
    code = "".join(str(unicodedata.decimal(c)) for c in value[1:4])
    n = 1 + (1 if code[0] in "17" else 2 if code[:2] in TWO_DIGITS else 3)
    return value[:n] + _drawn(value[n:], s, attempt)


def _iban(value: str, s: Stream, attempt: int) -> str:
    """Country stays; check digits are right if the value's are."""
    rest = _drawn(value[4:], s, attempt)
    plain = value.isascii() and mod97(value) == 1
    return value[:2] + (f"{98 - mod97(value[:2] + '00' + rest):02d}" if plain else _drawn(value[2:4], s, 0)) + rest


def _date(value: str, s: Stream, attempt: int) -> str:
    """A date in the value's form: a year near its own (any after some attempts), day and month that do in either order."""
    parts = re.split(r"\D", value)
    year = max(parts, key=len)
    near = int(year) - 5 + s.below(11) if attempt < PATIENCE else 1 + s.below(9999)
    out = [f"{max(1, near):04d}" if x is year else str(1 + s.below(12)).zfill(len(x)) for x in parts]
    mark = next(c for c in value if not c.isdecimal())
    return mark.join(out)


def _address(value: str, s: Stream, attempt: int) -> str:
    """Another number and invented names of as many words; what kind of street it is stays."""
    number, *words, last = value.split(" ")
    syllables = SYLLABLES["latin"]
    invented = ["".join(syllables[s.below(len(syllables))] for _ in range(3 + attempt)) for _ in words]
    return " ".join([str(1 + s.below(10 ** min(5, len(number)) - 1)), *invented, last])


def _ipv6(value: str, s: Stream, attempt: int) -> str:
    """Other hex digits; after some attempts each group has one more, up to 4, and behind the gap stand more groups, up to 7 in all."""
    more = max(0, attempt - PATIENCE + 1)
    left, gap, right = value.partition("::")
    groups = [side.split(":") if side else [] for side in (left, right)]
    if gap:
        groups[1] += ["0"] * min(more, 7 - len(groups[0]) - len(groups[1]))
    drawn = ["".join("0123456789abcdef"[s.below(16)] for _ in range(min(4, len(g) + more))) for side in groups for g in side]
    return ":".join(drawn[: len(groups[0])]) + gap + ":".join(drawn[len(groups[0]) :])


def surrogate(kind: str, value: str, attempt: int, key: bytes) -> str:
    """The canonical surrogate of a canonical value: same kind, length of digits, script and gender.

    From the attempt ``PATIENCE`` on surrogates are longer with each attempt, or a secret is all
    letters, so that each value settles; but an IPv4 address, which has 254^4 draws.
    """
    s = Stream(key, kind, value, attempt)
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        return _drawn(local, s, attempt) + "@" + ".".join([*(_shift(x, s) for x in labels[:-2]), labels[-2] if labels[-2] == "example" else _shift(labels[-2], s), labels[-1]])
    if kind == "ip":
        zero = ord(value[0]) - int(value[0])
        return ".".join("".join(chr(zero + int(x)) for x in str(s.below(254) + 1)) for _ in range(4))
    if kind == "card":
        head = _drawn(value[:-1], s, attempt)
        last = luhn(head) if luhn(value[:-1]) == int(value[-1]) else s.below(10)
        return head + chr(ord(value[-1]) - int(value[-1]) + last)
    if kind in ("phone", "iban", "birth", "address"):
        return {"phone": _phone, "iban": _iban, "birth": _date, "address": _address}[kind](value, s, attempt)
    if kind == "ipv6":
        return _ipv6(value, s, attempt)
    if kind.startswith(("given:other", "family:other")):
        return _drawn(value, s, attempt)
    if kind.startswith("given"):
        _, script, gender = kind.split(":")
        names = GIVEN[script, gender]
        return names[s.below(len(names))].casefold() + "".join(SYLLABLES[script][s.below(32)] for _ in range(attempt))
    if kind.startswith("family"):
        syllables = SYLLABLES[kind.split(":")[1]]
        return "".join(syllables[s.below(len(syllables))] for _ in range(3 + attempt))
    if kind == "secret" and re.fullmatch("[0-9a-f]+", value):
        return "".join("0123456789abcdef"[s.below(16)] for _ in value)
    if kind == "secret" and (mark := MARKS.match(value)):
        return mark[0] + _drawn(value[mark.end() :], s, attempt)
    if kind == "secret":
        return _drawn(value, s, 0) if attempt < PATIENCE else _shift("a" * len(value), s)
    return _drawn(value, s, attempt)


def _like(pattern: str, digits: str) -> str:
    """The digits (or letters) in the spacing of a mention; those that it has no room for follow."""
    rest = iter(digits.removeprefix("+"))
    return "".join(next(rest, "") if c.isalnum() else c for c in pattern) + "".join(rest)


def _name_parts(gender: str, name: str) -> list[tuple[str, str]]:
    parts = name.split(" ")
    script = "cyrillic" if re.search("[а-яА-ЯёЁ]", name) else "latin" if any(c.isalpha() and _script(c)[0] == "LATIN" for c in name) else "other"
    kinds = [f"given:{script}:{gender}"] * (len(parts) - 1) + [f"family:{script}"]
    return list(zip(kinds, parts, strict=True))


def _valid(kind: str, m: re.Match) -> bool:
    """What a pattern can't say: numbers of an address, check digits of a card, a name's capital, a birth date's fields."""
    if kind == "ip":
        return all(int(x) <= 255 for x in m[0].split("."))
    if kind == "card":
        digits = re.sub(r"\D", "", m[0])
        return luhn(digits[:-1]) == int(digits[-1])
    return kind != "person" or not m["name"][0].islower()


def _search(kind: str, text: str, at: int) -> re.Match | None:
    """The first match from ``at`` on that is valid; what an invalid one covers is looked at again."""
    while m := _COMPILED[kind].search(text, at):
        if _valid(kind, m):
            return m
        at = m.start() + 1
    return None


def mentions(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, mention) of each entity, left to right; a person's name gives one for each part.

    Each kind's pattern runs only over texts that hold its cue; of matches that
    overlap the first stands, of those that begin together the kind listed first, and the others are looked for behind it.
    """
    digits, waiting = _DIGIT.search(text), []
    for order, kind in enumerate(_COMPILED):
        cue = _CUES.get(kind)
        if (cue.search(text) if cue else digits) and (m := _search(kind, text, 0)):
            waiting.append((m.start(), order, kind, m))
    while waiting:
        _, _, kind, m = min(waiting, key=lambda x: x[:2])
        if kind in ("person", "named"):
            if kind == "person":
                at, parts = m.start("name"), m["name"].split(" ")
                n = next((i for i, part in enumerate(parts) if part[0].islower()), len(parts))
                name, gender = " ".join(parts[:n]), "f" if m["title"] in FEMALE else "m"
            else:
                at, name, gender = m.start(), m[0], "f" if m["first"] in KNOWN["f"] else "m"
            for part_kind, part in _name_parts(gender, name):
                yield at, at + len(part), part_kind, part
                at += len(part) + 1
            end = at - 1
        else:
            group = "secret" if kind == "secret" and m["secret"] is not None else "date" if kind == "birth" else 0
            yield m.start(group), m.end(group), kind, m[group]
            end = m.end()
        again = [x for x in waiting if x[0] < end]
        waiting = [x for x in waiting if x[0] >= end]
        for _, order, other, _ in again:
            if found := _search(other, text, end):
                waiting.append((found.start(), order, other, found))


def render(kind: str, mention: str, value: str) -> str:
    """A canonical surrogate in the form of the mention: its spacing, its capitals."""
    if kind in ("phone", "card", "ssn", "iban"):
        return _like(mention, value)
    if kind.startswith(("given", "family")):
        return value.upper() if mention.isupper() and len(mention) > 1 else "-".join(x.capitalize() for x in value.split("-"))
    if kind == "address":
        return " ".join(x if x.isdecimal() else x.capitalize() for x in value.split(" "))
    if kind == "ipv6":
        return value.upper() if mention.isupper() else value
    if kind == "email" and mention != mention.casefold():
        return value.upper() if mention.isupper() else "".join(a.upper() if b.isupper() else a for a, b in zip(value, mention.ljust(len(value)), strict=False))
    return value


def replaced(text: str, spans: list[dict], mapping: dict[tuple[str, str], str]) -> str:
    """``text`` with each span (start, end, kind, value) in the form of its mention."""
    out, last = [], 0
    for x in spans:
        out += [text[last : x["start"]], render(x["kind"], text[x["start"] : x["end"]], mapping[x["kind"], x["value"]])]
        last = x["end"]
    return "".join([*out, text[last:]])


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value): no two of a kind share a
    surrogate, and none is a value that the corpus has.

    All take their first draw; those that collide draw again, but for the least value
    among equals; checks are joins over the entities, in rounds until none collides.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            found = [surrogate(k, v, a, key) for k, v, a in zip(frame["kind"], frame["value"], frame["attempt"], strict=True)]
            yield frame.assign(surrogate=found)[["kind", "value", "attempt", "surrogate"]]

    schema = "kind string, value string, attempt int, surrogate string"
    originals = entities.select("kind", F.col("value").alias("surrogate"))
    todo, done = entities.select("kind", "value", F.lit(0).alias("attempt")), None
    while True:
        drawn = materialize(todo.mapInPandas(draw, schema), "drawn")
        free = drawn.join(originals, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        first = free.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        settled = materialize(first.select("kind", "value", "surrogate"), "settled")
        done = settled if done is None else done.unionByName(settled)
        todo = drawn.join(settled, ["kind", "value"], "left_anti").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        todo = materialize(todo.repartition("kind", "value"), "again")
        if todo.isEmpty():
            return done


def anonymize(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """One row per document: doc_id, n_entities, text with every detected entity replaced.

    The same entity has the same surrogate in every document and form (spacing, capitals),
    different ones have different ones. Draws hang on ``key``, or the setting KEY_SETTING; without
    either a key is drawn for this call and kept nowhere, so that nobody can draw again. Documents without
    entities pass as they are and are never shuffled; those with some travel once. A null text stays null; an empty
    one empty. An empty table gives no rows; extra columns are ignored; repeated rows are each kept, so are those of a null doc_id.
    """
    spark = configure(docs.sparkSession)
    setting = spark.conf.get(KEY_SETTING, None)
    key = key or (setting.encode() if setting else secrets.token_bytes(32))
    rows = texts(docs)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([t is None or next(mentions(t), None) is None for t in batch.column(1).to_pylist()], pa.bool_())
            yield batch.filter(keep)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
        for batch in batches:
            ids, bodies, spans = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = [{"start": a, "end": b, "kind": k, "value": canonical(k, m)} for a, b, k, m in mentions(text)] if text else []
                if own:
                    ids.append(doc)
                    bodies.append(text)
                    spans.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies, pa.string()), pa.array(spans, kind)], ["doc_id", "text", "spans"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans, own in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                out.append(replaced(text, spans, {(x["kind"], x["value"]): x["surrogate"] for x in own}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in batch.column(2).to_pylist()], pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_entities", "text"])

    own = materialize(rows.mapInArrow(found, "doc_id long, text string, spans array<struct<start:int,end:int,kind:string,value:string>>"), "mentions")
    each = own.select("doc_id", F.explode("spans").alias("e")).select("doc_id", F.struct("e.kind", "e.value").alias("entity"))
    each = materialize(each.distinct(), "each")
    sizes = materialize(each.groupBy("entity").agg(F.count(F.lit(1)).alias("n")), "entities")
    mapping = assign(sizes.select("entity.kind", "entity.value"), key).select(F.struct("kind", "value").alias("entity"), "surrogate")
    known = materialize(sizes.join(mapping, "entity"), "mapping")
    per_doc = sized_lookup(each, known, "entity", "n", max(1, each.count()))
    per_doc = per_doc.groupBy("doc_id").agg(F.collect_list(F.struct("entity.kind", "entity.value", "surrogate")).alias("surrogates"))
    changed = own.join(per_doc, "doc_id").select("doc_id", "text", "spans", "surrogates").mapInArrow(put, "doc_id long, n_entities long, text string")
    same = rows.mapInArrow(clean, "doc_id long, text string").select("doc_id", F.lit(0).cast("long").alias("n_entities"), "text")
    return restored(changed.unionByName(same))

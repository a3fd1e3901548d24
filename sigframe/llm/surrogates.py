"""Keyed surrogates for personal data.

Detected entities (mail addresses, phone numbers, IPv4 addresses, card or account
numbers, person names) are replaced by values of the same type. A surrogate is a keyed
permutation of the entity within its format: letters become letters, digits digits,
vowels vowels of the same script, so length, punctuation, script and letter case stay;
card numbers keep their check digit right, given names come from the list of the same
gender and script. The same entity gets the same surrogate wherever and however it is
written, and a permutation cannot give two entities of one format the same value.

What a permutation cannot rule out is checked over the whole table: a surrogate that is
its own or any other detected entity, or that two entities share after such a
change, is drawn again with the next attempt number until none is left.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigframe.llm.common import cut, fresh, text_slices

# Attempts beyond this lengthen names and mail addresses, whose formats can run out.
LENGTHEN_AFTER = 6
# Entities that still collide after so many become marks in brackets, 128 keyed bits that tell them apart.
MAX_ATTEMPTS = 60
ROUNDS = 6

# Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Mary Anna Maria Emma Sophie Julia Laura Sarah Elena Clara Alice Helen Marie Lucia Carmen Ingrid Nora Ruth Susan Linda".split(),
    ("latin", "m"): "John James Peter Paul Thomas Michael David Robert Daniel Carlos Jean Hans Karl Pierre Miguel Anton Henry George Simon Martin".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Юлия Екатерина".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Андрей Алексей Дмитрий Николай Михаил Павел Владимир".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ειρήνη".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Παύλος Ανδρέας".split(),
}
# Titles before a name.
TITLES = "Mr Mrs Ms Miss Dr Prof Sir Herr Frau Señor Señora Sra Monsieur Madame Mme господин госпожа г-н г-жа κύριος κυρία".split()
# Letters that replace one another, by script.
LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûüýÿāēīōūăąęėįőűůœ", "çñðþćčďđěğłńňřśšşťţźżž",
           "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщ", "іїєў", "ґђћљњџ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώϊϋ")
_RING = {c: ring for ring in LETTERS for c in ring}

_CAP = r"[A-ZÀ-ÖØ-ÞĀ-ſА-ЯЁІЇЄЎҐЂЋЉЊЏΑ-ΩΆΈΉΊΌΎΏ][a-zß-öø-ÿā-ſа-яёіїєўґђћљњџα-ωάέήίόύώϊϋ]+"
_GIVEN_OF = {name.lower(): group for group, names in GIVEN.items() for name in names}
_FIRST = "|".join(sorted((n for names in GIVEN.values() for n in names), key=len, reverse=True))
_TITLE = "|".join(re.escape(t) for t in sorted(TITLES, key=len, reverse=True))
MAIL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
IPV4 = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)")
CARD = re.compile(r"(?<![\d.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\d.]?\d)")
PHONE = re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,5}){1,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}(?P<sep>[-.])\d{3}(?P=sep)\d{4}(?![\w-]|\.\d)")
SSN = re.compile(r"(?<![\w.-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-]|\.\d)")
# Words before a full name whose given name is on no list.
CONTEXT = re.compile(rf"(?<!\w)(?:[Mm]y name is|[Ss]igned by|Full name:|Name:) (?P<c1>{_CAP}) (?P<c2>{_CAP})(?!\w)")
NAME = re.compile(rf"(?<!\w)(?:(?:{_TITLE})\.? (?:(?P<g1>{_FIRST}) )?(?P<s1>{_CAP})|(?P<g2>{_FIRST}) (?P<s2>{_CAP}))(?!\w)")
_DIGIT = re.compile(r"\d")


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = sum(sum(divmod(int(d) * 2, 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of the entities of a text, by place, without overlap.

    Where two overlap the one that starts first stays, then the longer. A surname found
    once is found again wherever it stands alone in the text."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "mail", m[0].lower()) for m in MAIL.finditer(text)]
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "ip", m[0]) for m in IPV4.finditer(text)]
        found += [(m.start(), m.end(), "card", re.sub(r"\D", "", m[0])) for m in CARD.finditer(text)]
        found += [(m.start(), m.end(), "phone", re.sub(r"\D", "", m[0])) for m in PHONE.finditer(text)]
        found += [(m.start(), m.end(), "ssn", re.sub(r"\D", "", m[0])) for m in SSN.finditer(text)]
    surnames = set()
    for m in NAME.finditer(text):
        for part in ("g1", "g2", "s1", "s2"):
            if m[part]:
                kind = "given" if part[0] == "g" or m[part].lower() in _GIVEN_OF else "surname"
                found.append((m.start(part), m.end(part), kind, m[part].lower()))
                if kind == "surname":
                    surnames.add(m[part])
    for m in CONTEXT.finditer(text):
        for part in ("c1", "c2"):
            kind = "given" if m[part].lower() in _GIVEN_OF else "surname"
            found.append((m.start(part), m.end(part), kind, m[part].lower()))
            if kind == "surname":
                surnames.add(m[part])
    if surnames:
        again = "|".join(re.escape(s) for s in sorted(surnames, key=len, reverse=True))
        found += [(m.start(), m.end(), "surname", m[0].lower()) for m in re.finditer(rf"(?<!\w)(?:{again})(?!\w)", text)]
    found = sorted(set(found), key=lambda x: (x[0], -x[1], x[2]))
    out, end = [], 0
    for entity in found:
        if entity[0] >= end:
            out.append(entity)
            end = entity[1]
    return out


def _permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a Feistel network, walked until inside the range."""
    if size < 2:
        return value
    half = max(1, (size - 1).bit_length() + 1 >> 1)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            mixed = hmac.digest(key, f"{tweak}|{r}|{right}".encode(), hashlib.sha256)
            left, right = right, left ^ int.from_bytes(mixed[:16], "big") & mask
        value = left << half | right
        if value < size:
            return value


def _format(text: str, rings: list[str], key: bytes, tweak: str) -> str:
    """Permute ``text`` among all texts whose characters lie in the same rings; an empty ring fixes its character."""
    value, size = 0, 1
    for c, ring in zip(text, rings):
        if ring:
            value, size = value * len(ring) + ring.index(c), size * len(ring)
    value = _permute(value, size, key, f"{tweak}|{'/'.join(rings)}")
    out = []
    for c, ring in zip(reversed(text), reversed(rings)):
        if ring:
            value, at = divmod(value, len(ring))
            c = ring[at]
        out.append(c)
    return "".join(reversed(out))


def _label(text: str) -> list[str]:
    return ["abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "0123456789" if c.isascii() and c.isdigit() else "" for c in text]


def surrogate(kind: str, normal: str, key: bytes, attempt: int = 0) -> str:
    """The surrogate of a normal form, itself a normal form of the same type."""
    if attempt > MAX_ATTEMPTS:
        return f"[{kind} {hmac.digest(key, f'{kind}|{normal}'.encode(), hashlib.sha256).hex()[:32]}]"
    tweak = f"{kind}|{attempt}"
    extra = max(0, attempt - LENGTHEN_AFTER)
    digits = "0123456789"
    if kind == "mail":
        local, _, domain = normal.partition("@")
        host, _, top = domain.rpartition(".")
        local = local + "x" * extra
        return f"{_format(local, _label(local), key, tweak)}@{_format(host, _label(host), key, 'host')}.{top}"
    if kind == "ip":
        parts = [int(p) for p in normal.split(".")]
        inner = 1 <= parts[0] <= 254
        value = ((parts[0] - 1 if inner else 0) << 24) + (parts[1] << 16) + (parts[2] << 8) + parts[3]
        value = _permute(value, 254 << 24 if inner else 1 << 24, key, f"{tweak}|{'' if inner else parts[0]}")
        return ".".join(map(str, ((value >> 24) + 1 if inner else parts[0], value >> 16 & 255, value >> 8 & 255, value & 255)))
    if kind == "card":
        valid = luhn(normal[:-1]) == int(normal[-1])
        body = normal[:-1] if valid else normal
        moved = _format(body, [""] + [digits] * (len(body) - 1), key, f"{tweak}|{valid}")
        return moved + str(luhn(moved)) if valid else moved
    if kind == "phone":
        country = 1 if len(normal) == 11 and normal[0] == "1" else 0
        rings = [""] * country + ["23456789" if normal[country] in "23456789" else ""] + [digits] * (len(normal) - country - 1)
        return _format(normal, rings, key, tweak)
    if kind == "ssn":  # the ranges that are never given out stay empty
        area, group, serial = int(normal[:3]), int(normal[3:5]), int(normal[5:])
        value = _permute((((area - 1 - (area > 666)) * 99) + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, tweak)
        rest, serial = divmod(value, 9999)
        area, group = divmod(rest, 99)
        return f"{area + 1 + (area >= 665):03d}{group + 1:02d}{serial + 1:04d}"
    if kind == "given":
        names = [n.lower() for n in GIVEN[_GIVEN_OF[normal]]]
        ring = sorted(names, key=lambda n: hmac.digest(key, n.encode(), hashlib.sha256))
        return ring[(ring.index(normal) + 1) % len(ring)]
    grown = normal + normal[-1] * extra
    return _format(grown, [_RING.get(c, "") for c in grown], key, tweak)


def written(kind: str, mention: str, new: str) -> str:
    """``new`` as ``mention`` is written: its punctuation, its letter case."""
    if new.startswith("["):
        return new
    if kind in ("phone", "card", "ssn"):
        digits = iter(new)
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if mention.isupper() and len(mention) > 1:
        return new.upper()
    if kind == "given":
        return new.title() if mention[:1].isupper() else new
    return "".join(n.upper() if m.isupper() else n for n, m in zip(new, mention)) + new[len(mention):]


def replaced(text: str, key: bytes, changed: dict[tuple[str, str], str]) -> tuple[str, list[str]]:
    """(new text, ``type:start:end`` of the entities in the old one)."""
    out, at, spans = [], 0, []
    for start, end, kind, normal in detect(text):
        new = changed.get((kind, normal)) or surrogate(kind, normal, key)
        out += [text[at:start], written(kind, text[start:end], new)]
        spans.append(f"{kind}:{start}:{end}")
        at = end
    return "".join(out) + text[at:], spans


def mentions(docs: DataFrame) -> DataFrame:
    """(th, type, normal): the entities of every distinct text, each once; ``th`` is the SHA-256 of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                hashes = batch.column(0).slice(first, len(texts)).to_pylist()
                own = sorted({(h, k, n) for h, t in zip(hashes, texts) for _, _, k, n in detect(t)})
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in own], pa.string()) for i in range(3)], ["th", "type", "normal"])

    return docs.select(_text_hash().alias("th"), "text").mapInArrow(run, "th string, type string, normal string").distinct()


def _text_hash():
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def entities(docs: DataFrame) -> DataFrame:
    """(type, normal) of all detected entities, each once."""
    return mentions(docs).select("type", "normal").distinct()


def _drawn(pending: DataFrame, key: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(k, n, key, a) for k, n, a in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(new, pa.string())], ["type", "normal", "attempt", "new"])

    return pending.select("type", "normal", "attempt").mapInArrow(run, "type string, normal string, attempt int, new string")


def surrogate_table(docs: DataFrame, key: bytes) -> DataFrame:
    """(type, normal, attempt, new) of all entities, without collisions: no ``new`` is an
    entity of the table and no two are equal within a type. Given names permute within
    their list and are not drawn again, since every name of the list may be an entity. An
    entity without a free surrogate gets a mark in brackets (``MAX_ATTEMPTS``)."""
    return _surrogates(cut(entities(docs)), key)


def _surrogates(known: DataFrame, key: bytes) -> DataFrame:
    drawn = cut(_drawn(known.withColumn("attempt", F.lit(0)), key))
    while True:  # ends: marks are distinct, and no entity looks like one
        originals = known.select(F.col("type").alias("t"), F.col("normal").alias("n"))
        taken = drawn.join(originals, (drawn["type"] == originals["t"]) & (drawn["new"] == originals["n"]), "left")
        nth = F.row_number().over(Window.partitionBy("type", "new").orderBy("attempt", "normal"))
        judged = taken.select("type", "normal", "attempt", "new", ((F.col("type") != "given") & (F.col("n").isNotNull() | (nth > 1))).alias("again"))
        judged = cut(judged)
        if judged.filter("again").isEmpty():
            return judged.drop("again")
        redo = _drawn(judged.filter("again").select("type", "normal", (F.col("attempt") + 1).alias("attempt")), key)
        drawn = cut(judged.filter("not again").drop("again").unionByName(redo))


def pseudonymised(docs: DataFrame, key: bytes, spans: str = "spans") -> DataFrame:
    """The documents, all columns and rows kept, with surrogates in ``text`` and an array of
    ``type:start:end`` (code points of the old text) named ``spans``. A null text stays
    null with an empty array; lengths change only where an address or a name does, and
    ``n_chars`` is left as it is."""
    found = cut(mentions(docs))
    changed = _surrogates(cut(found.select("type", "normal").distinct()), key).filter("attempt > 0").select("type", "normal", "new")
    columns = list(docs.columns)
    extra, th = fresh(docs, "__changed"), fresh(docs, "__th")
    # the changed surrogates of a text's own entities go to its rows; a text has one row of them
    own = found.join(changed, ["type", "normal"]).groupBy(F.col("th").alias(th)).agg(F.collect_list(F.struct("type", "normal", "new")).alias(extra))
    full = docs.withColumn(th, _text_hash()).join(cut(own), th, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, where = [], []
            for first, texts in text_slices(batch.column(0)):
                own = batch.column(1).slice(first, len(texts)).to_pylist()
                for text, own_changes in zip(texts, own):
                    table = {(c["type"], c["normal"]): c["new"] for c in own_changes or ()}
                    t, s = replaced(text, key, table)
                    new.append(t)
                    where.append(s)
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([None if x else t for t, x in zip(new, null)], pa.string()), pa.array(where, pa.list_(pa.string()))], ["row", "text", "spans"])

    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(T.StringType()))])
    done = full.select("text", extra, F.struct(*[F.lit(None).cast(docs.schema[c].dataType).alias(c) if c == "text" else F.col(c) for c in columns]).alias("row"))
    done = done.mapInArrow(run, schema)
    return done.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns], F.col("spans").alias(spans))

"""PII: keyed, type-consistent surrogates with checks across the corpus.

Detection finds e-mail addresses, IPv4 addresses, payment cards, social security numbers,
IBANs, phone numbers and names behind a title, with the further capitalised mentions of such
a name in the same text. An entity is its kind and canonical form
(digits of a number, lower-cased address, each part of a name by itself), so the same
entity gets the same surrogate in whatever spelling and document.

Numbers and addresses go through a keyed permutation of their format: every digit becomes
a digit, every letter a letter of its case and script, separators stay, octets stay
octets, and check digits (cards, IBANs) hold where they held before. A permutation maps
distinct entities of one format to distinct surrogates. Names are made of syllables of
their script, with an ending by gender; that isn't injective by construction. Every
further attempt has a syllable more, so names never run out of forms.

Checks: the distinct entities of the corpus are resolved together. An entity whose
surrogate is also that of another (of a smaller form), is an entity of the corpus, or is
the entity itself, tries again under the next attempt, until none is left. Documents are
then rewritten; only entities that needed a further attempt have to be looked up.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arterial.llm.common import checkpointed

#: Entities to look up, and documents with such, up to which they are broadcast.
BROADCAST_DOCS = 100_000
ATTEMPTS = 32

_NUMBER = re.compile(
    r"(?<![\w.])(?:"
    r"(?P<ipv4>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})"
    r"|(?P<card>\d{4}([ -])\d{4}\4\d{4}\4\d{1,7}|\d{13,19})"
    # International, broken or not; an area code in brackets; a leading 0 or 1 and long groups; short groups.
    r"|(?P<phone>\+\d+(?:[ ./-]?\(\d{1,5}\)[ ./-]?\d+)?(?:[ ./-]\d+)*"
    r"|\(\d{2,5}\)[ ./-]?\d+(?:[ .-]\d{2,})*"
    r"|0\d{1,4}(?:[ -]\d{2,}){1,5}|0\d{2,4}/\d{5,}|1[ -]\d{3}[ -]\d{7}"
    r"|\d{1,4}[ .-]?\(\d{2,4}\)[ .-]?\d{1,4}(?:[ .-]\d{2,4}){1,4}"
    r"|\d{1,4}(?:[ .-]\d{2,4}){1,4})"
    r")(?!\w)",
    re.A,
)
# One separator is enough behind a trunk prefix.
_TRUNK = re.compile(r"0\d{1,4}[ /-]\d{5,}", re.A)
_DATE = re.compile(r"\d{4}([-./])\d{1,2}\1\d{1,2}|\d{1,2}([-./])\d{1,2}\2\d{2,4}", re.A)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)", re.A)
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$", re.A)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", re.A)
# Titles by gender.
_MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Signor", "г-н", "Господин")
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Sra", "Madame", "Mme", "Signora", "г-жа", "Госпожа")
_OTHER = ("Dr", "Prof")
_WORD = re.compile(r"[^\W\d_]+")
_TITLE = re.compile(rf"(?<!\w)(?P<title>{'|'.join((*_MALE, *_FEMALE, *_OTHER))})\.?[ ](?P<name>[^\W\d_]+(?:[-'’ ][^\W\d_]+){{0,2}})")
# Syllables by script: (consonants, vowels, male endings, female endings).
_SYLLABLES = {
    "latin": ("bdfgklmnprstvz", "aeiou", ("n", "r", "s", "k"), ("a", "ia", "e")),
    "cyrillic": ("бвгдклмнпрст", "аеиоу", ("н", "р", "в", "к"), ("а", "ия", "на")),
    "greek": ("βγδκλμνπρστ", "αειου", ("ς", "ν", "ρ", "ξ"), ("α", "η", "ια")),
}
_ALPHABETS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
}

Span = tuple[int, int, str, str]  # start, end, kind, canonical form


def script_of(text: str) -> str:
    name = unicodedata.name(next((c for c in text if c.isalpha()), "a"), "")
    return "cyrillic" if name.startswith("CYRILLIC") else "greek" if name.startswith("GREEK") else "latin"


def _luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _whole_groups(value: str) -> str:
    """The first groups of a marked number, up to the 15 digits that a phone has at most, 11 behind +1."""
    if value[0] not in "+(":
        return value
    digits, end, most = 0, 0, 11 if value.startswith("+1") else 15
    for g in re.finditer(r"\d+", value):
        digits += len(g.group())
        if digits > most:
            break
        end = g.end()
    return value[:end]


def _is_phone(value: str) -> bool:
    if not 7 <= sum(map(str.isdigit, value)) <= 15 or _DATE.fullmatch(value):
        return False
    return value[0] == "+" or "(" in value or len(re.findall(r"[ .-]", value)) > 1 or _TRUNK.fullmatch(value) is not None


def find_entities(text: str) -> list[Span]:
    """Entities from left to right; of overlapping ones the first, then the longest."""
    found: list[Span] = []
    at = text.find("@")
    while at >= 0:
        local, domain = _LOCAL.search(text[max(0, at - 64) : at]), _DOMAIN.match(text, at + 1)
        if local and domain:
            start = at - len(local.group())
            found.append((start, domain.end(), "email", text[start : domain.end()].lower()))
        at = text.find("@", at + 1)
    m = _NUMBER.search(text)
    while m:
        kind, value, after = next(k for k in ("ipv4", "ssn", "card", "phone") if m.group(k)), m.group(), m.end()
        if kind == "phone":
            value = _whole_groups(value)
            if _is_phone(value):
                after = m.start() + len(value)
            else:
                kind = ""
                after = m.start() + 1 if value[:1] in ("+", "(", "") else after  # digits behind the mark may be another kind
        if kind:
            found.append((m.start(), m.start() + len(value), kind, value if kind == "ipv4" else re.sub(r"\D", "", value)))
        m = _NUMBER.search(text, after)
    for m in _IBAN.finditer(text):
        value = m.group().replace(" ", "")
        if 15 <= len(value) <= 34 and _mod97(value) == 1:
            found.append((m.start(), m.end(), "iban", value))
    names: dict[str, str] = {}
    for m in _TITLE.finditer(text):
        gender = "m" if m["title"] in _MALE else "f" if m["title"] in _FEMALE else "x"
        parts = list(re.finditer(r"[^\W\d_]+", m["name"]))
        parts = parts[: next((k for k, p in enumerate(parts) if not p.group()[0].isupper()), len(parts))]
        for k, p in enumerate(parts):
            family = k == len(parts) - 1
            start = m.start("name") + p.start()
            kind = "family" if family else f"given-{gender}"
            found.append((start, start + len(p.group()), kind, p.group().lower()))
            if len(p.group()) > 1:  # an initial is no name
                names.setdefault(p.group().lower(), kind)
    if names:  # mentions without a title
        titled = {s[0] for s in found if s[2].startswith(("family", "given"))}
        for m in _WORD.finditer(text):
            canon = m.group().lower()
            if canon in names and m.group()[0].isupper() and m.start() not in titled:
                found.append((m.start(), m.end(), names[canon], canon))
    found.sort(key=lambda s: (s[0], -s[1]))
    out: list[Span] = []
    for s in found:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


class Maker:
    """Surrogates under one key."""

    def __init__(self, key: bytes):
        self.key = key
        self.make = lru_cache(maxsize=50_000)(self._make)

    def _mac(self, *parts: str) -> int:
        return int.from_bytes(hmac.digest(self.key, "\0".join(parts).encode(), hashlib.sha256), "big")

    def permute(self, value: int, size: int, tweak: str) -> int:
        """A keyed permutation of 0 .. size - 1: eight Feistel rounds on the next even
        number of bits, walked until the result is below ``size``."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = value >> half, value & mask
            for r in range(8):
                left, right = right, left ^ (self._mac(tweak, str(size), str(r), str(right)) & mask)
            value = left << half | right
            if value < size:
                return value

    def _letters(self, text: str, tweak: str) -> str:
        """Digits and letters permuted within their classes, all others kept."""
        sets = [_class_of(c) for c in text]
        value, size = 0, 1
        for c, s in zip(text, sets, strict=True):
            if s:
                value, size = value * len(s) + s.index(c), size * len(s)
        if size == 1:
            return text
        value, out = self.permute(value, size, tweak + "|" + "".join("." if s is None else s[0] for s in sets)), []
        for c, s in zip(reversed(text), reversed(sets), strict=True):
            if s:
                value, k = divmod(value, len(s))
                c = s[k]
            out.append(c)
        return "".join(reversed(out))

    def _make(self, kind: str, canon: str, attempt: int) -> str:
        """The canonical form of an entity's surrogate."""
        tweak = f"{kind}|{attempt}"
        if kind == "ipv4":
            n = 0
            for x in canon.split("."):
                n = n << 8 | int(x)
            n = self.permute(n, 1 << 32, tweak)
            return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
        if kind == "email":
            local, _, domain = canon.rpartition("@")
            head, dot, top = domain.rpartition(".")
            return self._letters(local + "@" + head, tweak) + dot + top
        if kind == "card" and _luhn(canon) == 0:
            body = self._letters(canon[:-1], tweak + "|luhn")
            return body + str((10 - _luhn(body + "0")) % 10)
        if kind == "card":  # not a valid number: stay among these
            out = self._letters(canon, tweak)
            while _luhn(out) == 0:
                out = self._letters(out, tweak)
            return out
        if kind == "iban":
            body = self._letters(canon[4:], tweak + canon[:2])
            return f"{canon[:2]}{98 - _mod97(canon[:2] + '00' + body):02d}{body}"
        if kind in ("ssn", "phone"):
            return self._letters(canon, tweak)
        return self._name(kind, canon, tweak, attempt)

    def _name(self, kind: str, canon: str, tweak: str, attempt: int) -> str:
        consonants, vowels, male, female = _SYLLABLES[script_of(canon)]
        x = self._mac(tweak, canon)
        out = ""
        for _ in range((3 if kind == "family" else 2) + attempt):
            x, c = divmod(x, len(consonants))
            x, v = divmod(x, len(vowels))
            out += consonants[c] + vowels[v]
        x, c = divmod(x, len(consonants))
        ends = male if kind == "given-m" else female if kind == "given-f" else (*male, *female)
        return out + (consonants[c] if ends is not male else "") + ends[x % len(ends)]

    def spelled(self, kind: str, canon: str, seen: str, attempt: int) -> str:
        """The surrogate in the spelling of an occurrence."""
        made = self.make(kind, canon, attempt)
        if kind in ("ssn", "card", "phone", "iban"):
            marks = iter(made)
            return "".join(next(marks) if c.isalnum() else c for c in seen)
        if kind == "email":
            return "".join(m.upper() if c.isupper() else m for m, c in zip(made, seen, strict=True))
        if kind == "ipv4":
            return made
        return made.upper() if seen.isupper() and len(seen) > 1 else made[0].upper() + made[1:]


def _class_of(c: str) -> str | None:
    if "0" <= c <= "9":
        return "0123456789"
    for letters in _ALPHABETS.values():
        if c in letters:
            return letters
        if c.lower() in letters and c.lower() != c:
            return letters.upper()
    return None


def rewrite(text: str, maker: Maker, attempts: dict) -> tuple[str, list[Span]]:
    """The text with surrogates, and the entities found in it."""
    spans = find_entities(text)
    out, at = [], 0
    for s, e, kind, canon in spans:
        out += [text[at:s], maker.spelled(kind, canon, text[s:e], attempts.get((kind, canon), 0))]
        at = e
    return "".join(out) + text[at:], spans


def resolve(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, canon, attempt, surrogate of distinct ``entities`` (kind, canon), checked."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker = Maker(key)
        for f in frames:
            yield f.assign(surrogate=[maker.make(*x) for x in zip(f["kind"], f["canon"], f["attempt"], strict=True)])

    made = "kind string, canon string, attempt int, surrogate string"
    table = checkpointed(entities.withColumn("attempt", F.lit(0)).mapInPandas(make, made))
    # Names share one space of forms whatever their part or gender.
    space = F.when(F.col("kind").rlike("^(given|family)"), "name").otherwise(F.col("kind"))
    for _ in range(ATTEMPTS):
        spaced = table.withColumn("space", space)
        first = spaced.groupBy("space", "surrogate").agg(F.min(F.struct("attempt", "canon", "kind")).alias("owner"), F.count(F.lit(1)).alias("n"))
        shared = spaced.join(first.where("n > 1"), ["space", "surrogate"]).where(F.struct("attempt", "canon", "kind") != F.col("owner")).select("kind", "canon")
        real = spaced.select("space", F.col("canon").alias("surrogate")).distinct()
        taken = spaced.join(real, ["space", "surrogate"], "left_semi").select("kind", "canon")
        again = checkpointed(shared.union(taken).distinct())
        if not again.head(1):
            return table
        stay = table.join(again, ["kind", "canon"], "left_anti")
        moved = table.join(again, ["kind", "canon"], "left_semi").withColumn("attempt", F.col("attempt") + 1).drop("surrogate")
        table = checkpointed(stay.unionByName(moved.mapInPandas(make, made)))
    raise RuntimeError("surrogates still collide: the space of forms is too small for the entities")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` (text, ...) with the rewritten text, n_entities and entities.

    ``entities`` lists kind:start:end of the original text (code points, ends exclusive).
    Null texts stay null, empty ones empty, and texts without entities are unchanged.
    Equal texts are rewritten alike, and equal entities alike in all texts under one key; whoever
    has the key can tell originals from surrogates, so it has to be kept as a secret. Texts are
    read whole, repeated rows stay, and an empty table gives an empty result. Other columns are carried along; ones named like a result are replaced.
    """
    secret = key.encode()
    kept = docs.drop("n_entities", "entities")
    occurring = docs.select(F.xxhash64("text").alias("doc"), "text").mapInPandas(_occurrences, "doc long, kind string, canon string")
    occurring = checkpointed(occurring)
    table = resolve(occurring.select("kind", "canon").distinct(), secret)
    again = checkpointed(table.where("attempt > 0").select("kind", "canon", "attempt"))
    # Few entities collide; they go to every task, so that a frequent one needn't meet in one.
    if again.count() <= BROADCAST_DOCS:
        again = F.broadcast(again)
    looked_up = occurring.distinct().join(again, ["kind", "canon"]).groupBy("doc").agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias("__again"))
    looked_up = checkpointed(looked_up.withColumnRenamed("doc", "__doc"))
    if looked_up.count() <= BROADCAST_DOCS:
        looked_up = F.broadcast(looked_up)
    joined = kept.join(looked_up, F.xxhash64("text") == F.col("__doc"), "left").drop("__doc")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "n_entities long, entities string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker = Maker(secret)
        for f in frames:
            texts, found = [], []
            for t, again in zip(f["text"], f["__again"], strict=True):
                attempts = {} if again is None else {(x["kind"], x["canon"]): x["attempt"] for x in again}
                new, spans = (t, []) if not t else rewrite(t, maker, attempts)
                texts.append(new)
                found.append(spans)
            yield f.drop(columns="__again").assign(text=texts, n_entities=[len(s) for s in found], entities=[",".join(f"{k}:{a}:{b}" for a, b, k, _ in s) for s in found])

    return joined.mapInPandas(run, schema)


def _occurrences(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = {(d, kind, canon) for d, t in zip(f["doc"], f["text"], strict=True) if t for _, _, kind, canon in find_entities(t)}
        yield pd.DataFrame(sorted(rows), columns=["doc", "kind", "canon"])

"""PII surrogates (operator 6).

Detected entities get replacements of the same type, gender, script and format. An entity is first brought to one
canonical form, whatever its mention looks like; a keyed permutation of all canonical forms of its kind gives the
surrogate, which is then written in the mention's own format. So equal entities get equal surrogates in every document,
different ones different surrogates, and none keeps its value, without a table that grows with the corpus. Names that a
title reveals are replaced wherever the document mentions them again. A Spark job checks distinctness and coreference
for the whole corpus.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import checkpoint, map_arrow, strings

ROUNDS = 8
REMEMBERED = 100_000

#: Given names by gender and script. Fixed values.
GIVEN = {
    ("f", "latin"): "Anna Beatrice Carla Diana Elena Fiona Greta Helen Irene Julia Karin Laura Maria Nadia Olivia Paula Rosa Sofia Teresa Ursula Vera Wilma Yvonne Zoe Claire Elise Marie Ines Lucia Sarah Emma Mary".split(),
    ("m", "latin"): "Adam Bruno Carl David Erik Felix George Henry Ivan James Karl Louis Martin Noah Oscar Peter Ralph Simon Thomas Ulrich Victor Walter Xavier Yann Paul Pierre Juan Carlos Hans John Robert Michael".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Зоя Ирина Ксения Лидия Мария Надежда Ольга Полина Раиса Софья Татьяна".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Николай Олег Павел Роман Сергей Тимур".split(),
}
_gender = {n: g for (g, _), names in GIVEN.items() for n in names}
#: What a given name that isn't listed ends in after its letters were permuted, by gender and script.
ENDINGS = {("f", "latin"): "ina", ("m", "latin"): "on", ("f", "cyrillic"): "ина", ("m", "cyrillic"): "ан"}
#: Endings of surnames that tell a gender and stay. Fixed values.
SURNAME_ENDINGS = "ова ева ёва ина ская цкая ов ев ёв ин ский цкий ova eva ska ská ski ský".split()
#: Titles by gender. Fixed values.
TITLES = {"f": "Mrs Ms Miss Frau Mme Madame Señora Sra Doña Signora Г-жа Госпожа".split(), "m": "Mr Mister Herr Monsieur Señor Sr Don Signor Г-н Господин".split(), "": "Dr Prof Doctor Professor".split()}
PARTICLES = "van von de der den del della di da dos du la le ten ter zu af av bin al el".split()
#: Letters that stand for each other in a name: vowels for vowels, consonants for consonants, within a script.
LETTERS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "àáâäèéêëíîïòóôöùúûü", "çñšžýłńćđß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρσςτφχψ"]
_LETTER = {c: (s, i) for s in LETTERS for i, c in enumerate(s)}
#: Country codes of one and two digits; all others have three. Fixed values.
CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Networks whose addresses stay within them: first address, bits of the prefix. Fixed values.
NETWORKS = [(10 << 24, 8), (127 << 24, 8), (169 << 24 | 254 << 16, 16), (172 << 24 | 16 << 16, 12), (192 << 24 | 168 << 16, 16)]

_octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_word = r"[^\W\d_]"
_capital = rf"(?=[^\W\d_a-z]){_word}(?:{_word}|['’-](?={_word}))+"
_titles = "|".join(re.escape(t) for s in TITLES.values() for t in s)
_particles = "|".join(PARTICLES)
#: Kind, pattern, group that holds the entity, characters of which one must occur. Earlier kinds win.
PATTERNS = [
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9_.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"), 0, "@"),
    ("credential", re.compile(r"""(?i:\b(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key)\b["']?\s*[=:]\s*["']?)([A-Za-z0-9_\-./+]{6,})"""), 1, "=:"),
    ("access_key", re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9]{20,}\b|\bxox[abprs]-[A-Za-z0-9-]{10,}"), 0, "AKgsx"),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), 0, "0123456789"),
    ("ip", re.compile(rf"(?<![\d.])(?:{_octet}\.){{3}}{_octet}(?![\d]|\.\d)"), 0, "."),
    ("ipv6", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"), 0, ":"),
    ("card", re.compile(r"(?<![\w-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\w-])|(?<![\w-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\w-])"), 0, "0123456789"),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), 0, "-"),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}([.-])\d{3}\1\d{4}(?![\w.-])"), 0, "0123456789"),
    ("name", re.compile(rf"(?<!\w)({_titles})\.? +((?:[^\W\d_a-z]\. +)*(?:(?:{_particles}) +){{0,2}}{_capital}(?:(?: +[^\W\d_a-z]\.)* +(?:(?:{_particles}) +){{0,2}}{_capital}){{0,2}})"), 2, "MDFSPГH"),
]


class Entity(NamedTuple):
    start: int
    end: int
    kind: str
    hint: str  # of a name: what tells the gender of its given names, as "given=gender" parts


def overlaps(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a..b meets one of the intervals, which don't overlap and are in order."""
    i = bisect_left(taken, (a, 0))
    return i < len(taken) and taken[i][0] < b or i > 0 and taken[i - 1][1] > a


@lru_cache(REMEMBERED)
def name_parts(text: str) -> tuple[tuple[str, str], ...]:
    """(part, role) of a name: given names before the last word, particles and initials as they are; the last word is the
    surname. White space is a part of its own."""
    parts = re.split(r"( +)", text)
    words = [p for p in parts[::2] if p not in PARTICLES and not p.endswith(".")]
    roles, seen = [], 0
    for i, p in enumerate(parts):
        if i % 2 or p in PARTICLES or p.endswith(".") and len(p) == 2:
            roles.append((p, "initial" if p.endswith(".") else ""))
        else:
            seen += 1
            roles.append((p, "given" if seen < len(words) else "surname"))
    return tuple(roles)


def find(text: str) -> list[Entity]:
    """Entities that don't overlap, in order. An earlier kind wins over a later one. Words of a name behind a title are
    entities wherever else they stand as whole words, in the same case or in capitals."""
    taken: list[tuple[int, int]] = []
    out: list[Entity] = []

    def take(a: int, b: int, kind: str, hint: str = "") -> None:
        if not overlaps(taken, a, b):
            insort(taken, (a, b))
            out.append(Entity(a, b, kind, hint))

    names: dict[str, tuple[str, str]] = {}
    forms: set[str] = set()
    for kind, pattern, group, gate in PATTERNS:
        if not any(c in text for c in gate):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(group)
            if kind == "phone" and sum(c.isdigit() for c in m[0]) < 7 or kind == "iban" and not iban_valid(m[0]):
                continue
            if kind == "name":
                gender = next((g for g, titles in TITLES.items() if m[1] in titles), "")
                for part, role in name_parts(m[2]):
                    if role in ("given", "surname"):
                        forms |= {part, part.upper(), part.title()}
                        # a given name of known gender wins over one of unknown, and a given name over a surname
                        old = names.get(part.upper(), ("surname", ""))
                        known = _gender.get(part.title(), gender) if role == "given" else ""
                        names[part.upper()] = ("given" if "given" in (role, old[0]) else role, old[1] or known)
            else:
                take(a, b, kind)
    if names:
        one = "(?:" + "|".join(map(re.escape, sorted(forms, key=lambda f: (-len(f), f)))) + ")"
        link = rf"(?: +[^\W\d_a-z]\.)* +(?:(?:{_particles}) +){{0,2}}"
        for m in re.finditer(rf"(?<!\w)(?:[^\W\d_a-z]\. +)*{one}(?!\w)(?:{link}{one}(?!\w))*", text):
            hint = ",".join(f"{w.upper()}={'|'.join(names[w.upper()])}" for w, role in name_parts(m[0]) if role in ("given", "surname") and w.upper() in names)
            take(*m.span(), "name", hint)
    return sorted(out)


def luhn(digits: list[int]) -> int:
    """The check digit after these digits."""
    return -sum(sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(reversed(digits))) % 10


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0..size-1, or its inverse: a Feistel network on the next even number of bits, walked until
    it falls below size."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    much = width > 64  # more bytes than one digest has: very long credentials
    tweaked = tweak.encode()

    def mix(b: int, r: int) -> int:
        data = b.to_bytes(width, "big") + tweaked
        if much:
            seed = hashlib.blake2b(data, key=key[:64], salt=bytes([r])).digest()
            return int.from_bytes(hashlib.shake_256(seed).digest(width), "big") & mask
        return int.from_bytes(hashlib.blake2b(data, key=key[:64], digest_size=width, salt=bytes([r])).digest(), "big") & mask

    while True:
        a, b = value >> half, value & mask
        for r in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            a, b = (b ^ mix(a, r), a) if back else (b, a ^ mix(b, r))
        value = (a << half) | b
        if value < size:
            return value


def moved(value: int, size: int, key: bytes, tweak: str, ok: Callable[[int], bool] | None = None) -> int:
    """A keyed permutation of 0..size-1 that leaves no value where it is: the step to the next place of one secret cycle
    through all values. With `ok`, through those that are."""
    while True:
        value = permute((permute(value, size, key, tweak) + 1) % size, size, key, tweak, True)
        if ok is None or ok(value):
            return value


def mixed(places: list[tuple[int, int]], key: bytes, tweak: str, ok: Callable[[list[int]], bool] | None = None) -> list[int]:
    """Permute the digits of a number written in mixed radices; places are (digit, radix)."""
    value, size = 0, 1
    for d, r in places:
        value, size = value * r + d, size * r
    if size == 1:
        return [0] * len(places)

    def digits(v: int) -> list[int]:
        out = []
        for _, r in reversed(places):
            v, d = divmod(v, r)
            out.append(d)
        return out[::-1]

    return digits(moved(value, size, key, tweak + ":" + ",".join(str(r) for _, r in places), ok and (lambda v: ok(digits(v)))))


def spell(text: str, key: bytes, tweak: str, fixed: set[int] = frozenset(), letters: str = "abcdefghijklmnopqrstuvwxyz", hexadecimal: bool = False) -> str:
    """Digits for digits and ASCII letters for letters, in the case they had; positions in `fixed` and all other
    characters stay and are part of the format."""
    places, at = [], []
    for i, c in enumerate(text):
        if i in fixed:
            continue
        if hexadecimal and c in "0123456789abcdefABCDEF":
            places.append((int(c, 16), 16))
            at.append(i)
        elif c.isascii() and c.isdigit():
            places.append((int(c), 10))
            at.append(i)
        elif c.isascii() and c.isalpha():
            places.append((letters.index(c.lower()), 26))
            at.append(i)
    moving = set(at)
    kept = "".join(c for i, c in enumerate(text) if i not in moving)
    out = list(text)
    for i, (_, r), d in zip(at, places, mixed(places, key, f"{tweak}:{kept.lower()}:{len(text)}"), strict=True):
        out[i] = f"{d:x}" if r == 16 else str(d) if r == 10 else letters[d]
        if text[i].isupper() or r == 16 and hexadecimal and text.isupper():
            out[i] = out[i].upper()
    return "".join(out)


def cased(new: str, old: str) -> str:
    """New letters in the case of the old ones: all capitals, or a capital at the beginning and behind each mark."""
    if len(old) > 1 and old.isupper():
        return new.upper()
    return "".join(c.upper() if i == 0 or not new[i - 1].isalpha() else c for i, c in enumerate(new)) if old[:1].isupper() else new


@lru_cache(4096)
def row_of(c: str) -> str:
    """The letters that stand for a letter which LETTERS lacks: those of its kind in its row of 64 code points."""
    first = ord(c) & ~63
    return "".join(x for x in map(chr, range(first, first + 64)) if unicodedata.category(x) == unicodedata.category(c) and x.lower() == x) if c.lower() == c else ""


def letters_of(word: str, key: bytes, tweak: str, ok: Callable[[str], bool] | None = None) -> str:
    """Letters of a word in lower case for letters of the same sort; with `ok`, a word for which it holds, as it must for
    the word itself."""
    known = [(i, *(_LETTER.get(c) or (row_of(c), row_of(c).find(c)))) for i, c in enumerate(word)]
    known = [(i, s, j) for i, s, j in known if j >= 0]
    at = {i for i, *_ in known}
    shape = ",".join(s[0] for _, s, _ in known) + ":" + "".join("." if i in at else c for i, c in enumerate(word))

    def spelled(new: list[int]) -> str:
        out = list(word)
        for (i, s, _), d in zip(known, new, strict=True):
            out[i] = s[d]
        return "".join(out)

    return spelled(mixed([(j, len(s)) for _, s, j in known], key, f"{tweak}:{shape}", ok and (lambda new: ok(spelled(new)))))


def ending(word: str) -> str:
    return next((e for e in SURNAME_ENDINGS if word.endswith(e) and len(word) >= len(e) + 2), "")


def surname(text: str, key: bytes) -> str:
    """Vowels for vowels, consonants for consonants of the same script. An ending that tells a gender stays, so that both
    forms of a family's name keep one stem; other names get none."""
    word = text.lower()
    end = ending(word)
    if end:
        return cased(letters_of(word[: -len(end)], key, "stem") + end, text)
    return cased(letters_of(word, key, "surname", lambda w: not ending(w)), text)


def given(text: str, gender: str, key: bytes) -> str:
    """Another given name of the same gender and script: of the list if the name is listed, else its letters permuted and
    an ending of the gender, if it is known. Neither gives what the other gives."""
    for (sex, script), names in GIVEN.items():
        if text.title() in names:
            return cased(names[moved(names.index(text.title()), len(names), key, f"given:{sex}:{script}")].lower(), text)
    word = text.lower()
    script = "cyrillic" if any("а" <= c <= "я" for c in word) else "latin" if any("a" <= c <= "z" for c in word) else ""
    end, ends = ENDINGS.get((gender, script), ""), tuple(ENDINGS.values())
    plain = lambda w: (w + end).title() not in _gender and (bool(end) or not w.endswith(ends))
    return cased(letters_of(word, key, f"given:{gender}", plain if plain(word) else lambda w: not plain(w)) + end, text)


def canonical(text: str, kind: str, hint: str = "") -> str:
    """What makes two mentions the same entity: neither case nor how digits are grouped counts."""
    if kind == "phone":
        digits = "".join(c for c in text if c.isdigit())
        return "+" + digits if text[0] == "+" else "+1" + digits
    if kind in ("card", "ssn"):
        return "".join(c for c in text if c.isdigit())
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "ipv6":
        return ":".join(f"{int(g, 16):x}" for g in text.split(":"))
    if kind == "ip":
        return ".".join(str(int(o)) for o in text.split("."))
    return text.lower() if kind == "email" else text


def in_digits(text: str, digits: str) -> str:
    """The digits, in the places of the text's digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def phone(number: str, key: bytes) -> str:
    """Another number of the same country and length; places that never hold 0 or 1 don't."""
    code = next((number[1 : 1 + n] for n in (1, 2) if number[1 : 1 + n] in CODES), number[1:4])
    rest = [int(d) for d in number[1 + len(code) :]]
    # a first digit that isn't 0 stays so; code 1 has areas and exchanges from 2 on
    least = [2 if code == "1" and i in (0, 3) else 1 if i == 0 else 0 for i in range(len(rest))]
    places = [(d - a, 10 - a) if d >= a else (d, max(1, a)) for d, a in zip(rest, least, strict=True)]
    new = mixed(places, key, f"phone:{code}:{[d >= a for d, a in zip(rest, least, strict=True)]}")
    return f"+{code}" + "".join(str(n + a if d >= a else n) for n, d, a in zip(new, rest, least, strict=True))


def address(text: str, key: bytes) -> str:
    """An address of the same network if it's one of a known private network, else another public one."""
    value = int.from_bytes(bytes(map(int, text.split("."))), "big")
    network = lambda v: next((n for n, (first, bits) in enumerate(NETWORKS) if v >> (32 - bits) == first >> (32 - bits)), None)
    home = network(value)
    if home is None:
        value = moved(value, 1 << 32, key, "ip", lambda v: network(v) is None)
    else:
        first, bits = NETWORKS[home]
        value = first + moved(value - first, 1 << (32 - bits), key, f"ip:{home}")
    return ".".join(map(str, value.to_bytes(4, "big")))


def of_canonical(entity: str, kind: str, key: bytes) -> str:
    """The surrogate of an entity that isn't a name, in canonical form."""
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        # local part and domain by themselves: people of one domain stay people of one domain
        return spell(local, key, "local") + "@" + spell(domain, key, "domain", {*range(domain.rindex("."), len(domain))})
    if kind == "ip":
        return address(entity, key)
    if kind == "ipv6":
        return ":".join(f"{o:x}" for o in mixed([(int(o, 16), 65536) for o in entity.split(":")], key, "ipv6"))
    if kind == "card":
        digits = [int(c) for c in entity]
        # the issuer's digit and the distance to the valid check digit stay
        body = [digits[0], *mixed([(d, 10) for d in digits[1:-1]], key, f"card:{digits[0]}")]
        return "".join(map(str, [*body, (luhn(body) + digits[-1] - luhn(digits[:-1])) % 10]))
    if kind == "phone":
        return phone(entity, key)
    if kind == "ssn":
        valid = lambda d: d[:3] not in ([0, 0, 0], [6, 6, 6]) and d[0] < 9 and any(d[3:5]) and any(d[5:])
        digits = [int(c) for c in entity]
        same = valid(digits)
        return "".join(map(str, mixed([(d, 10) for d in digits], key, "ssn", lambda d: valid(d) == same)))
    if kind == "iban":
        body = spell(entity[4:], key, "iban:" + entity[:2])
        check = 98 - int("".join(str(int(c, 36)) for c in body + entity[:2] + "00")) % 97
        return f"{entity[:2]}{check:02d}{body}"
    if kind == "access_key":
        return spell(entity, key, "access", {*range(4)})
    plain = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", entity)
    return spell(entity, key, "credential", hexadecimal=bool(plain and re.search("[0-9]", entity)))


def name_entities(text: str, hint: str) -> list[tuple[str, str]]:
    """(kind, canonical) of the words of a name. Names are told apart word by word, so that a surname alone is the same
    entity as in the whole name."""
    roles = dict(x.split("=") for x in hint.split(",")) if hint else {}
    out = []
    for part, role in name_parts(text):
        if role in ("given", "surname"):
            known, _, gender = roles.get(part.upper(), f"{role}|").partition("|")
            out.append((f"{known}.{gender}" if known == "given" else known, part.lower()))
        elif role == "initial":
            out.append(("initial", part.lower()))
    return out


def of_name(word: str, kind: str, key: bytes) -> str:
    if kind == "initial":
        return letters_of(word, key, "initial")
    role, _, gender = kind.partition(".")
    return given(word.title(), gender, key).lower() if role == "given" else surname(word, key)


def in_format(new: str, text: str, kind: str) -> str:
    """A canonical surrogate as the mention writes it."""
    if kind == "phone":
        return in_digits(text, new[1:] if text[0] == "+" else new[2:])
    if kind in ("card", "ssn"):
        return in_digits(text, new)
    if kind == "iban":
        it = iter(new)
        return "".join(c if c == " " else next(it) for c in text)
    if kind == "ipv6":
        groups = text.split(":")
        wide = all(len(g) == 4 for g in groups)
        out = ":".join(g.rjust(4, "0") if wide else g for g in new.split(":"))
        return out.upper() if text.isupper() else out
    if kind == "email":
        return "".join(n.upper() if o.isupper() else n for n, o in zip(new, text, strict=True))
    return new


@lru_cache(REMEMBERED)
def remembered(entity: str, kind: str, key: bytes) -> str:
    return of_name(entity, kind, key) if kind.partition(".")[0] in ("given", "surname", "initial") else of_canonical(entity, kind, key)


@lru_cache(REMEMBERED)
def surrogate(text: str, kind: str, key: bytes, hint: str = "") -> str:
    if kind != "name":
        return in_format(remembered(canonical(text, kind), kind, key), text, kind)
    words = iter(name_entities(text, hint))
    out = []
    for part, role in name_parts(text):
        if role:
            of, word = next(words)
            out.append(cased(remembered(word, of, key), part))
        else:
            out.append(part)
    return "".join(out)


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str, str, str]]]:
    """The text with surrogates, and (start, end, kind, entity, surrogate) by positions in the original."""
    got = find(text)
    if not got:
        return text, []
    out, at, spans = [], 0, []
    for e in got:
        old = text[e.start : e.end]
        new = surrogate(old, e.kind, key, e.hint)
        spans.append((e.start, e.end, e.kind, old, new))
        out += [text[at : e.start], new]
        at = e.end
    return "".join([*out, text[at:]]), spans


def entities(df: DataFrame, text: str = "text") -> DataFrame:
    """The different (kind, entity) of df, entities in their canonical form; names by their words, given names with the
    gender that their document tells."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got: dict[tuple[str, str], None] = {}
        for t in strings(batch, text):
            for e in find(t):
                old = t[e.start : e.end]
                got.update(dict.fromkeys(name_entities(old, e.hint) if e.kind == "name" else [(e.kind, canonical(old, e.kind))]))
        return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.string()) for i in range(2)], names=["kind", "entity"])

    return map_arrow(df.select(text), run, "kind string, entity string", text).distinct()


def collisions(known: DataFrame, key: bytes) -> DataFrame:
    """Surrogates of more than one (kind, entity) of the same kind, and surrogates that equal their entity: kind,
    surrogate, n. Empty if distinctness holds; coreference holds since a surrogate depends on the entity alone. Kinds of
    given names count as one kind, since a text doesn't tell them apart."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds, old = batch.column("kind").to_pylist(), batch.column("entity").to_pylist()
        new = [remembered(e, k, key) for k, e in zip(kinds, old, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([k.partition(".")[0] for k in kinds], pa.string()), batch.column("entity"), pa.array(new, pa.string())], names=["kind", "entity", "surrogate"])

    pairs = map_arrow(known, run, "kind string, entity string, surrogate string").distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("entity") == F.col("surrogate")).cast("int")).alias("same")).where("n > 1 or same = 1").select("kind", "surrogate", "n")


def checked_key(df: DataFrame, key: bytes, text: str = "text", tries: int = 16) -> bytes:
    """The key, or the first key derived from it, under which the corpus has no collisions. The corpus is read once; keys
    are tried on its different entities. Surrogates of one domain can't collide; what can are names that are listed with
    ones that aren't, and strings of hexadecimal digits with others. Should no key do, as no entity may go unreplaced, the
    last one is used for all that: each text is still replaced, and `collisions` lists what is shared."""
    known = checkpoint(entities(df, text))
    for _ in range(tries):
        if not collisions(known, key).limit(1).count():
            break
        key = hashlib.blake2b(key).digest()
    return key


def replace(df: DataFrame, key: bytes, text: str = "text", spans: str | None = "entities") -> DataFrame:
    """df with surrogates in its text and, unless None, an array column of spans (start, end by positions in the
    original, kind, surrogate); a column of that name is replaced. A null text stays null and has no spans; an empty one
    stays empty. Repeated rows are replaced alike; other columns are carried."""
    src = df.drop(spans) if spans and spans in df.columns else df
    names = [*src.columns, *([spans] if spans else [])]
    where = src.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [(None, []) if t is None else replaced(t, key) for t in batch.column(text).to_pylist()]
        columns = list(batch.columns)
        columns[where] = pa.array([t for t, _ in got], pa.string())
        if spans:
            columns.append(pa.array([[{"start": a, "end": b, "kind": k, "surrogate": n} for a, b, k, _, n in s] for _, s in got], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("surrogate", pa.string())]))))
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields) + (f", `{spans}` array<struct<start:int,end:int,kind:string,surrogate:string>>" if spans else "")
    return map_arrow(src, run, schema, text)

"""Scalar functions of templates as Column expressions: tokens, masks, similarity, template text, rebuilding."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space. Fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
_plain = "[" + re.escape(SPACE) + "]"
#: The same class for Java, which asks the parts of a class one after the other: what is neither in the bytes nor between the
#: others is out after two.
_white = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in SPACE if c < "\u0100") + f"\\x{{{min(map(ord, (c for c in SPACE if c > 'ÿ'))):x}}}-\\x{{{max(map(ord, SPACE)):x}}}&&" + _plain + "]"
_space = _white + "+"
#: Kinds of parameters by number. Fixed values.
KINDS = ["IP", "UUID", "NUM", "HEX", "TS", "PATH", "STR", "OVERFLOW"]
IP, UUID, NUM, STR, OVERFLOW = 0, 1, 2, 6, 7
_octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Forms of masked tokens, tried in this order.
MASKS = [("UUID", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"), ("IP", rf"^{_octet}(\.{_octet}){{3}}$"), ("NUM", r"^[+-]?[0-9]+(\.[0-9]+)?$")]
#: Any of them: the test of every token, most of which have none of these forms.
_any_mask = "^(?:" + "|".join(p[1:-1] for _, p in MASKS) + ")$"
WILDCARD = "<*>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used: Spark computes arguments of functions over
    arrays anew wherever they stand."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.array_remove(F.split(text, _space), "")


def separators(text: Column) -> Column:
    """The white space before, between and after words: one more than there are words."""
    inner = F.regexp_extract_all(text, F.lit(f"({_space})"), F.lit(1))
    starts, ends = text.rlike("^" + _space), text.rlike(_space + "$")
    none = F.array(F.lit(""))
    # a text of white space only is one separator
    return F.when(~text.rlike("[^" + re.escape(SPACE) + "]"), F.array(text)).otherwise(F.concat(F.when(starts, F.array().cast("array<string>")).otherwise(none), inner, F.when(ends, F.array().cast("array<string>")).otherwise(none)))


def kind(token: Column) -> Column:
    """The kind of a masked token, or null."""
    out = F.when(token.rlike(MASKS[0][1]), MASKS[0][0])
    for name, pattern in MASKS[1:]:
        out = out.when(token.rlike(pattern), name)
    return out


def is_masked(token: Column) -> Column:
    """Whether a token has a kind; null for null."""
    return token.rlike(_any_mask)


def masked(words: Column) -> Column:
    return F.transform(words, lambda t: F.when(is_masked(t), F.lit(WILDCARD)).otherwise(t))


def params(words: Column) -> Column:
    """Masked tokens in order as (type_tag, value)."""
    number = lambda t: F.when(kind(t) == "UUID", UUID).when(kind(t) == "IP", IP).otherwise(NUM)
    return F.transform(F.filter(words, is_masked), lambda t: F.struct(number(t).alias("type_tag"), t.cast("binary").alias("value")))


def template_text(words: Column) -> Column:
    """Words joined by a space, wildcards for masked ones."""
    return F.array_join(masked(words), " ")


def template_words(text: Column) -> Column:
    return F.split(text, " ")


def similarity(template: Column, words: Column) -> Column:
    """Share of positions that agree; a wildcard agrees with everything, a masked word with no fixed one. In single
    precision, as thresholds are compared in it. Null for different lengths."""

    def score(x: Column) -> Column:
        same = F.zip_with(x["t"], x["w"], lambda a, b: F.when((a == WILDCARD) | ((a == b) & ~is_masked(b)), 1).otherwise(0))
        return F.when(F.size(x["t"]) == F.size(x["w"]), F.aggregate(same, F.lit(0), lambda s, y: s + y).cast("float") / F.size(x["w"]).cast("float")).cast("float")

    return let(F.struct(template.alias("t"), words.alias("w")), score)


def zone(score: Column, clean: float = 0.7, floor: float = 0.4) -> Column:
    return let(score, lambda s: F.when(s >= F.lit(clean).cast("float"), "clean").when(s >= F.lit(floor).cast("float"), "lossy").otherwise("failure"))


def capped(value: Column, most: int = 256) -> Column:
    """A parameter, or its length and hash where it is too long."""
    mark = F.concat(F.lit("OVERFLOW(length="), F.octet_length(value).cast("string"), F.lit(",sha256="), F.substring(F.sha2(value.cast("binary"), 256), 1, 16), F.lit(")"))
    return F.when(F.octet_length(value) > most, mark).otherwise(value)


def rebuilt(template: Column, values: Column, seps: Column) -> Column:
    """The text of a template's words with parameters at wildcards and white space between. Null where the numbers of
    parameters or separators don't fit."""
    # words and white space become one text with a mark at each wildcard; its pieces take the parameters between them
    mark = "\x00"

    def walk(x: Column) -> Column:
        t, v, s = x["t"], x["v"], x["s"]
        joined = F.array_join(F.zip_with(F.slice(s, F.lit(1), F.size(t)), t, lambda s, w: F.concat(s, F.when(w == WILDCARD, mark).otherwise(w))), "")
        pieces = F.split(F.concat(joined, F.element_at(s, -1)), mark)
        slots = F.size(t) - F.size(F.array_remove(t, WILDCARD))
        return F.when((slots == F.size(v)) & (F.size(s) == F.size(t) + 1), F.array_join(F.zip_with(pieces, F.concat(v, F.array(F.lit(""))), lambda p, v: F.concat(p, v)), ""))

    return let(F.struct(template.alias("t"), values.alias("v"), seps.alias("s")), walk)


def line_hash(text: Column) -> Column:
    """16 bytes that stand for a line."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


# The same in Python, for the miner's state machine.
_py_split = re.compile(f"({_plain}+)")
_py_masks = [(name, re.compile(p)) for name, p in MASKS]


class NulError(ValueError):
    pass


def split_line(line: str) -> tuple[list[str], list[str]]:
    """Words and the white space around them; a line with a NUL can't be split."""
    if "\0" in line:
        raise NulError
    parts = _py_split.split(line)
    words, seps = parts[::2], parts[1::2]
    # the pieces alternate, words first: an empty word at an end means that white space stands there
    lead = words and words[0] == ""
    trail = len(words) > 1 and words[-1] == ""
    kept = [w for w in words if w]
    if not kept:
        return [], [line]
    return kept, ([] if lead else [""]) + seps + ([] if trail else [""])


def word_kind(word: str) -> int | None:
    for name, pattern in _py_masks:
        if pattern.match(word) and not word.endswith("\n"):
            return KINDS.index(name)
    return None


def sample(line: str, most: int = 256) -> str:
    """The first bytes of a line, cut between characters."""
    return line.encode()[:most].decode("utf-8", "ignore")


def unify(text: str, template: list[str]) -> tuple[list[bytes], list[bytes]] | None:
    """Parameters and separators under which a template spells the text; None where it can't."""
    try:
        words, seps = split_line(text)
    except NulError:
        return None
    if len(words) != len(template) or any(t not in (WILDCARD, w) for t, w in zip(template, words, strict=True)):
        return None
    return [w.encode() for t, w in zip(template, words, strict=True) if t == WILDCARD], [s.encode() for s in seps]

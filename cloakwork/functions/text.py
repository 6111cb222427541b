"""Column functions on names, tags, tokens and identifiers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import STANDARD_ROOT


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def mask(c: Column) -> Column:
    """Up to two characters all hidden; else the first, at most eight dots, and the last."""
    n = F.char_length(c)
    dots = lambda k: F.repeat(F.lit("•"), k)
    return F.when(n <= 2, dots(n)).otherwise(F.concat(F.substring(c, 1, 1), dots(F.least(n - 2, F.lit(8))), F.substring(c, -1, 1)))


def tag_pattern(tag: str) -> str:
    return rf"(?is)(<{re.escape(tag)}\b[^>]*>)(.*?)(</{re.escape(tag)}>)"


def tag_values(text: Column, tag: str) -> Column:
    """The contents of all elements with this tag."""
    return F.regexp_extract_all(text, F.lit(tag_pattern(tag)), F.lit(2))


def set_tag(text: Column, tag: str, value: Column) -> Column:
    """The text with the content of every such element replaced."""
    safe = F.regexp_replace(value, r"([\\$])", r"\\$1")
    return F.regexp_replace(text, F.lit(tag_pattern(tag)), F.concat(F.lit("$1"), safe, F.lit("$3")))


def present_tags(text: Column, tags: list[str]) -> Column:
    """Those of the tags, in lower case and in their order, that are opened anywhere in the text, in any case; one scan for all."""
    opened = F.regexp_extract_all(text, F.lit(r"<([A-Za-z_]\w*)"), F.lit(1))
    return F.array_intersect(F.array(*(F.lit(t.lower()) for t in tags)), F.transform(opened, F.lower))


def plain_tag(tag: str) -> bool:
    """Whether the tag is a word, as present_tags() sees it."""
    return re.fullmatch(r"[A-Za-z_]\w*", tag, re.ASCII) is not None


def _pattern_of(tag: Column) -> Column:
    return F.concat(F.lit("(?is)(<"), tag, F.lit(r"\b[^>]*>)(.*?)(</"), tag, F.lit(">)"))


def set_tags(text: Column, tags: list[str], value: Column) -> Column:
    """set_tag() for one tag after the other; only those that the text has cost a pass of their own."""
    if not tags or not all(map(plain_tag, tags)):
        for tag in tags:
            text = set_tag(text, tag, value)
        return text
    by = F.concat(F.lit("$1"), F.regexp_replace(value, r"([\\$])", r"\\$1"), F.lit("$3"))
    return F.aggregate(present_tags(text, tags), text, lambda acc, t: F.regexp_replace(acc, _pattern_of(t), by))


def values_of_tags(text: Column, tags: list[str]) -> Column:
    """tag_values() of all the tags together; they must be plain."""
    return F.flatten(F.transform(present_tags(text, tags), lambda t: F.regexp_extract_all(text, _pattern_of(t), F.lit(2))))


def longest_first(tokens: Column) -> Column:
    """Tokens by falling length, ties by code point."""
    keyed = F.transform(tokens, lambda t: F.struct((-F.char_length(t)).alias("n"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda x: x["t"])


def scrub(text: Column, tokens: Column, by: Column) -> Column:
    """Each token in turn replaced; `tokens` are in the order of replacement. Without a list (null) nothing is known to be clean: null.

    A token that a replacement makes with what lies beside it is replaced too, if its turn is still to come.
    """
    return F.aggregate(tokens, text, lambda acc, t: F.when(t.isNull(), acc).otherwise(F.replace(acc, t, by)))


def is_digits(c: Column) -> Column:
    return c.rlike(r"^\d+$")


def remappable(uid: Column) -> Column:
    """Neither empty nor the standard root nor below it."""
    return (uid != "") & (uid != STANDARD_ROOT) & ~F.startswith(uid, F.lit(STANDARD_ROOT + "."))


def salted_uid(salt: str) -> Callable[[Column], Column]:
    """A function from old to new UIDs: the same for the same salt in any run, 44 characters."""

    def new(uid: Column) -> Column:
        digest = F.sha2(F.concat(F.lit(salt), uid), 256)
        part = lambda at: F.lpad(F.conv(F.substring(digest, at, 15), 16, 10), 19, "0")
        return F.concat(F.lit("2.25.1"), part(1), part(16))

    return new


#: Fixed patterns: an identity number and a mobile number that stand alone.
PHI_PATTERNS = {"身份证号": r"\d{17}[\dXx]", "手机号": r"1[3-9]\d{9}"}


def alone(pattern: str) -> str:
    return rf"(?<![0-9A-Za-z]){pattern}(?![0-9A-Za-z])"


def around(text: Column, at: Column, length: Column) -> Column:
    """The hit at the 1-based position with 20 characters on either side."""
    start = F.greatest(F.lit(1), at - 20)
    return F.substring(text, start, at + length + 20 - start)


def token_position(text: Column, token: Column) -> Column:
    """1-based place of the first hit, 0 for none; a token of digits only hits between non-digits."""
    alone_at = F.regexp_instr(text, F.concat(F.lit(r"(?<!\d)"), F.when(is_digits(token), token).otherwise("0"), F.lit(r"(?!\d)")))
    return F.when(is_digits(token), alone_at).otherwise(F.position(token, text))

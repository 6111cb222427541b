"""Elements and attributes of raw HTML by column expressions, told apart as a browser tells them.

Every repeated group of the patterns is possessive: they run in a loop, without recursion, and never back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_END = r"[\t\n\f\r />]"
#: A name (group 1) and what follows the sign of equality (group 2, with its quotes).
_ATTRIBUTE = r"""([^\t\n\f\r />][^\t\n\f\r />=]*+)(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+("[^"]*+"|'[^']*+'|(?=>)|[^\t\n\f\r >"'][^\t\n\f\r >]*+))?+"""
_REST = "(?:" + _ATTRIBUTE.replace("([", "(?:[", 1).replace('("', '(?:"', 1) + r"|[\t\n\f\r /])*+>?+"
#: Comments and elements whose content is text, whole; then any opening tag.
_TOKEN = (
    r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))"
    rf"|<(script|style|textarea|title|xmp|iframe|noembed|noframes)(?={_END}){_REST}.*?(?:</\1(?={_END})|\z)"
    rf"|<[a-z][^\t\n\f\r />]*+{_REST}"
)
_PIECE = r"(?i)&#x[0-9a-f]++;?+|&#[0-9]++;?+|&(?:amp|lt|gt|quot)(?![;=0-9a-z])|&[a-z]++;|[^&]++|&"

#: Names of the characters that are written so in urls.
NAMED = {
    "amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "sol": "/", "bsol": "\\", "colon": ":", "semi": ";", "comma": ",", "period": ".", "quest": "?", "equals": "=",
    "num": "#", "percnt": "%", "commat": "@", "excl": "!", "dollar": "$", "ast": "*", "plus": "+", "lowbar": "_", "lpar": "(", "rpar": ")", "tab": "\t", "newline": "\n",
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once and written once in the plan."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def opening_tags(html: Column, names: list[str]) -> Column:
    """The opening tags of these elements (lower case), in order; none from comments, scripts or quoted values.

    A tag that the text ends in is no tag; null gives null.
    """
    every = F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0))
    return F.filter(every, lambda t: t.rlike(rf"(?is)^<(?:{'|'.join(names)}){_END}") & F.endswith(t, F.lit(">")))


def is_tag(tag: Column, name: str) -> Column:
    return tag.rlike(rf"(?is)^<{name}{_END}")


def attribute(tag: Column, name: str) -> Column:
    """The value of the first attribute of this name with its character references replaced; null if there is none."""
    def found(inner: Column) -> Column:
        named = F.transform(F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), F.lit(1)), F.lower)
        return F.get(F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), F.lit(2)), (F.array_position(named, F.lit(name)) - 1).cast("int"))

    bare = lambda v: F.when(v.rlike("^[\"']"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return unescaped(let(let(F.regexp_replace(tag, r"^<[^\t\n\f\r />]+", ""), found), bare))


def unescaped(value: Column) -> Column:
    """With references by number, and those of NAMED, replaced; a number that is no character gives U+FFFD."""
    names = F.create_map(*(F.lit(x) for pair in NAMED.items() for x in pair))

    def meant(p: Column) -> Column:
        hexes, tens = F.regexp_replace(p, "(?i)^&#x0*|;$", ""), F.regexp_replace(p, "^&#0*|;$", "")
        code = F.when(p.rlike("(?i)^&#x"), F.when(F.length(hexes).between(1, 6), F.conv(hexes, 16, 10))).otherwise(F.when(F.length(tens) <= 7, tens)).try_cast("long")
        known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
        word = F.try_element_at(names, F.lower(F.regexp_replace(p, "^&|;$", "")))
        return F.when(F.startswith(p, F.lit("&#")) & (p != "&#"), char).when(F.startswith(p, F.lit("&")), F.coalesce(word, p)).otherwise(p)

    whole = lambda v: F.array_join(F.transform(F.regexp_extract_all(v, F.lit(_PIECE), F.lit(0)), meant), "")
    return let(value, lambda v: F.when(F.contains(v, F.lit("&")), whole(v)).otherwise(v))

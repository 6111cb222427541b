"""Bytes of reports to text and back; vectorised helpers, as the code pages are not built in."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .shipping import ship

_DECLARED = re.compile(rb"encoding=[\"']([^\"']+)[\"']", re.IGNORECASE)


def _codec(name: str) -> bool:
    try:
        codecs.lookup(name)
    except LookupError:
        return False
    return True


#: Tried in turn after the declared code page; the last fits every file.
FALLBACK = ("gbk", "utf-8", "latin-1")


def decode_one(data: bytes | None, fallback: tuple[str, ...] = FALLBACK) -> tuple[str | None, str | None]:
    """(text, declared encoding): the declared one, then the others are tried in turn; no text if none fits."""
    if data is None:
        return None, None
    told = _DECLARED.search(data[:200])
    name = told.group(1).decode("ascii", "ignore") if told else "utf-8"
    for encoding in (name, *fallback):
        try:
            return data.decode(encoding), name
        except (LookupError, UnicodeDecodeError):
            continue
    return None, name


def decode_report(content: Column) -> Column:
    """struct<text, encoding> of a report's bytes."""

    ship(SparkSession.active())

    @F.pandas_udf("text string, encoding string")
    def decode(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_one(None if x is None else bytes(x)) for x in data], columns=["text", "encoding"])

    return decode(content)


def encode_one(text: str | None, encoding: str | None) -> bytes | None:
    return None if text is None else text.encode(encoding if encoding and _codec(encoding) else "gbk", "xmlcharrefreplace")


def encode_report(text: Column, encoding: Column) -> Column:
    """The bytes in the declared encoding (gbk if unknown); what does not fit becomes character references."""

    ship(SparkSession.active())

    @F.pandas_udf("binary")
    def encode(texts: pd.Series, encodings: pd.Series) -> pd.Series:
        return pd.Series([encode_one(t, e) for t, e in zip(texts, encodings, strict=True)], dtype=object)

    return encode(text, encoding)

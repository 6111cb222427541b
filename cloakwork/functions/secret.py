"""The secret of a run, by which identifiers are replaced so that nobody without it can compute them again.

What the jobs need of it are the two padded keys of HMAC. They travel as a table of one row, so that no plan and no log shows them.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import rename

BLOCK = 64
LEAST = 16
PADS = "_inner binary, _outer binary"


def new_secret() -> bytes:
    return secrets.token_bytes(32)


def pads(secret: bytes) -> tuple[bytes, bytes]:
    """The inner and outer key of HMAC-SHA256 for secrets up to its block size; short ones are refused, as they can be guessed."""
    if len(secret) < LEAST:
        raise ValueError(f"a secret needs {LEAST} bytes or more; an empty or short one can be guessed")
    if len(secret) > BLOCK:
        raise ValueError(f"a secret has at most {BLOCK} bytes")
    key = secret.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def secret_table(spark: SparkSession, secret: bytes | None = None) -> DataFrame:
    """One row (_inner, _outer) of the secret given, or else of one made once for this application."""
    if secret is None:
        context = spark.sparkContext
        secret = context._own_secret = getattr(context, "_own_secret", None) or new_secret()
    inner, outer = pads(secret)
    return spark.createDataFrame([(bytearray(inner), bytearray(outer))], PADS)


def kept_secret(spark: SparkSession, private: str, secret: bytes | None = None) -> DataFrame:
    """The secret of a private folder: what an earlier run has put there, else a new one (or the given), written there.

    It is put there under its name as a whole and only if there is none, so of two runs at the same time both use that of the first.
    """
    folder = f"{private.rstrip('/')}/secret"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        staged = f"{private.rstrip('/')}/.secret-{secrets.token_hex(8)}"
        secret_table(spark, secret or new_secret()).coalesce(1).write.parquet(staged)
        if not rename(spark, staged, folder):
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(staged), True)
    return spark.read.schema(PADS).parquet(folder)


def hmac_sha256(message: Column, inner: Column, outer: Column) -> Column:
    """The keyed digest in hex."""
    first = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.sha2(F.concat(outer, first), 256)


def uid_of(digest: Column) -> Column:
    """A UID of 44 characters from a digest's first 30 hex digits."""
    part = lambda at: F.lpad(F.conv(F.substring(digest, at, 15), 16, 10), 19, "0")
    return F.concat(F.lit("2.25.1"), part(1), part(16))


def keyed_uid(inner: Column, outer: Column) -> Callable[[Column], Column]:
    """A function from old to new UIDs: the same wherever the same secret is used."""
    return lambda uid: uid_of(hmac_sha256(uid, inner, outer))

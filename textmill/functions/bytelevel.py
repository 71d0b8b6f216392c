"""The bijection of bytes and printable characters that byte-level vocabularies are written in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SAME = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHER = [b for b in range(256) if b not in set(_SAME)]
#: The character of each byte.
ALPHABET = "".join(chr(b) if b in set(_SAME) else chr(256 + _OTHER.index(b)) for b in range(256))
_BYTES = {c: b for b, c in enumerate(ALPHABET)}
_TO = {b: c for b, c in enumerate(ALPHABET)}


def byte_level_encode(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TO)


def byte_level_decode(text: str) -> bytes | None:
    """None if a character isn't of the alphabet."""
    try:
        return bytes([_BYTES[c] for c in text])
    except KeyError:
        return None


def byte_level_decode_bytes(raw: bytes) -> bytes | None:
    try:
        return byte_level_decode(raw.decode("utf-8"))
    except UnicodeDecodeError:
        return None


def is_byte_level_char(c: str) -> bool:
    return c in _BYTES


def get_byte_level_char(b: int) -> str:
    return ALPHABET[b]


def get_byte_level_byte(c: str) -> int | None:
    return _BYTES.get(c)


def alphabet(spark: SparkSession) -> DataFrame:
    return spark.range(256).select(F.col("id").cast("int").alias("byte"), F.substring(F.lit(ALPHABET), F.col("id").cast("int") + 1, F.lit(1)).alias("ch"))


_SOURCE = "".join(chr(b) for b in _OTHER)
_TARGET = "".join(ALPHABET[b] for b in _OTHER)


def encode_col(raw: Column) -> Column:
    """Of a binary column, as one JVM expression."""
    return F.translate(F.decode(raw, "ISO-8859-1"), _SOURCE, _TARGET)


def decode_col(text: Column) -> Column:
    """Null if a character isn't of the alphabet. Byte 0 goes apart, as ``translate`` deletes what it maps to it."""
    inside = text.rlike("^[\\x21-\\x7e\\xa1-\\xac\\xae-\\xff\\x{100}-\\x{143}]*\\z")
    zero = ALPHABET[0]
    back = F.translate(text, _TARGET.replace(zero, ""), _SOURCE.replace("\x00", ""))
    return F.when(inside, F.encode(F.replace(back, F.lit(zero), F.lit("\x00")), "ISO-8859-1"))


def decode_bytes_col(raw: Column) -> Column:
    return F.when(F.is_valid_utf8(raw.cast("string")), decode_col(F.try_validate_utf8(raw.cast("string"))))

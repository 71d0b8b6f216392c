"""Vocabulary files: a line to a token, its bytes in base64, the last space, its rank.

Read as text by Spark and parsed by built-in functions. ``duplicates`` says which of several ranks of the same bytes
counts: that of the ``last`` line or of the ``first``.
"""

from __future__ import annotations

import base64
import binascii

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.errors import VocabError

LIMIT = (1 << 31) - 1
#: With its padding, which Spark's decoder would do without.
_BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"


def parse(data: bytes) -> list[tuple[bytes, int]]:
    """(bytes, rank) of all lines, in order."""
    out = []
    for line in data.split(b"\n"):
        if not line:
            continue
        left, space, right = line.rpartition(b" ")
        if not space:
            raise VocabError("a line has no space between token and rank")
        try:
            token = base64.b64decode(left, validate=True)
        except binascii.Error as e:
            raise VocabError(f"bad base64: {e}") from e
        text = right.decode("utf-8", "replace").strip()
        digits = text.removeprefix("+")
        if not (digits.isascii() and digits.isdigit()) or int(digits) > LIMIT:
            raise VocabError(f"bad rank: {text!r}")
        out.append((token, int(digits)))
    return out


def read_bytes(path: str) -> bytes:
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError as e:
        raise VocabError(f"{path} can't be read: {e}") from e


def encoder_of(rows: list[tuple[bytes, int]], duplicates: str = "last") -> dict[bytes, int]:
    if duplicates == "last":
        return dict(rows)
    return dict(reversed(rows))


def build_decoder(encoder: dict[bytes, int]) -> dict[int, bytes]:
    return {rank: token for token, rank in encoder.items()}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a file; a vocabulary is one small file, numbered as it stands."""
    return numbered(spark.read.text(path, wholetext=True))


def numbered(whole: DataFrame) -> DataFrame:
    """(line_no, line) of a whole text in ``value``."""
    return whole.select(F.posexplode(F.split("value", "\n")).alias("line_no", "line")).where("line <> ''")


def parsed(lines: DataFrame) -> DataFrame:
    """(token, rank, line_no); a bad line is an error when it is read."""
    left, right = F.regexp_extract("line", "(?s)^(.*) ([^ ]*)$", 1), F.trim(F.regexp_replace(F.regexp_extract("line", "(?s)^(.*) ([^ ]*)$", 2), r"\s", " "))
    bad = F.raise_error(F.concat(F.lit("bad line in a vocabulary: "), "line"))
    rank = F.when(F.col("line").contains(" ") & right.rlike(r"^\+?[0-9]+$"), right.cast("int")).otherwise(bad.cast("int"))
    token = F.when(left.rlike(_BASE64), F.to_binary(left, F.lit("base64"))).otherwise(bad.cast("binary"))
    return lines.select(token.alias("token"), rank.alias("rank"), F.col("line_no").cast("bigint").alias("line_no"))


def read_vocab(spark: SparkSession, path: str, duplicates: str = "last") -> DataFrame:
    """(token, rank), one row for each token."""
    return resolve(parsed(lines(spark, path)), duplicates)


def resolve(rows: DataFrame, duplicates: str = "last") -> DataFrame:
    pick = F.max_by if duplicates == "last" else F.min_by
    return rows.groupBy("token").agg(pick("rank", "line_no").alias("rank"))


def invert(vocab: DataFrame) -> DataFrame:
    return vocab.select(F.col("rank").alias("token_id"), "token")


def full_decoder(rows: DataFrame) -> DataFrame:
    """All ids, also those of tokens that another line has as well."""
    return rows.groupBy(F.col("rank").alias("token_id")).agg(F.max_by("token", "line_no").alias("token"))


def fallback_bytes(token):
    """A column of piece names with ``<0xNN>`` turned into that byte, all others into their UTF-8."""
    code = F.regexp_extract(token, "^<0x([0-9A-Fa-f]{2})>$", 1)
    return F.when(code != "", F.unhex(code)).otherwise(F.encode(token, "UTF-8"))


def line_column(token, rank):
    """A line of the format. Spark breaks base64 into lines, which the format has not."""
    return F.concat_ws(" ", F.regexp_replace(F.base64(token), r"\s", ""), rank.cast("string"))


def write_vocab(vocab: DataFrame, path: str) -> None:
    """One text file, by rank."""
    vocab.orderBy("rank").select(line_column(F.col("token"), F.col("rank")).alias("value")).coalesce(1).write.mode("overwrite").text(path)

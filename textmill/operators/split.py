"""Splitting texts into chunks, all in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.patterns import java


def chunks(text: Column, pattern: str) -> Column:
    """All matches in order; what no match covers is left out."""
    return F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(0))


def chunk_rows(df: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    return df.select(F.col(id_col), F.posexplode(chunks(F.col(text_col), pattern)).alias("chunk_ix", "chunk"))


def alternation(specials: list[str]) -> str:
    """A pattern for any of some strings, of which the match that ends first wins. So one that holds another which ends before it can never match, and is left out; of the others, the match that begins first also ends first."""
    specials = [s for s in specials if not any(t != s and 0 <= s.find(t) < len(s) - len(t) for t in specials)]
    return "|".join(re.escape(s) for s in sorted(specials, key=lambda s: (len(s), s)))


def segments(text: Column, specials: list[str]) -> Column:
    """A text cut at special tokens: array of (special, text), empty gaps left out."""
    any_special = F.lit(alternation(specials))
    gaps, found = F.split(text, any_special, -1), F.regexp_extract_all(text, any_special, F.lit(0))
    both = F.zip_with(gaps, found, lambda g, s: F.array(F.struct(F.lit(False).alias("special"), g.alias("text")), F.struct(F.lit(True).alias("special"), s.alias("text"))))
    return F.filter(F.flatten(both), lambda x: x["text"].isNotNull() & (x["text"] != ""))


def marked_chunks(text: Column, pattern: str, specials: list[str]) -> Column:
    """Chunks of all gaps with the special tokens between them: array of (special, text)."""

    def of(s: Column) -> Column:
        plain = F.transform(chunks(s["text"], pattern), lambda c: F.struct(F.lit(False).alias("special"), c.alias("text")))
        return F.when(s["special"], F.array(F.struct(F.lit(True).alias("special"), s["text"].alias("text")))).otherwise(plain)

    return F.flatten(F.transform(segments(text, specials), of))

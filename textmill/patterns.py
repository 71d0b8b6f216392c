"""The split patterns, put together from their parts.

They are written in the syntax that Python's ``regex`` and Java share. For Java, ``java`` adds the flag
that makes its classes those of Unicode.
"""

from __future__ import annotations

from textmill.errors import TokenizerError

_ENGLISH = "(?i:" + "|".join("'" + x for x in "s t re ve m ll d".split()) + ")"
_LETTER, _NUMBER = r"\p{L}", r"\p{N}"
_LEAD = rf"[^\r\n{_LETTER}{_NUMBER}]?"
_CAPITAL, _SMALL = ("[" + "".join(rf"\p{{{c}}}" for c in x.split()) + "]" for x in ("Lu Lt Lm Lo M", "Ll Lm Lo M"))
_BLANKS = [r"\s*[\r\n]+", r"\s+(?!\S)", r"\s+"]


def _marks(tail: str) -> str:
    return rf" ?[^\s\p{{L}}\p{{N}}]+[{tail}]*"


def _cased(end: str) -> list[str]:
    return [f"{_LEAD}{_CAPITAL}*{_SMALL}+{end}", f"{_LEAD}{_CAPITAL}+{_SMALL}*{end}"]


CL100K_BASE_PATTERN = "|".join([_ENGLISH, _LEAD + r"\p{L}+", r"\p{N}{1,3}", _marks(r"\r\n"), *_BLANKS])
O200K_BASE_PATTERN = "|".join([*_cased(_ENGLISH + "?"), r"\p{N}{1,3}", _marks(r"\r\n"), *_BLANKS])
LLAMA3_PATTERN = O200K_BASE_PATTERN
MISTRAL_V3_PATTERN = "|".join([*_cased(""), r"\p{N}", _marks(r"\r\n/"), *_BLANKS])
SENTENCEPIECE_PATTERN = r"[^\s]+|\s+"


def java(pattern: str) -> str:
    return "(?U)" + pattern


def compiled(pattern: str):
    """The pattern for use on the driver."""
    import regex

    try:
        return regex.compile(pattern)
    except regex.error as e:
        raise TokenizerError(f"the pattern doesn't compile: {e}") from e

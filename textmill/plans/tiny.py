"""A synthetic vocabulary of 286 lines for queries, tests and benchmarks, with the cases that vocabularies come with.

All single bytes; some English pieces, each the sum of two others; ``▁`` and ``▁the``, which no merge reaches; a second line for ``z``; ``aXb``, which no merge reaches either.
"""

from __future__ import annotations

import base64

from textmill.functions.bytelevel import byte_level_encode

_PIECES = "he in an on en er re th the nt ti tio tion and _t _the ou _a _and oun ing _an ent é ment me".split()
LINES: list[tuple[bytes, int]] = [(bytes([b]), b) for b in range(256)] + [(t.replace("_", " ").encode(), 256 + k) for k, t in enumerate([*_PIECES, "▁", "▁the", "z", "aXb"])]
FILE = "\n".join(f"{base64.b64encode(t).decode()} {k}" for t, k in LINES) + "\n"
SPECIALS = {"<|sep|>": 300, "<|pad|>": 301, "<|think|>": 302, "<|/think|>": 303}
CHAT = SPECIALS | {"<|im_start|>": 304, "<|im_end|>": 305, "<|fim_prefix|>": 306, "<|fim_middle|>": 307, "<|fim_suffix|>": 308}
#: The same tokens in the byte alphabet.
MAPPED_FILE = "\n".join(f"{base64.b64encode(byte_level_encode(t).encode()).decode()} {k}" for t, k in LINES) + "\n"

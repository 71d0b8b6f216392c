"""Chat templates as black boxes: each turn's span, found by rendering successive prefixes of a conversation.

A template is a function from messages to text. Of the renderings of k - 1 and of k turns, the longest common start and then
the longest common end (a closing mark that moves along) are cut off; what is left of the longer is the span of turn k. If what is
left of the shorter isn't empty, the template rewrote history: the span then covers all that
changed, and ``rewritten_from`` is the first turn whose own span was touched.

Defined results: turns are ordered by number, rows of the same number by role and text, nulls first; a null role or text is rendered as an empty one.
A row of null id is a conversation by itself: nothing tells what it belongs to, and together such rows could be any number. A turn that a template doesn't render has an empty span. Repeated rows are turns each.
Rows that end in the same character on both sides are ambiguous; the common start wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Message = dict[str, str]


def chatml(messages: list[Message]) -> str:
    return "".join(f"<|im_start|>{m['role']}\n{m['content']}<|im_end|>\n" for m in messages)


def headers(messages: list[Message]) -> str:
    return "<|begin_of_text|>" + "".join(f"<|start_header_id|>{m['role']}<|end_header_id|>\n\n{m['content'].strip()}<|eot_id|>" for m in messages)


def closed(messages: list[Message]) -> str:
    """One document with a closing mark that moves along."""
    return "<s>" + "".join(f"[{m['role'].upper()}] {m['content']} " for m in messages) + "</s>"


def system_last(messages: list[Message]) -> str:
    """System texts are put before the last user's turn: history changes with each user's turn."""
    system = "\n\n".join(m["content"] for m in messages if m["role"] == "system")
    users = [k for k, m in enumerate(messages) if m["role"] == "user"]
    out = []
    for k, m in enumerate(messages):
        if m["role"] == "user":
            own = f"{system}\n\n{m['content']}" if system and k == users[-1] else m["content"]
            out.append(f"[INST] {own} [/INST]")
        elif m["role"] != "system":
            out.append(f" {m['content']}</s>")
    return "".join(out)


TEMPLATES: dict[str, Callable[[list[Message]], str]] = {"chatml": chatml, "headers": headers, "closed": closed, "system_last": system_last}


def common_start(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def spans(template: Callable[[list[Message]], str], messages: list[Message]) -> list[tuple[int, int, bool, int | None]]:
    """For each turn: where its span begins and ends in the rendering up to it, whether history was rewritten, and from which turn on."""
    out: list[tuple[int, int, bool, int | None]] = []
    before = np.frombuffer(template([]).encode("utf-32-le", "surrogatepass"), np.uint32)
    own: list[tuple[int, int]] = []
    for k in range(1, len(messages) + 1):
        now = np.frombuffer(template(messages[:k]).encode("utf-32-le", "surrogatepass"), np.uint32)
        start = common_start(before, now)
        end = common_start(before[start:][::-1], now[start:][::-1])
        rewritten = start + end < len(before)
        touched = next((i for i, (_, e) in enumerate(own) if e > start), None) if rewritten else None
        out.append((start, len(now) - end, rewritten, touched))
        own.append((start, len(now) - end))
        before = now
    return out


RESULT = "conv_id bigint, turn bigint, role string, template string, begin int, stop int, rewritten boolean, rewritten_from bigint"


def locate(conversations: DataFrame, templates: dict[str, Callable[[list[Message]], str]] | None = None) -> DataFrame:
    """A row for each template and turn; places count characters of the rendering up to that turn."""
    templates = templates or TEMPLATES
    turns = conversations.select("conv_id", F.struct("turn", "role", "text").alias("m"))
    whole = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m")).union(turns.where("conv_id is null").select("conv_id", F.array("m")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("template", pa.string()), ("begin", pa.int32()), ("stop", pa.int32()), ("rewritten", pa.bool_()), ("rewritten_from", pa.int64())])
        for b in batches:
            rows = []
            for conv, turns in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                messages = [{"role": t["role"] or "", "content": t["text"] or ""} for t in turns]
                for name, template in templates.items():
                    for t, (start, stop, rewritten, touched) in zip(turns, spans(template, messages)):
                        rows.append((conv, t["turn"], t["role"], name, start, stop, rewritten, None if touched is None else turns[touched]["turn"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    return whole.mapInArrow(run, RESULT)


def rewriters(located: DataFrame) -> DataFrame:
    """Of each template: its turns, and how many rewrote history."""
    return located.groupBy("template").agg(F.count("*").alias("turns"), F.count_if("rewritten").alias("rewriting_turns"))

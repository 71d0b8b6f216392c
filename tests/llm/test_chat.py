import random

import pytest

from tests.llm.helpers import clashing, long_text, words
from textmill.llm import chat

TURNS = "conv_id bigint, turn bigint, role string, text string"


def brute(template, messages):
    out, before = [], template([])
    for k in range(1, len(messages) + 1):
        now = template(messages[:k])
        a = 0
        while a < min(len(before), len(now)) and before[a] == now[a]:
            a += 1
        b = 0
        while b < min(len(before), len(now)) - a and before[-1 - b] == now[-1 - b]:
            b += 1
        out.append((a, len(now) - b, a + b < len(before)))
        before = now
    return out


@pytest.mark.parametrize("name", list(chat.TEMPLATES))
@pytest.mark.parametrize("seed", range(5))
def test_spans_against_a_loop(name, seed):
    r = random.Random(seed)
    messages = [{"role": r.choice(["system", "user", "assistant"]), "content": r.choice(["", "aa", words(k, 5, 3), "</s>", "é🙂"])} for k in range(8)]
    got = chat.spans(chat.TEMPLATES[name], messages)
    assert [g[:3] for g in got] == brute(chat.TEMPLATES[name], messages)


@pytest.mark.parametrize("name", ["chatml", "headers", "closed"])
def test_spans_hold_their_turns(name):
    messages = [{"role": r, "content": c} for r, c in (("user", "first question"), ("assistant", "an answer"), ("user", "and more"))]
    for k, (a, b, rewritten, touched) in enumerate(chat.spans(chat.TEMPLATES[name], messages)):
        assert messages[k]["content"] in chat.TEMPLATES[name](messages[: k + 1])[a:b]
        assert not rewritten and touched is None


def test_rewriting_is_found(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hello"), (1, 2, "assistant", "hi"), (1, 3, "user", "bye")]
    got = chat.locate(spark.createDataFrame(rows, TURNS))
    by = {(r["template"], r["turn"]): r for r in got.collect()}
    assert by["system_last", 3]["rewritten"] and by["system_last", 3]["rewritten_from"] == 1
    assert not any(r["rewritten"] for (t, _), r in by.items() if t != "system_last")
    assert {r["template"]: r["rewriting_turns"] for r in chat.rewriters(got).collect()}["system_last"] == 1


def test_hard_cases(spark):
    rows = [(1, 1, "user", None), (1, 0, None, "x"), (1, 1, "user", None), (None, 0, "user", "a"), (None, None, "user", ""), (2, 0, "tool", long_text()), (2, 1, "user", "after")]
    df = clashing(spark.createDataFrame(rows, TURNS))
    got = chat.locate(df).collect()
    assert len(got) == len(rows) * len(chat.TEMPLATES)
    by = {(r["conv_id"], r["turn"], r["template"]): r for r in got}
    long = by[2, 0, "chatml"]
    assert long["stop"] - long["begin"] > 1_000_000 and by[2, 1, "chatml"]["begin"] == long["stop"]
    own = {"two": lambda m: "".join(f"[{x['content']}]" for x in m)}
    assert [(r["begin"], r["stop"]) for r in chat.locate(df.where("conv_id is null"), own).orderBy("turn").collect()] == [(0, 2), (0, 3)]


def test_empty_table(spark):
    assert chat.locate(spark.createDataFrame([], TURNS)).count() == 0

import hashlib
import re
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from tests.compare import connect, differ
from tests.llm.helpers import clashing, hard, long_text, rows, table, words
from textmill.llm import mixing


def brute(docs, weights=None, total=None, seed=0):
    """(doc_id, source, epoch, start, n, take), by a loop over each source."""
    by = defaultdict(list)
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    for d, text, source in docs:
        n = len(re.findall(r"[^ \t\n\r\f]+", text or ""))
        if n:
            by[source].append((md5(f"{seed}|{'' if d is None else d}|{md5(text)}"), d, n))
    totals = {s: sum(n for _, _, n in x) for s, x in by.items()}
    w = {s: (1 if weights is None else weights.get(s, 0)) for s in by}
    w = {s: x for s, x in w.items() if x > 0}
    goal, all_w = sum(totals[s] for s in w) if total is None else total, sum(w.values())
    budget = {s: goal * x // all_w for s, x in w.items()}
    rest = sorted(w, key=lambda s: (-(goal * w[s] % all_w), "" if s is None else f"={s}"))
    for s in rest[: goal - sum(budget.values())]:
        budget[s] += 1
    out = []
    for s, b in budget.items():
        left, epoch = b, 0
        while left:
            at = 0
            for _, d, n in sorted(by[s], key=lambda x: x[0]):
                if take := min(n, left):
                    out.append((d, s, epoch, at, n, take))
                left, at = left - take, at + n
            epoch += 1
    return out


DOCS = [(k, words(k, 1 + k * 7 % 50), "abc"[k % 3] if k % 7 else None) for k in range(200)]


@pytest.mark.parametrize("weights,total", [(None, None), ({"a": 5, "b": 1, None: 2}, 10_001), ({"a": 1}, 7), ({"a": 1, "c": 3}, 50_000), ({"nobody": 1}, 100)])
def test_against_brute_force(spark, weights, total):
    docs = table(spark, [(d, t, "en", s) for d, t, s in DOCS])
    assert rows(mixing.mix_sources(docs, weights, total)) == sorted(brute(DOCS, weights, total), key=str)


def test_budgets_are_exact_and_texts_are_cut_there(spark):
    docs = table(spark, [(d, t, "en", s) for d, t, s in DOCS])
    got = mixing.mix_texts(docs, {"a": 2, "b": 1}, 3_000).collect()
    n = defaultdict(int)
    for r in got:
        n[r["source"]] += r["take_tokens"]
        assert len(r["text"].split()) == r["take_tokens"] and DOCS[r["doc_id"]][1].startswith(r["text"])
    assert n == {"a": 2000, "b": 1000}


def test_rows_that_repeat_keep_their_languages(spark):
    docs = table(spark, [(1, "x y", "en", "a"), (1, "x y", "de", "a"), (1, "x y", None, "a"), (2, "z", "fr", "a")])
    got = mixing.mix_texts(docs, total_tokens=7).collect()
    assert sorted(map(str, ((r["doc_id"], r["lang"], r["text"]) for r in got))) == sorted(map(str, [(1, "en", "x y"), (1, "de", "x y"), (1, None, "x y"), (2, "fr", "z")]))
    first = [r["lang"] for r in sorted((r for r in got if r["doc_id"] == 1), key=lambda r: r["start_token"])]
    assert first == [None, "de", "en"]


def test_hard_cases(spark):
    docs = clashing(table(spark, [*hard(), (10, long_text(), "en", "a")]))
    got = mixing.mix_sources(docs, total_tokens=900_001).collect()
    assert sum(r["take_tokens"] for r in got) == 900_001
    assert not {1, 2, 3} & {r["doc_id"] for r in got} and {None, "a", "b"} == {r["source"] for r in got}
    again = mixing.mix_texts(docs, total_tokens=900_001).collect()
    assert sorted(map(str, ((r["doc_id"], r["source"], r["epoch"], r["take_tokens"]) for r in got))) == sorted(map(str, ((r["doc_id"], r["source"], r["epoch"], r["take_tokens"]) for r in again)))


def test_sql_with_hard_cases(spark, tmp_path):
    docs = table(spark, [*hard(), (11, "one", "en", "a"), (11, "one", "en", "a")])
    pq.write_table(docs.toArrow(), tmp_path / "documents.parquet")
    assert differ(mixing.mix_sources(docs), connect(str(tmp_path)), mixing.SQL) == ""


def test_empty_table(spark):
    docs = table(spark, [])
    assert mixing.mix_sources(docs).count() == 0 and mixing.mix_texts(docs).count() == 0

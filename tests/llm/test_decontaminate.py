import math
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import clashing, hard, long_text, table, words
from textmill.llm import decontaminate as dc

ITEMS = "item_id bigint, text string"


def brute(docs, items, n=13, shortest=8):
    """For each document and item, how many runs of the item are in the document."""
    out = {}
    for i, t in items:
        t = t.lower().split()
        m = min(n, len(t))
        if len(t) < min(n, shortest):
            continue
        for d, text in docs:
            w = text.lower().split()
            there = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)}
            if hits := sum(tuple(t[k : k + m]) in there for k in range(len(t) - m + 1)):
                out[d, i] = hits
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_phrases_against_brute_force(spark, seed):
    r = random.Random(seed)
    items = [(k, words(100 + k, r.choice([5, 8, 12, 13, 30, 60]), 40)) for k in range(30)]
    docs = []
    for k in range(80):
        w = words(1000 + k, 150, 40).split()
        if k % 2:
            t = r.choice(items)[1].split()
            a = r.randrange(len(t))
            at = r.randrange(len(w))
            w[at:at] = t[max(0, a - 20) : a + 20]
        docs.append((k, " ".join(w)))
    got = dc.find_leaks(table(spark, docs), table(spark, items, ITEMS)).where("kind = 'exact'").collect()
    assert {(r["doc_id"], r["item_id"]): r["matched"] for r in got} == brute(docs, items)
    for r in got:
        w, t = docs[r["doc_id"]][1].split(), items[r["item_id"]][1].split()
        n = min(13, len(t))
        assert w[r["doc_position"] : r["doc_position"] + n] == t[r["item_position"] : r["item_position"] + n]


def test_near_matches(spark):
    item = words(5, 40, 5000).split()
    changed = [w if k % 9 else "other" for k, w in enumerate(item)]
    far = [w for x in item for w in (x, *words(6, 30).split())]
    docs = [(1, " ".join(["before"] * 20 + changed + ["after"] * 20)), (2, " ".join(far)), (3, " ".join(reversed(item)))]
    got = dc.find_leaks(table(spark, docs), table(spark, [(7, " ".join(item))], ITEMS)).collect()
    assert [(r["doc_id"], r["kind"]) for r in got] == [(1, "near")]


def near_brute(docs, items, anchors=24, stretch=32, agree=0.6, least=6, slop=10, shortest=8):
    """(document, item): the most anchors of a part that agree, by looking at every window of every document."""
    df = Counter(w for _, t in docs for w in t.split())
    out = {}
    for i, t in items:
        t = t.split()
        if len(t) < shortest:
            continue
        parts = [(0, len(t))] + ([(o, min(len(t), o + stretch)) for o in range(0, max(1, len(t) - stretch // 2), stretch // 2)] if len(t) > stretch else [])
        for lo, hi in parts:
            first = {}
            for p in sorted(range(lo, hi), key=lambda p: (df[t[p]], p)):
                first.setdefault(t[p], p)
            own = dict(list(first.items())[:anchors])
            needed = max(least, math.ceil(agree * len(own)))
            for d, text in docs:
                diagonal = sorted((p - own[w], w) for p, w in enumerate(text.split()) if w in own)
                best = max((len({w for x, w in diagonal if a <= x <= a + slop}) for a, _ in diagonal), default=0)
                if len(own) >= least and best >= needed:
                    out[d, i] = max(out.get((d, i), 0), best)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_matches_against_brute_force(spark, seed):
    r = random.Random(seed)
    items = [(k, words(300 + k, r.choice([6, 10, 25, 50, 59]), 300)) for k in range(24)]
    docs = []
    for k in range(60):
        w = words(2000 + k, 120, 300).split()
        t = r.choice(items)[1].split()
        if k % 3 == 0:  # an edited half of an item
            a = r.randrange(max(1, len(t) - len(t) // 2))
            t = t[a : a + len(t) // 2 + 1]
        t = [x if r.random() > 0.12 else r.choice(["", "new words", "other"]) for x in t]
        w[40:40] = " ".join(t).split()
        docs.append((k, " ".join(w)))
    got = dc.find_leaks(table(spark, docs), table(spark, items, ITEMS)).where("kind = 'near'").collect()
    want = near_brute(docs, items)
    assert {(x["doc_id"], x["item_id"]): x["matched"] for x in got} == want and len(want) > 20


def test_an_edited_part_of_an_item_is_near(spark):
    item = words(8, 64, 5000).split()
    part = [w if k % 10 != 4 else "other" for k, w in enumerate(item[:32])]
    docs = table(spark, [(1, " ".join([*words(1, 50, 5000).split(), *part, *words(2, 50, 5000).split()])), (2, words(3, 150, 5000))])
    assert [r["doc_id"] for r in dc.find_leaks(docs, table(spark, [(1, " ".join(item))], ITEMS)).collect()] == [1]


def test_case_and_marks_don_t_matter(spark):
    t = "Alpha beta gamma, delta: epsilon zeta eta theta!"
    got = dc.drop_leaks(table(spark, [(1, "x " + t.upper().replace(" ", "  ")), (2, "nothing of it")]), table(spark, [(1, t)], ITEMS))
    assert [r["doc_id"] for r in got.collect()] == [2]


def test_other_texts_of_an_id_stay(spark):
    leak, clean = words(3, 30), "clean words that nobody tests"
    docs = table(spark, [(1, leak), (1, clean), (None, clean), (None, leak), (2, leak)])
    got = dc.drop_leaks(docs, table(spark, [(1, leak)], ITEMS)).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got) == [(-1, clean), (1, clean)]


def test_postings_round_trip():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**28, 2**35 - 1])
    raw, size = dc.pack(x)
    assert (dc.unpack(raw) == x).all() and size.sum() == len(raw)
    assert len(dc.unpack(np.zeros(0, np.uint8))) == 0


def test_shards_don_t_show(spark, monkeypatch):
    docs = table(spark, [(k, words(k, 100, 30)) for k in range(40)]).coalesce(1)
    items = table(spark, [(k, words(k, 100, 30)) for k in range(0, 40, 3)], ITEMS)
    rows = lambda: sorted(map(tuple, dc.find_leaks(docs, items).collect()))
    whole = rows()
    monkeypatch.setattr(dc, "SHARD_TOKENS", 250)
    monkeypatch.setattr(dc, "ROUND_ITEMS", 4)
    assert rows() == whole and whole


def test_hard_cases(spark):
    leak = words(3, 30)
    docs = clashing(table(spark, [*hard(leak), (10, long_text() + " " + leak), (11, "clean words that nobody tests")]))
    items = table(spark, [(1, leak), (1, leak), (2, None), (3, ""), (None, words(4, 30)), (4, "too short")], ITEMS)
    found = dc.find_leaks(docs, items).where("kind = 'exact'").collect()
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in found) == [(-1, 1), (4, 1), (5, 1), (6, 1), (10, 1)]
    kept = dc.drop_leaks(docs, items)
    assert sorted(kept.columns) == sorted(docs.columns)
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect()) == [1, 2, 3, 11]


@pytest.mark.parametrize("docs,items", [([], [(1, "a b c d e f g h i j")]), ([(1, "a b c d e f g h i j")], [])])
def test_empty_tables(spark, docs, items):
    docs, items = table(spark, docs), table(spark, items, ITEMS)
    assert dc.find_leaks(docs, items).count() == 0
    assert dc.drop_leaks(docs, items).count() == docs.count()


@pytest.mark.parametrize("seed", range(6))
def test_crowded_keeps_every_window_that_holds_enough(seed):
    r = np.random.default_rng(seed)
    for spread in (40, 3000, 10**7):
        x = np.concatenate([r.integers(-spread, spread, 300), r.integers(-spread, spread) + r.integers(0, 11, 9)])
        for needed in (1, 6, 9):
            want = {i for a in x for i in np.flatnonzero((x >= a) & (x <= a + 10)) if ((x >= a) & (x <= a + 10)).sum() >= needed}
            got = set(dc.crowded(x, needed, 10).tolist())
            assert want <= got
            if spread == 10**7 and needed > 1:
                assert len(got) < 40
    assert len(dc.crowded(np.zeros(0, np.int64), 1, 10)) == 0


def test_only_crowded_postings_are_mapped_to_documents(monkeypatch):
    """Common words stand in every document; what was once mapped for each item was all their postings."""
    r = np.random.default_rng(1)
    n, size = 200, 250
    s = dc.Shard(dc._shard([r.integers(0, 300, n * size).astype(np.uint64)], list(range(n)), list(range(0, n * size, size)), "x"))
    mapped, doc = [], dc.Shard.doc
    monkeypatch.setattr(dc.Shard, "doc", lambda self, place: (mapped.append(len(place)), doc(self, place))[1])
    terms = r.permutation(300)[:24].astype(np.int32)
    parts = dc.Parts([(0, np.arange(24, dtype=np.int32), terms, 15)])
    at, places = s.find(np.arange(300, dtype=np.uint64)), lambda t: s.places(at[t])
    assert list(parts.find(s, at, places, 10)) == []
    assert sum(mapped) < 0.01 * sum(len(places(t)) for t in terms)

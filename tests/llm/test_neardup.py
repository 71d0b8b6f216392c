import random

import numpy as np
import pytest

from tests.llm.helpers import clashing, hard, long_text, rows, table, words
from textmill.llm import neardup


def shingles(text):
    t = text.lower().split()
    return {tuple(t[i : i + 3]) for i in range(len(t) - 2)} or {tuple(t)}


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def corpus(seed, n=60):
    r = random.Random(seed)
    out = []
    for k in range(n):
        base = words(seed * 1000 + k, 120)
        out.append(base)
        for _ in range(r.randrange(4)):
            t = base.split()
            for _ in range(r.choice([0, 1, 3, 8, 25])):
                t[r.randrange(len(t))] = f"x{r.randrange(1000)}"
            out.append(" ".join(t))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_and_precision_against_brute_force(spark, seed):
    texts = corpus(seed)
    got = {r[0]: r[1] for r in neardup.near_duplicates(table(spark, list(enumerate(texts)))).collect()}
    true = [(i, j) for i in range(len(texts)) for j in range(i) if alike(texts[i], texts[j]) >= 0.5]
    found = [(i, j) for i, j in true if i in got and got[i] == got.get(j)]
    assert len(found) >= 0.95 * len(true)
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in true:
        a, b = sorted((top(i), top(j)))
        parent[b] = a
    # no group is larger than a component of true pairs
    assert all(top(i) == top(g) for i, g in got.items())


@pytest.mark.parametrize("few", [0, 4])
def test_large_buckets_are_joined_without_loss(spark, monkeypatch, few):
    """Texts that share a long passage meet in one bucket, whatever else they hold; with the prefix join for buckets of more than ``few``."""
    shared = words(77, 30)
    texts = [f"{shared} {words(k // 2, 20, 5000)} {'' if k % 2 else 'z z2 z3'}" for k in range(60)] + [f"{shared} {words(900, 20, 5000)} v{k}" for k in range(40)]
    docs = table(spark, list(enumerate(texts)))
    whole = rows(neardup.near_duplicates(docs, threshold=0.7))
    monkeypatch.setattr(neardup, "FEW", few)
    split = rows(neardup.near_duplicates(docs, threshold=0.7))
    true = [(i, j) for i in range(100) for j in range(i) if alike(texts[i], texts[j]) >= 0.7]
    group = {r[0]: r[1] for r in split}
    assert len(true) > 700 and all(group[i] == group[j] for i, j in true)
    assert whole == split


def test_jaccard_in_pieces(spark, monkeypatch):
    r = random.Random(3)
    sets = [(sorted(r.sample(range(60), r.randrange(1, 40))), sorted(r.sample(range(60), r.randrange(1, 40)))) for _ in range(200)] + [([], []), ([1], [])]
    packed = spark.createDataFrame([(k, np.array(a, np.uint32).tobytes(), np.array(b, np.uint32).tobytes()) for k, (a, b) in enumerate(sets)], "k int, a binary, b binary").coalesce(1)
    monkeypatch.setattr(neardup, "COMPARED", 300)
    got = {x[0]: x[1] for x in packed.select("k", neardup.jaccard("a", "b")).collect()}
    for k, (a, b) in enumerate(sets):
        assert got[k] == pytest.approx(len({*a} & {*b}) / max(1, len({*a} | {*b})))


def test_one_of_each_group_stays(spark):
    texts = corpus(3)
    docs = table(spark, list(enumerate(texts)))
    found = neardup.near_duplicates(docs).collect()
    kept = {r["doc_id"] for r in neardup.drop_near_duplicates(docs).collect()}
    assert kept == set(range(len(texts))) - {r["doc_id"] for r in found if not r["keep"]}
    assert all(r["group_id"] in kept and r["n_docs"] >= 2 for r in found)


def test_thousands_of_copies_and_chains(spark):
    base = words(9, 200).split()
    chain = [" ".join(base[k * 6 :] + [f"y{i}" for i in range(k * 6)]) for k in range(12)]
    docs = table(spark, [(k, " ".join(base)) for k in range(3000)] + [(5000 + k, t) for k, t in enumerate(chain)])
    got = neardup.near_duplicates(docs).collect()
    assert {r["group_id"] for r in got} == {0} and len(got) == 3012


def test_hard_cases(spark):
    docs = clashing(table(spark, [*hard(), (7, "two words"), (8, "Two WORDS"), (9, "two words more"), (10, long_text()), (11, long_text() + " end")]))
    got = {(r["doc_id"], r["group_id"], r["keep"]) for r in neardup.near_duplicates(docs).collect()}
    assert {(7, 7, True), (8, 7, False), (10, 10, True), (11, 10, False), (6, 4, False)} <= got
    assert not {1, 2, 3, 9} & {d for d, _, _ in got}
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"][:9] if r["text"] else r["text"]) for r in kept.collect()) == [(1, None), (2, ""), (3, "   \n\t "), (4, "plain wor"), (7, "two words"), (9, "two words"), (10, long_text()[:9])]


def test_repeated_rows_of_one_id(spark):
    docs = table(spark, [(1, "the same long enough text")] * 3 + [(2, "another one that stands alone")])
    assert rows(neardup.drop_near_duplicates(docs).select("doc_id")) == [(1,), (2,)]


def test_other_texts_of_an_id_stay(spark):
    copy, clean = "the same long enough text", ["nobody else wrote this one", "nor has anyone seen that"]
    docs = table(spark, [(1, copy), (None, copy), (None, clean[0]), (2, copy), (2, clean[1])])
    assert rows(neardup.drop_near_duplicates(docs).select("doc_id", "text")) == sorted([(1, copy), (None, clean[0]), (2, clean[1])], key=str)


def test_empty_table(spark):
    docs = table(spark, [])
    assert neardup.near_duplicates(docs).count() == 0
    assert neardup.drop_near_duplicates(docs).count() == 0

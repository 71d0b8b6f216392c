import itertools

import numpy as np
import pytest

from tests.llm.helpers import clashing, hard, long_text, table
from textmill.llm import langid

EN = "the old house stands on the hill and nobody knows who built it there when the winter came"
DE = "das alte Haus steht auf dem Hügel und niemand weiß wer es dort gebaut hat als der Winter kam"
FR = "la vieille maison est sur la colline et personne ne sait qui l'a construite quand l'hiver est venu"


def pieces(text):
    w = text.split()
    return [" ".join(w[k:] + w[:k]) for k in range(len(w))]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate((t, lang) for text, lang in ((EN, "en"), (DE, "de"), (FR, "fr")) for t in pieces(text))]
    return langid.fit(table(spark, rows))


def brute(scores, penalty):
    best = None
    for path in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        v = sum(scores[i, s] for i, s in enumerate(path)) - penalty * sum(a != b for a, b in itertools.pairwise(path))
        best = v if best is None else max(best, v)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_against_all_paths(seed):
    r = np.random.default_rng(seed)
    sizes = [5, 0, 7, 1]
    scores = r.normal(0, 3, (sum(sizes), 3)).astype(np.float32)
    first = np.concatenate([[0], np.cumsum(sizes)])
    path = langid.viterbi(scores, first, 2.0)
    for a, b in itertools.pairwise(first):
        own = sum(scores[i, path[i]] for i in range(a, b)) - 2.0 * sum(path[i] != path[i + 1] for i in range(a, b - 1))
        assert b == a or own == pytest.approx(brute(scores[a:b], 2.0), abs=1e-3)


def test_blocks_don_t_show(monkeypatch):
    r = np.random.default_rng(7)
    scores = r.normal(0, 3, (1000, 4)).astype(np.float32)
    first = np.array([0, 900, 1000])
    whole = langid.viterbi(scores, first, 3.0)
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert (langid.viterbi(scores, first, 3.0) == whole).all()


def test_mixed_text_has_spans(spark, model):
    got = langid.identify(table(spark, [(1, f"{EN} {DE} {EN}"), (2, "Это русский текст о зиме"), (3, FR)]), model).orderBy("doc_id").collect()
    assert [s["lang"] for s in got[0]["spans"]] == ["en", "de", "en"]
    assert got[0]["lang"] == "en" and got[0]["accepted"] and got[0]["share"] > 0.6
    assert got[1]["lang"] == "ru" and not got[1]["accepted"]
    assert got[2]["lang"] == "fr" and got[2]["accepted"]
    assert all(a["last"] == b["first"] for a, b in itertools.pairwise(got[0]["spans"]))


def test_held_out_accuracy(spark):
    import os

    d = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(d):
        pytest.skip("no test data")
    docs = spark.read.parquet(d)
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    got = langid.identify(docs.where("doc_id % 2 = 1"), model).join(docs.selectExpr("doc_id", "lang AS truth"), "doc_id").where("accepted").collect()
    assert np.mean([r["lang"] == r["truth"] for r in got]) > 0.97


def test_long_noise_is_rejected_and_short_texts_are_not(spark, model):
    import random

    r = random.Random(1)
    noise = " ".join("".join(r.choice("qxzjkvwy") for _ in range(9)) for _ in range(3000))
    got = langid.identify(table(spark, [(1, noise), (2, "the house, xqzjv"), (3, EN + " token 9f8a7b6c5d")]), model).orderBy("doc_id").collect()
    assert [(x["lang"] == "und", x["accepted"]) for x in got] == [(True, False), (False, True), (False, True)]


FOREIGN = {
    "nl": "de oude man liep langzaam door de straat en keek naar de huizen die er al heel lang stonden zonder dat iemand wist wie daar vroeger gewoond had",
    "it": "la vecchia casa si trova sulla collina e nessuno sa chi la costruì quando arrivò l'inverno e tutte le strade erano coperte di neve bianca",
    "ca": "la vella casa es troba dalt del turó i ningú sap qui la va construir quan va arribar l'hivern i tots els camins eren coberts de neu",
}


def test_foreign_texts_are_rejected_though_some_rows_are_mislabelled(spark):
    rows = [(t, lang) for text, lang in ((EN, "en"), (DE, "de"), (FR, "fr")) for t in pieces(text) * 3]
    rows += [(DE, "en"), (FOREIGN["nl"], "de"), (EN, "fr")]
    fitted = langid.fit(table(spark, [(i, *r) for i, r in enumerate(rows)]))
    texts = [*FOREIGN.values(), EN, DE, FR]
    got = {r["doc_id"]: r["accepted"] for r in langid.identify(table(spark, [(k, f"{t} " * 12) for k, t in enumerate(texts)]), fitted).collect()}
    assert [got[k] for k in range(6)] == [False] * 3 + [True] * 3


def test_ties_go_to_the_first_by_name(spark):
    # the same text in two languages, so that every score ties
    fitted = langid.fit(table(spark, [(i, EN, lang) for i, lang in enumerate(["xb", "xa"] * 10)]))
    got = langid.identify(table(spark, [(1, EN), (1, EN)]), fitted).collect()
    assert [(r["lang"], r["share"], len(r["spans"])) for r in got] == [("xa", 1.0, 1)] * 2


def test_hard_cases(spark, model):
    docs = clashing(table(spark, [*hard(EN), (9, long_text()), (10, (EN + " ") * 10_000), (11, "12345 67890 !!"), (12, "a\x00b")]))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert len(got) == 11
    for k in (1, 2, 3):
        assert (got[k]["lang"], got[k]["share"], got[k]["spans"], got[k]["accepted"]) == ("zxx", 0.0, [], False)
    assert got[11]["lang"] == "zxx" and got[10]["lang"] == "en" and got[10]["share"] > 0.9
    kept = langid.drop_rejected(docs, model)
    assert kept.columns == docs.columns
    assert [r["doc_id"] for r in kept.collect()].count(5) == 2


def test_empty_table(spark):
    docs = table(spark, [])
    model = langid.fit(docs)
    assert model.langs == []
    assert langid.identify(docs, model).count() == 0
    assert langid.identify(table(spark, [(1, EN), (2, None)]), model).where("accepted").count() == 0


def test_numbers_say_nothing(spark, model):
    got = langid.identify(table(spark, [(1, "the house 4761598977407687 3523412345234534 98234234 it 19 37 233 111")]), model).first()
    assert (got["lang"], got["accepted"], got["share"]) == ("en", True, 1.0)

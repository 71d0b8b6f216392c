import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import clashing, hard, long_text, table, words
from textmill.llm import maxent
from textmill.llm.common import Workspace


def chain(seed, n=300):
    """Words of a second-order chain: predictable from what is before."""
    r = random.Random(seed)
    a, b, out = 0, 1, []
    for _ in range(n):
        a, b = b, (3 * a + 5 * b + r.randrange(2)) % 40
        out.append(f"t{b}")
    return " ".join(out)


@pytest.fixture(scope="module")
def model(spark):
    return maxent.train(table(spark, [(k, chain(k)) for k in range(300)]))


def test_held_out_text_is_predicted(spark, model):
    same, noise = chain(999), " ".join(random.Random(1).choice([f"t{k}" for k in range(40)]) for _ in range(300))
    got = {r["doc_id"]: r["perplexity"] for r in maxent.score(table(spark, [(1, same), (2, noise)]), model).collect()}
    # the words alone have a perplexity of about 40
    assert got[1] < 12 and got[2] > 25


def test_probabilities_add_up(model):
    context = np.array([3 << maxent._WIDE | 5, maxent._START << maxent._WIDE | maxent._START])
    by_class = np.exp(maxent._softmax(model.tables[0], maxent.features(context, maxent.CLASSES, maxent.ROWS_CLASS)))
    total = np.zeros(2)
    for c in range(maxent.CLASSES):
        total += by_class[:, c] * np.exp(maxent._softmax(model.tables[1], maxent.features(context, np.array([c, c]), maxent.ROWS_MEMBER))).sum(axis=1)
    assert np.allclose(total, 1, atol=1e-4)


def test_rare_words_cost_more_than_ordinary_ones(spark):
    r = random.Random(2)
    often, seldom = ([f"{x}{k}" for k in range(n)] for x, n in (("a", maxent.CLASSES * maxent.MEMBERS - maxent.TAIL), ("b", 400)))
    texts = [" ".join(often)] * 8 + [" ".join(seldom)] * 4 + [" ".join(f"c{k}x{j}" for j in range(100)) for k in range(40)]
    model = maxent.train(table(spark, list(enumerate(texts))))
    counts = maxent.slot_counts(table(spark, list(enumerate(texts))))
    # over the slots of a symbol, the shares add up
    tail = model.symbol >= maxent.CLASSES * maxent.MEMBERS - maxent.TAIL
    assert np.allclose(np.bincount(model.symbol[tail], np.exp(model.share[tail]))[-maxent.TAIL :], 1, atol=1e-3) and not model.share[~tail].any() and counts.sum() == 8 * len(often) + 4 * 400 + 4000
    known, unknown = (" ".join(f"{x}{r.randrange(400)}{y}" for _ in range(300)) for x, y in (("b", ""), ("q", "z")))
    got = {x["doc_id"]: x["perplexity"] for x in maxent.score(table(spark, [(1, known), (2, unknown)]), model).collect()}
    assert got[2] > 4 * got[1]


def test_scores_against_a_loop(spark, model):
    from textmill.llm.common import tokens_in

    text = chain(5, 40)
    import pyarrow as pa

    (_, _, t), = tokens_in(pa.array([text]))
    s = model.symbol[(t.hash >> np.uint64(64 - maxent.SLOT_BITS)).astype(int)].astype(int)
    own = maxent.CLASSES * maxent.MEMBERS - maxent.TAIL
    before = [maxent._START, maxent._START, *(int(x) if x < own else own + int(x) % maxent.TAIL_BEFORE for x in s)]
    total = 0.0
    for k, x in enumerate(s.tolist()):
        c = np.array([before[k] << maxent._WIDE | before[k + 1]])
        total += maxent._softmax(model.tables[0], maxent.features(c, maxent.CLASSES, maxent.ROWS_CLASS))[0, x // maxent.MEMBERS]
        total += maxent._softmax(model.tables[1], maxent.features(c, np.array([x // maxent.MEMBERS]), maxent.ROWS_MEMBER))[0, x % maxent.MEMBERS]
    r = maxent.score(table(spark, [(1, text)]), model).first()
    assert r["log_probability"] == pytest.approx(total, rel=1e-4) and r["n_tokens"] == 40
    assert r["perplexity"] == pytest.approx(np.exp(-total / 40), rel=1e-4)


def test_a_gradient_step_against_a_loop():
    r = np.random.default_rng(4)
    rows, width, contexts = 12, 5, 7
    table, seen, met = r.normal(size=(rows, width)).astype(np.float32), np.abs(r.normal(size=rows)).astype(np.float32) * 1e-3, np.zeros(rows, np.float32)
    feats = np.stack([r.integers(0, rows, contexts) for _ in range(4)])
    # distinct events, as _events gives them
    which, target = np.divmod(np.sort(r.choice(contexts * width, 25, replace=False)), width)
    times = r.integers(1, 4, 25)
    want, want_seen, want_met = table.astype(float), seen.astype(float), met.astype(float)
    gradient = np.zeros((contexts, width))
    for c in range(contexts):
        z = sum(want[feats[f, c]] for f in range(4))
        p = np.exp(z) / np.exp(z).sum()
        for w, t, n in zip(which, target, times):
            if w == c:
                gradient[c] -= n * p
                gradient[c, t] += n
    gradient /= times.sum()
    for f in range(4):
        by_row = {}
        for c in range(contexts):
            by_row.setdefault(int(feats[f, c]), []).append(c)
        for row, own in by_row.items():
            g = sum(gradient[c] for c in own)
            want_met[row] += sum(n for w, n in zip(which, times) if w in own)
            want_seen[row] += (g**2).mean()
            want[row] += 0.2 * g / np.sqrt(want_seen[row] + maxent.CALM)
    maxent._step(table, seen, met, feats, which, target, times, 0.2)
    assert np.allclose(table, want, rtol=1e-3, atol=1e-4) and np.allclose(seen, want_seen, rtol=1e-3) and np.allclose(met, want_met)


def test_tasks_are_averaged_by_how_often_they_met_a_row(spark):
    docs = table(spark, [(k, chain(k, 60)) for k in range(40)]).repartition(3).select("text")
    docs = Workspace(spark, "t").stash(docs, "docs")
    counts = maxent.slot_counts(docs)
    symbol = maxent.symbols(counts)
    start = maxent.Weights(counts, symbol, maxent.shares(counts, symbol))

    def changes(df):
        out = [(np.zeros(len(t)), np.zeros(t.shape)) for t in start.tables]
        for r in maxent.train_pass(df, start, 0.2).collect():
            n, c = np.frombuffer(r["met"], np.float32), np.frombuffer(r["change"], np.float32)
            out[r["table"]][0][r["strip"] : r["strip"] + len(n)] = n
            out[r["table"]][1][r["strip"] : r["strip"] + len(n)] = c.reshape(len(n), -1)
        return out

    parts = [[r[0] for r in docs.where(F.spark_partition_id() == k).collect()] for k in range(docs.rdd.getNumPartitions())]
    own = [changes(spark.createDataFrame([(t,) for t in p], "text string").coalesce(1)) for p in parts if p]
    both = changes(docs)
    for k in (0, 1):
        n = sum(x[k][0] for x in own)
        mean = sum(x[k][0][:, None] * x[k][1] for x in own) / np.maximum(n, 1e-9)[:, None]
        assert np.allclose(both[k][0], n) and np.allclose(both[k][1], mean, atol=1e-4)


def test_more_text_beats_the_unigram_by_more(spark):
    gains = []
    for n in (40, 600):
        docs = table(spark, [(k, chain(k)) for k in range(n)])
        r = maxent.score(docs, maxent.train(docs)).selectExpr("sum(log_probability) / sum(n_tokens) AS m").first()["m"]
        c = maxent.slot_counts(docs)
        c = c[c > 0] / c.sum()
        gains.append(r - float((c * np.log(c)).sum()))
    assert gains[1] > gains[0] > 0


def test_every_document_counts(spark):
    docs = table(spark, [(k, words(k, 50, 30)) for k in range(50)])
    assert maxent.slot_counts(docs).sum() == 2500
    assert len(np.unique(maxent.symbols(maxent.slot_counts(docs))[np.flatnonzero(maxent.slot_counts(docs))])) == 30


def test_hard_cases(spark, model, monkeypatch):
    docs = clashing(table(spark, [*hard(), (10, long_text())]))
    maxent.train(docs)
    got = {r["doc_id"]: r for r in maxent.score(docs, model).collect()}
    assert maxent.score(docs, model).count() == 9
    for k in (1, 2, 3):
        assert (got[k]["n_tokens"], got[k]["log_probability"], got[k]["perplexity"]) == (0, None, None)
    assert got[10]["n_tokens"] == 200_000 and got[4]["perplexity"] == got[6]["perplexity"] == got[None]["perplexity"]
    whole = got[10]["log_probability"]
    monkeypatch.setattr(maxent, "BLOCK", 1000)
    assert maxent.score(docs.where("doc_id = 10"), model).first()["log_probability"] == pytest.approx(whole, rel=1e-6)


def test_empty_table(spark):
    docs = table(spark, [])
    assert maxent.score(docs, maxent.train(docs)).count() == 0


def _case(contexts, rows=64, width=16, seed=7):
    r = np.random.default_rng(seed)
    table = r.normal(size=(rows, width)).astype(np.float32)
    which, target = np.divmod(np.sort(r.choice(contexts * width, 3 * contexts, replace=False)), width)
    return table, np.zeros(rows, np.float32), np.zeros(rows, np.float32), r.integers(0, rows, (4, contexts)), which, target, r.integers(1, 4, len(which))


def test_parts_of_a_step_don_t_show(monkeypatch):
    table, seen, met, feats, which, target, times = _case(100)
    whole, parts = ([x.copy() for x in (table, seen, met)] for _ in range(2))
    maxent._step(*whole, feats, which, target, times, 0.2)
    monkeypatch.setattr(maxent, "COLUMNS", 7)
    maxent._step(*parts, feats, which, target, times, 0.2)
    assert all((a == b).all() for a, b in zip(whole, parts)) and not (whole[0] == table).all()
    assert (maxent._picked(table, feats, which, target) == maxent._softmax(table, feats)[which, target]).all()


def test_a_step_holds_one_row_for_each_context():
    import tracemalloc

    case = _case(1 << 16)
    tracemalloc.start()
    maxent._step(*case, 0.2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * (1 << 16) * 16 * 4 + 4e6

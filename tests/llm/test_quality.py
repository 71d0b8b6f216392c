import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import clashing, hard, long_text, rows, table, words
from textmill.llm import quality
from textmill.llm.common import Workspace

N = quality.ORDER


def read(text):
    return " ".join("".join("0" if c.isdigit() else c for c in text.lower()).split())


class Plain:
    """Modified Kneser-Ney from its definition, in dictionaries."""

    def __init__(self, texts):
        self.counts = {N: Counter()}
        for t in texts:
            s = " " * (N - 1) + read(t)
            self.counts[N].update(s[i : i + N] for i in range(len(s) - N + 1))
        for k in range(N - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.d, self.total, self.lost = {}, {}, {}
        for k, c in self.counts.items():
            n = Counter(c.values())
            if all(n[j] for j in (1, 2, 3, 4)):
                y = n[1] / (n[1] + 2 * n[2])
                d = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
                self.d[k] = np.clip(d, [0, 0.05, 0.1, 0.15], [0, 1, 2, 3])
            else:
                self.d[k] = [0, 0.5, 1, 1.5]
            self.total[k], self.lost[k] = defaultdict(int), defaultdict(float)
            for g, x in c.items():
                self.total[k][g[:-1]] += x
                self.lost[k][g[:-1]] += self.d[k][min(x, 3)]

    def p(self, g):
        if not g:
            return 1 / (len(self.counts[1]) + 1)
        k = len(g)
        low = self.p(g[1:])
        if g[:-1] not in self.total[k]:
            return low
        x, h = self.counts[k][g], g[:-1]
        return (x - self.d[k][min(x, 3)] * (x > 0)) / self.total[k][h] + self.lost[k][h] / self.total[k][h] * low

    def mean(self, text):
        s = " " * (N - 1) + read(text)
        return -sum(math.log(self.p(s[i : i + N])) for i in range(len(s) - N + 1)) / (len(s) - N + 1)


def folds(spark, texts):
    return [r[0] for r in table(spark, [(k, t) for k, t in enumerate(texts)]).orderBy("doc_id").select(quality.fold()).collect()]


@pytest.mark.parametrize("most", [10**9, 12])
def test_against_the_definition(spark, most):
    texts = [words(k, 60, 40) + f" Année {k}" for k in range(12)] + [words(3, 60, 40) + " Année 3"]
    of = folds(spark, texts)
    plain = [Plain([t for t, f in zip(texts, of) if f == fold]) for fold in (0, 1)]
    docs = table(spark, [(k, t, "en") for k, t in enumerate(texts)])
    ws = Workspace(spark, "t")
    got = quality.score(docs, ws, most=most).orderBy("doc_id").collect()
    assert len(got) == len(texts) and (most > 12 or len(quality.rounds(quality.count_runs(docs), most)) >= 4)
    for r, t, f in zip(got, texts, of):
        assert r["n_symbols"] == len(read(t))
        assert r["log_perplexity"] == pytest.approx(plain[1 - f].mean(t), rel=1e-4)


def test_probabilities_add_up(spark):
    texts = [words(k, 60, 40) for k in range(12)]
    ws = Workspace(spark, "t")
    quality.fit(ws.stash(quality.count_runs(table(spark, [(k, t, "en") for k, t in enumerate(texts)])), "runs"), ws)
    model = quality.read_model(f"{ws.path}/model", ((("en", 0),), 1, 0))
    seen = sorted(set("".join(t for t, f in zip(texts, folds(spark, texts)) if f == 0)))
    c, _ = quality.symbols(pa.array(["".join(seen).replace(" ", "")], pa.large_string()))
    alphabet = np.unique(np.append(c, [32, ord("q")])).astype(np.uint64)  # q stands for all that is unseen
    for context in ("w0 w", "zzzz", " w00"):
        head = 0
        for x in context:
            head = head << 12 | ord(x)
        p = np.exp(model.log_p(np.uint64(head << 12) | alphabet, np.zeros(len(alphabet), np.int64))).sum()
        assert p == pytest.approx(1, abs=1e-4)


def test_counts_against_a_loop(spark):
    texts = [(k, words(k, 30, 9), "en" if k % 2 else None) for k in range(20)]
    got = Counter()
    for r in quality.count_runs(table(spark, texts)).collect():
        got[r["lang"]] += r["n"]
    assert got == Counter({"en": sum(len(read(t)) for _, t, x in texts if x), "": sum(len(read(t)) for _, t, x in texts if not x)})


def test_rounds_don_t_show(spark):
    docs = table(spark, [(k, words(k, 50, 30), ["en", "de", None, "fr"][k % 4]) for k in range(24)] + [(99, "", "it"), (100, None, "es"), (101, "eins zwei", "nl")])
    one, many = (quality.score(docs, Workspace(spark, "t"), most=n).withColumn("log_perplexity", F.round("log_perplexity", 4)) for n in (10**9, 30))
    assert rows(one) == rows(many) and one.count() == 27


def test_bands_reject_junk_and_keep_the_rest(spark):
    r = random.Random(3)
    good = [(k, words(k, 200, 60), "en") for k in range(150)]
    junk = [(1000, "".join(r.choice("!#%&/()=?{}[]<>~^") for _ in range(900)), "en"), (1001, "w1 " * 600, "en")]
    got = {x["doc_id"]: x["keep"] for x in quality.judge(table(spark, good + junk)).collect()}
    assert not got[1000] and all(got[k] for k, _, _ in good)


def test_hard_cases(spark):
    docs = clashing(table(spark, [*hard(), (10, long_text(), "en"), (11, words(1, 100), None), (12, "a\x00b c", "en"), (13, "x" * 500, "fr")]))
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert quality.judge(docs).count() == 12
    for k in (1, 2, 3):
        assert got[k]["n_symbols"] == 0 and got[k]["perplexity"] is None and got[k]["keep"]
    assert got[11]["lang"] is None and got[11]["perplexity"] > 1 and got[12]["n_symbols"] == 5
    assert got[4]["perplexity"] == pytest.approx(quality.judge(docs).where("doc_id = 4").first()["perplexity"]) and got[5]["perplexity"] == got[6]["perplexity"]


def test_empty_table(spark):
    assert rows(quality.judge(table(spark, []))) == []

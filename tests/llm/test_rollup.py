import random
from collections import Counter

import pytest

from tests.compare import connect, differ
from tests.llm.helpers import clashing, hard, long_text, rows, table
from textmill.llm import rollup
from textmill.llm.common import Workspace

CHANGES = "op string, source string, lang string, tokenizer string, n_tokens bigint, old_source string, old_lang string, old_tokenizer string, old_tokens bigint"
LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture
def own(spark):
    return rollup.Rollup(spark, Workspace(spark, "rollup-test").path)


def changes(seed, n=60):
    r = random.Random(seed)
    group = lambda: (r.choice(["a", "b", None]), r.choice(["en", None]), r.choice(["x", "y"]), r.randrange(50))
    none = (None,) * 4
    return [(op, *(none if op == "delete" else group()), *(none if op == "insert" else group())) for op in (r.choice(["insert", "delete", "revise"]) for _ in range(n))]


def brute(all_changes):
    docs, tokens = Counter(), Counter()
    for op, s, lang, v, n, s0, l0, v0, n0 in all_changes:
        if op in ("insert", "revise"):
            docs[s, lang, v] += 1
            tokens[s, lang, v] += n
        if op in ("delete", "revise"):
            docs[s0, l0, v0] -= 1
            tokens[s0, l0, v0] -= n0
    return sorted(((*k, docs[k], tokens[k]) for k in docs if docs[k] or tokens[k]), key=str)


def test_batches_add_up_once_each(spark, own):
    a, b, c = (changes(k) for k in (1, 2, 3))
    df = lambda x: spark.createDataFrame(x, CHANGES)
    assert rows(own.totals()) == []
    assert own.apply("a", df(a)) and own.apply("b", df(b))
    assert rows(own.totals()) == brute(a + b)
    assert not own.apply("a", df(a)) and not own.apply("a", df(c))
    own.compact()
    assert rows(own.totals()) == brute(a + b)
    assert not own.apply("b", df(b)) and own.apply("c", df(c))
    assert rows(own.totals()) == brute(a + b + c)
    own.compact()
    own.compact()
    assert rows(rollup.Rollup(spark, own.path).totals()) == brute(a + b + c)
    assert not own.apply("c", df(c))


def test_a_batch_that_broke_off_is_not_read(spark, own):
    a = changes(1)
    rollup.deltas(spark.createDataFrame(changes(9), CHANGES)).write.parquet(f"{own.path}/deltas/z/half")
    own.apply("a", spark.createDataFrame(a, CHANGES))
    assert rows(own.totals()) == brute(a)
    with pytest.raises(Exception, match="unknown op"):
        own.apply("bad", spark.createDataFrame([("upsert", *[None] * 8)], CHANGES))
    assert rows(own.totals()) == brute(a)


def test_order_doesn_t_matter(spark):
    x, y = (rollup.Rollup(spark, Workspace(spark, f"order-{k}").path) for k in "xy")
    for k in (1, 2, 3):
        x.apply(str(k), spark.createDataFrame(changes(k), CHANGES))
        y.apply(str(4 - k), spark.createDataFrame(changes(4 - k), CHANGES))
    assert rows(x.totals()) == rows(y.totals())


def test_empty_batch_and_extra_columns(spark, own):
    assert own.apply("none", spark.createDataFrame([], CHANGES)) and not own.apply("none", spark.createDataFrame([], CHANGES))
    a = changes(4)
    own.apply("a", spark.createDataFrame(a, CHANGES).selectExpr("*", "1 AS docs", "2 AS tokens", "3 AS d"))
    assert rows(own.totals()) == brute(a)


def test_hard_cases(spark, own, tmp_path):
    import pyarrow.parquet as pq

    docs = table(spark, [*hard(), (10, long_text(), "en", "a")])
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 0), (5, 0, None), (6, None, 1), (6, 0, 0), (None, 0, 1), (77, 0, 0)], LABELS)
    got = rollup.maintain(clashing(docs), labels, own)
    pq.write_table(docs.toArrow(), tmp_path / "documents.parquet")
    pq.write_table(labels.toArrow(), tmp_path / "labels.parquet")
    assert differ(got, connect(str(tmp_path)), rollup.SQL) == ""


def test_empty_tables(spark, own):
    assert rows(rollup.maintain(table(spark, []), spark.createDataFrame([], LABELS), own)) == []


def test_null_counts_are_none(spark, own):
    own.apply("a", spark.createDataFrame([("insert", "a", "en", "x", None, None, None, None, None), ("insert", "b", "en", "x", 5, None, None, None, None), ("delete", None, None, None, None, "b", "en", "x", None)], CHANGES))
    assert rows(own.totals()) == [("a", "en", "x", 1, 0), ("b", "en", "x", 0, 5)]


def test_a_commit_is_created_once(spark, own):
    assert own._put("commits/a.json", {"attempt": "1"}) and not own._put("commits/a.json", {"attempt": "2"})
    assert own._get("commits/a.json") == {"attempt": "1"} and own._list("tmp") == []


def test_versions_of_public_vocabularies(spark, own):
    import base64
    import glob

    import tiktoken

    from textmill import Tokenizer

    found = sorted(glob.glob("/opt/tokenizers/*50k.tiktoken"))
    if len(found) < 2:
        pytest.skip("no vocabularies")
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    texts = [(k, f"The year {k} began, and nobody's house (number {k * 37}) was   warm.\n" * (k + 1), "en", "a") for k in range(6)] + [(7, None, "en", "a"), (8, "", "en", "a")]
    labels = spark.createDataFrame([(3, 0, 0), (4, 1, 1)], LABELS)
    got = rollup.maintain(table(spark, texts), labels, own, {f[-25:]: rollup.tokenizer_count(Tokenizer(f, pattern)) for f in found[:2]})
    want = Counter()
    for f, own_docs in zip(found, ([0, 1, 2, 5], [3])):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f, "rb"))}
        e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        want[f[-25:]] = sum(len(e.encode_ordinary(texts[k][1])) for k in own_docs)
    assert {r["tokenizer"]: r["tokens"] for r in got.collect()} == want and {r["tokenizer"]: r["docs"] for r in got.collect()} == {found[0][-25:]: 6, found[1][-25:]: 1}

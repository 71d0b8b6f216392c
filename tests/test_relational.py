"""What the relational forms shuffle, and rows out of order, repeated and without numbers."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_tokenizer import raw
from textmill.operators import decode, encode

TOKENS = {1: b"a", 2: b"bc", 3: b"\xff", 4: b"x" * 300, 5: b"", 6: b"yy"}


def expected(rows):
    out = {}
    for i, at, k in rows:
        out.setdefault(i, []).append((at, k))
    key = lambda p: (p[0] is not None, p[0] or 0, TOKENS[p[1]])
    return {i: b"".join(TOKENS[k] for _, k in sorted(((at, k) for at, k in ps if k in TOKENS), key=key)) for i, ps in out.items()}


@pytest.fixture
def decoder(spark):
    return spark.createDataFrame([(k, bytearray(b)) for k, b in TOKENS.items()], "token_id int, token binary"), spark.createDataFrame([("yy", 6)], "token string, token_id int")


@pytest.mark.parametrize("shape", ["in order", "shuffled", "repeated"])
def test_decoded_rows(spark, decoder, shape):
    rnd = random.Random(3)
    rows = [(i, at, rnd.choice([1, 1, 1, 2, 3, 4, 5, 6, 99])) for i in (1, 2, None, 7, 8) for at in range(rnd.choice([3, 200, 400]))]
    rows += [(9, None, 2), (9, None, 1), (9, 0, 2), (10, None, None), (11, 5, 1), (11, 3, 2)]
    if shape == "shuffled":
        rnd.shuffle(rows)
    if shape == "repeated":
        rows += [(i, at, rnd.choice([1, 2, 6, None])) for i in (2, None) for at in range(150)] + [(i, at, 1) for i in (1, 2) for at in range(90, 300)]
    df = spark.createDataFrame(rows, "doc_id bigint, tok_ix int, token_id int").coalesce(2)
    got = decode.decode_relational(df, *decoder).collect()
    assert len(got) == len({r[0] for r in rows})
    assert {r["doc_id"]: bytes(r["bytes"]) for r in got} == expected(rows)
    nested = decode.decode_relational(df.withColumn("doc_id", F.struct("doc_id")), *decoder).collect()
    assert {r["doc_id"]["doc_id"]: bytes(r["bytes"]) for r in nested} == expected(rows)


def test_tokens_are_not_shuffled_one_by_one(spark, decoder):
    df = spark.range(40).select("id", F.explode(F.sequence(F.lit(0), F.lit(999))).alias("tok_ix")).select(F.col("id").alias("doc_id"), "tok_ix", (F.col("tok_ix") % 3 + 1).alias("token_id"))
    out = decode.decode_relational(df, *decoder)
    assert {bytes(r["bytes"]) for r in out.collect()} == {(b"abc\xff" * 334)[: 4 * 333 + 1]}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(doc_id") >= 1 and "Exchange hashpartitioning(token_id" not in plan
    packed = decode.packed(iter([df.limit(10_000).toArrow().to_batches()[0].select([0]).append_column("tok_ix", df.limit(10_000).toArrow()["tok_ix"].chunk(0).cast("int64")).append_column("b", df.select(F.lit(b"ab")).limit(10_000).toArrow().column(0).chunk(0))]))
    assert sum(len(b) for b in packed) == 80


def test_blocks(monkeypatch):
    monkeypatch.setattr(encode, "BLOCK", 4)
    texts = [None, ["a", " b", "a"], [], ["c", "a"], ["d"] * 6, None, ["a"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10, 17)), pa.array([{"doc_id": k % 3} for k in range(7)]), pa.array(texts, pa.list_(pa.string()))], names=["row", "id", "chunks"])
    back, shuffled = [], 0
    for b in encode.blocks(iter([batch])):
        rows = b.to_pylist()
        shuffled += len(rows)
        assert len({r["block"] for r in rows}) == 1 and [r["code"] for r in rows] == list(range(-1, len(rows) - 1))
        assert rows[0]["key"] == f"b{rows[0]['block']}" and not any(r["docs"] for r in rows[1:])
        back += [(d["id"]["doc_id"], None if d["codes"] is None else [rows[c + 1]["key"][1:] for c in d["codes"]]) for d in rows[0]["docs"]]
    assert back == [(k % 3, t) for k, t in enumerate(texts)] and shuffled == 3 + 3 + 2 + 2


def test_only_distinct_chunks_of_blocks_are_joined(spark):
    t = raw()
    docs = spark.range(300, numPartitions=3).select((F.col("id") % 7).alias("doc_id"), F.expr("repeat('the moment and unseen ', 40) || id").alias("text"))
    out = t.encode_df(docs, strategy="relational")
    assert sorted(out.collect()) == sorted(t.encode_df(docs).collect())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow blocks" in plan and "posexplode" not in plan

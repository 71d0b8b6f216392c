"""Memory of functions of columns: what is made of a batch is made a slice at a time, in one worker."""

import os
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tests.compare import DATA
from tests.test_tokenizer import mapped, pieces, raw
from textmill.functions import bulk, codec
from textmill.operators import encode
from textmill.plans import queries


def peak(run):
    """Most bytes of numpy while run's results are made and dropped."""
    tracemalloc.start()
    try:
        for _ in run():
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def batch(rows=4000):
    return pa.array([["the", " moment", " ", "and", " 12345", "\n  "] * 100] * rows, pa.list_(pa.string()))


@pytest.mark.parametrize("make", [raw, pieces, mapped])
def test_memory_does_not_follow_the_batch(make):
    c, words = make()._codec, batch()
    assert peak(lambda: encode.sliced(iter([words]), c.encode_arrow)) < 70e6
    assert peak(lambda: encode.sliced(iter([words]), lambda x: c.decode_arrow(c.encode_arrow(x)))) < 70e6
    whole = [c.encode_arrow(words)]
    assert whole[0].equals(pa.concat_arrays(encode.sliced(iter([words]), c.encode_arrow)))
    if make is not pieces:
        assert peak(lambda: [c.decode_arrow(whole[0])]) < 70e6


@pytest.mark.parametrize("make", [raw, pieces, mapped])
def test_parts_agree(make, monkeypatch):
    c = make()._codec
    words = pa.array([None, [], ["the", " ", "<|sep|>", "  "], ["a" * 200, "\n ", "  ", "é"], [" "], ["  ", "the", "x"] * 9, [], None], pa.list_(pa.string()))
    special = pa.array([None if w is None else [x == "<|sep|>" for x in w] for w in words.to_pylist()], pa.list_(pa.bool_()))

    def every():
        ids = c.encode_arrow(words)
        return [x.to_pylist() for x in (ids, c.encode_arrow(words, special), c.encode_arrow(words.slice(2, 4)), c.decode_arrow(ids), c.decode_arrow(ids.slice(2)))]

    want = every()
    for n in (1, 3, 10):
        monkeypatch.setattr(codec, "PART", n)
        monkeypatch.setattr(bulk, "PART", n)
        monkeypatch.setattr(codec, "SLICE", n)
        assert every() == want
        assert pa.concat_arrays(encode.sliced(iter([(words, special)]), c.encode_arrow)).to_pylist() == want[1]


def test_long_runs_are_gathered_in_parts(monkeypatch):
    monkeypatch.setattr(bulk, "PART", 7)
    values, start, size = np.arange(100), np.array([0, 50, 3]), np.array([30, 0, 2])
    got, n = bulk.gather(values, start, size, np.array([2, 0, 1, 2, 2, 2, 2, 0]))
    assert got.tolist() == [3, 4, *range(30), *[3, 4] * 4, *range(30)] and n.tolist() == [2, 30, 0, 2, 2, 2, 2, 30]


def test_counts_of_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "the  moment")], "i int, text string")
    for t in (raw(), pieces()):
        assert [r[1] for r in df.select("i", t.count_col("text", True).alias("n")).orderBy("i").collect()] == [None, 0, len(t.encode("the  moment"))]


#: SQL_SCALAR_ARROW_ITER_UDF
SLICED = "251"
QUERIES = ["roundtrip_bytelevel", "decode_strict", "decode_sentencepiece", "roundtrip", "encode_sentencepiece", "decode_lossy", "infill_tokens", "decode_bytes", "special_span_extract", "token_frequency_topk", "encode_raw", "encode_bytelevel"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", QUERIES)
def test_one_worker_a_task_and_results_in_slices(spark, name):
    plan = queries.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"ArrowEvalPython .*, (\d+)$", plan, re.M) == [SLICED]


#: Functions of these return numbers of ids, not ids; several share a worker.
COUNTS = ["compression", "token_count_by_lang", "token_count_cube"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", COUNTS)
def test_counts_are_made_in_the_worker(spark, name):
    plan = queries.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    made = re.findall(r"ArrowEvalPython .*, \[(pythonUDF.*)\], \d+$", plan, re.M)
    assert len(made) == 1 and all(x.endswith("L") for x in made[0].split(", "))

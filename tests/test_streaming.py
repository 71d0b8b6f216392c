import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textmill import ByteLevelStreamingDecoder, StreamingDecoder, Tokenizer, byte_level_encode
from textmill.streaming import decoder as streams

BYTES = {bytes([b]): b for b in range(256)} | {b"Hello": 256, "世界".encode(): 257}
PLAIN = Tokenizer.from_maps(BYTES, {"<|think|>": 1000})
LEVEL = Tokenizer.from_maps({byte_level_encode(t).encode(): k for t, k in {b"Hello": 100, b" world": 101, "你好".encode(): 102, b"\xe4": 200, b"\xbd": 201, b"\xa0": 202}.items()}, {"<|think|>": 1000}, mode="byte_level")


def test_a_character_in_three():
    d = PLAIN.streaming_decoder()
    assert isinstance(d, StreamingDecoder) and not d.has_pending
    assert d.add_token(0xE4) is None and d.pending_bytes == 1 and d.add_token(0xB8) is None and d.has_pending
    assert repr(d) == "StreamingDecoder(pending_bytes=2)"
    assert d.add_token(0x96) == "世" and d.pending_bytes == 0
    assert d.add_token(256) == "Hello" and d.add_token(99999) is None and d.add_token(1000) == "<|think|>"
    assert d.add_tokens([0xE4, 99999, 0xB8]) is None and d.flush() == "�" and d.flush() == ""
    d.add_token(0xE4)
    d.reset()
    assert not d.has_pending and d.add_token(65) == "A"


@pytest.mark.parametrize("bad", [[0xFF], [0xC0, 0x80], [0xED, 0xA0, 0x80]])
def test_an_invalid_byte_holds_all_up(bad):
    d = PLAIN.streaming_decoder()
    assert d.add_tokens(bad) is None
    assert d.add_token(65) is None and d.add_token(66) is None
    assert d.flush() == bytes(bad).decode("utf-8", "replace") + "AB"
    assert d.add_token(65) == "A"


def test_byte_level():
    d = LEVEL.byte_level_streaming_decoder()
    assert isinstance(d, ByteLevelStreamingDecoder) and repr(d) == "ByteLevelStreamingDecoder(pending_bytes=0)"
    assert [d.add_token(k) for k in (100, 1000, 101, 200, 201, 202, 102)] == ["Hello", "<|think|>", " world", None, None, "你", "你好"]
    assert LEVEL.decode([100, 1000, 101]) == "Hello<|think|> world"
    assert LEVEL.streaming_decoder().add_token(101) == "Ġworld"  # the plain one gives tokens as they are written


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 257), st.sampled_from([1000, 5000])), max_size=30))
def test_all_that_is_given_out(ids):
    d = PLAIN.streaming_decoder()
    out = "".join(x for x in map(d.add_token, ids) if x)
    assert out + d.flush() == PLAIN.decode_lossy(ids)
    e = PLAIN.streaming_decoder()
    assert ((e.add_tokens(ids) or "") == out) and e.pending_bytes == streams_pending(ids)


def streams_pending(ids):
    data = PLAIN.decode_bytes(ids)
    return len(data) - streams.valid_length(data)


def steps(rows):
    out, d = {}, {}
    for s, q, op, k in sorted(rows, key=lambda r: r[:2]):
        own = d.setdefault(s, PLAIN.streaming_decoder())
        x = streams.step(own, op, k)
        out[s, q] = (x, own.pending_bytes, own.has_pending)
    return out


SCHEMA = "stream_id bigint, seq bigint, op string, token_id int"


def some_rows(seed, n=300):
    r = random.Random(seed)
    data = "Größe 世界 🦀 z".encode()
    return [(s, q, *(("flush", None) if r.random() < 0.03 else ("reset", None) if r.random() < 0.03 else ("token", r.choice([data[q % len(data)], 1000, 7777, None] if r.random() < 0.1 else [data[q % len(data)]])))) for s in range(5) for q in range(n // 5)]


def test_tables(spark):
    rows = some_rows(1)
    random.Random(2).shuffle(rows)
    got = streams.decode_table(spark.createDataFrame(rows, SCHEMA).repartition(4), PLAIN._codec).collect()
    assert {(r["stream_id"], r["seq"]): (r["emitted"], r["pending_bytes"], r["has_pending"]) for r in got} == steps(rows)
    assert streams.decode_table(spark.createDataFrame([], SCHEMA), PLAIN._codec).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([1, 1, 2]), st.sampled_from(["token"] * 8 + ["flush", "reset"]), st.sampled_from([0xE4, 0xB8, 0x96, 65, 0xFF, 257, 1000, 7777, -1, 0xC3, 0xA9])), max_size=24), st.integers(1, 6))
def test_batches_against_the_object(rows, size):
    rows = [(s, q, op, k) for q, (s, op, k) in enumerate(sorted(rows, key=lambda r: r[0]))]
    got, before, pending = {}, None, b""
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        s, _, op, k = (np.array(x, object) for x in zip(*part))
        emitted, waits, pending = streams.decode_batch(PLAIN._codec, s.astype(np.int64), op, k.astype(np.int64), before, pending)
        before = part[-1][0]
        got |= {r[:2]: (e, w, w > 0) for r, e, w in zip(part, emitted.to_pylist(), waits.tolist())}
    assert got == steps(rows)


def test_structured_streaming(spark, tmp_path):
    rows = some_rows(3)
    folder, sink = str(tmp_path / "in"), str(tmp_path / "out")
    cut = [[r for r in rows if lo <= r[1] < lo + 20] for lo in (0, 20, 40)]
    for k, part in enumerate(cut):
        late = [(r[0], 0, "token", 65) for r in part[:1]] if k else []  # dropped
        spark.createDataFrame(part + late, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(SCHEMA).parquet(folder)
        q = streams.decode_stream(source, PLAIN._codec).writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    got = spark.read.parquet(sink).collect()
    assert {(r["stream_id"], r["seq"]): (r["emitted"], r["pending_bytes"], r["has_pending"]) for r in got} == steps(rows) and len(got) == len(rows)


def test_encoding_a_stream(spark, tmp_path):
    texts = [(k, f"text number {k} the end") for k in range(20)]
    spark.createDataFrame(texts, "id int, text string").write.parquet(str(tmp_path / "in"))
    t = Tokenizer.from_maps(BYTES)
    source = spark.readStream.schema("id int, text string").parquet(str(tmp_path / "in"))
    q = source.select("id", t.encode_col("text").alias("ids")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {r["id"]: r["ids"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {k: t.encode(x) for k, x in texts}

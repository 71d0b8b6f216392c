"""Decoding token streams whose tokens may break inside a character.

A decoder keeps the bytes that don't make whole characters yet and gives out the longest valid start
of what it holds. An invalid byte therefore holds up all that follows until ``flush`` or ``reset``.
The same class serves single streams on the driver, tables of tokens, and Structured Streaming.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions.bulk import gather
from textmill.functions.codec import BYTE_LEVEL, RAW, Codec


def valid_length(data: bytes) -> int:
    """Length of the longest start that is UTF-8."""
    try:
        data.decode("utf-8")
    except UnicodeDecodeError as e:
        return e.start
    return len(data)


class StreamingDecoder:
    _mode = RAW

    def __init__(self, codec: Codec, pending: bytes = b""):
        # in the plain form, tokens stand for their bytes as they are written in the vocabulary
        self._codec = codec if codec.mode == self._mode else Codec(codec.ranks, codec.decoder, codec.specials, self._mode)
        self._pending = pending

    def _give(self) -> str | None:
        n = valid_length(self._pending)
        out, self._pending = self._pending[:n], self._pending[n:]
        return out.decode("utf-8") if out else None

    def add_token(self, k: int) -> str | None:
        return self.add_tokens([k])

    def add_tokens(self, ids: Iterable[int]) -> str | None:
        """All tokens at once; unknown ids change nothing."""
        found = [b for k in ids if (b := self._codec.token_bytes(k)) is not None]
        if not found:
            return None
        self._pending += b"".join(found)
        return self._give()

    def flush(self) -> str:
        """The rest, with U+FFFD for what is invalid."""
        out, self._pending = self._pending.decode("utf-8", "replace"), b""
        return out

    def reset(self) -> None:
        self._pending = b""

    @property
    def has_pending(self) -> bool:
        return bool(self._pending)

    @property
    def pending_bytes(self) -> int:
        return len(self._pending)

    def __repr__(self) -> str:
        return f"{type(self).__name__}(pending_bytes={self.pending_bytes})"


class ByteLevelStreamingDecoder(StreamingDecoder):
    _mode = BYTE_LEVEL


def step(decoder: StreamingDecoder, op: str, k: int | None) -> str | None:
    if op == "flush":
        return decoder.flush()
    if op == "reset":
        decoder.reset()
        return None
    return None if k is None else decoder.add_token(int(k))


OUT = "stream_id bigint, seq bigint, emitted string, pending_bytes int, has_pending boolean"


def _kind(byte_level: bool) -> type[StreamingDecoder]:
    return ByteLevelStreamingDecoder if byte_level else StreamingDecoder


def decode_batch(codec: Codec, stream: np.ndarray, op: np.ndarray, ids: np.ndarray, before: int | None, pending: bytes) -> tuple[pa.Array, np.ndarray, bytes]:
    """What the rows of some streams give out, how many bytes each then waits with, and the bytes that wait at the end. ``pending`` waits for stream ``before``.

    A stream's bytes up to a control row are one run, of which the longest valid start is found once; a token then gives
    the characters that end in its bytes, by their places alone.
    """
    rows = len(stream)
    control = (op == "flush") | (op == "reset")
    new = np.concatenate([[stream[0] != before], (stream[1:] != stream[:-1]) | control[:-1]])
    held = b"" if new[0] else pending
    new[0] = True
    raw, start, size = codec.table()
    data, n = gather(raw, start, size, np.where(control, len(size) - 1, codec.rows(ids)))
    data = np.concatenate([np.frombuffer(held, np.uint8), data])
    end = np.cumsum(n) + len(held)
    first = np.flatnonzero(new)
    last = np.append(first[1:], rows) - 1
    begin = (end - n)[first]
    begin[0] = 0
    whole = data.tobytes()
    valid = np.array([a + valid_length(whole[a:b]) for a, b in zip(begin.tolist(), end[last].tolist())], np.int64)
    run = np.cumsum(new) - 1
    # the last place up to each at which a character begins
    lead = np.maximum.accumulate(np.where(np.append((data & 0xC0) != 0x80, True), np.arange(len(data) + 1), 0))
    upto = np.minimum(end, valid[run])
    done = np.where(upto == valid[run], upto, lead[upto])
    since = np.concatenate([[0], done[:-1]])
    since[first] = begin
    flushed = np.flatnonzero(op == "flush")
    texts = [whole[a:b].decode("utf-8", "replace").encode() for a, b in zip(since[flushed].tolist(), end[flushed].tolist())]
    place, length = since.copy(), np.where(control, 0, done - since)
    length[flushed] = [len(t) for t in texts]
    place[flushed] = len(data) + np.cumsum(length[flushed]) - length[flushed]
    values, _ = gather(np.concatenate([data, np.frombuffer(b"".join(texts), np.uint8)]), place, length, np.arange(rows))
    shown = (length > 0) | (op == "flush")
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    emitted = pa.Array.from_buffers(pa.string(), rows, [pa.py_buffer(np.packbits(shown, bitorder="little").tobytes()), pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])
    waits = np.where(control, 0, end - done)
    return emitted, waits.astype(np.int32), b"" if control[-1] else whole[done[-1] : end[-1]]


def decode_table(tokens: DataFrame, codec: Codec, byte_level: bool = False) -> DataFrame:
    """For each row (stream_id, seq, op, token_id) what it gives out: streams are brought together and read in order, each once and none as a whole."""
    shared = tokens.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before, pending = _kind(byte_level)(shared.value)._codec, None, b""
        for b in batches:
            if not b.num_rows:
                continue
            stream = pc.fill_null(b.column(0), -(1 << 63)).to_numpy(zero_copy_only=False)
            op = pc.fill_null(b.column(2), "token").to_numpy(zero_copy_only=False).astype(object)
            ids = pc.fill_null(b.column(3), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            emitted, waits, pending = decode_batch(own, stream, op, ids, before, pending)
            before = stream[-1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), emitted, pa.array(waits), pa.array(waits > 0)], ["stream_id", "seq", "emitted", "pending_bytes", "has_pending"])

    ordered = tokens.select(F.col("stream_id").cast("bigint"), F.col("seq").cast("bigint"), "op", F.col("token_id").cast("int")).repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    return ordered.mapInArrow(run, OUT)


def decode_stream(tokens: DataFrame, codec: Codec, byte_level: bool = False, timeout_ms: int | None = None) -> DataFrame:
    """The same for a streaming DataFrame. State of a stream: its pending bytes and the last ``seq``; tokens at or before that are late and dropped. With ``timeout_ms``, a stream that is silent so long is flushed."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    shared = tokens.sparkSession.sparkContext.broadcast(codec)

    def run(key, frames, state):
        import pandas as pd

        pending, last = state.get if state.exists else (b"", -1)
        decoder, out = _kind(byte_level)(shared.value, bytes(pending)), []
        if state.hasTimedOut:
            rest = decoder.flush()
            state.update((b"", last))  # the place stays, so that late tokens are still known to be late
            if rest:
                yield pd.DataFrame([(key[0], last, rest, 0, False)], columns=["stream_id", "seq", "emitted", "pending_bytes", "has_pending"])
            return
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for seq, op, k in zip(rows["seq"], rows["op"], rows["token_id"]):
            if seq > last:
                out.append((key[0], seq, step(decoder, op, None if k != k or k is None else k), decoder.pending_bytes, decoder.has_pending))
                last = int(seq)
        state.update((decoder._pending, last))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["stream_id", "seq", "emitted", "pending_bytes", "has_pending"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return tokens.select("stream_id", "seq", "op", "token_id").groupBy("stream_id").applyInPandasWithState(run, OUT, "pending binary, last bigint", "append", timeout)


def texts_of(decoded: DataFrame) -> DataFrame:
    """(stream_id, text): what each stream gave out in all."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "emitted")))
    return decoded.where("emitted is not null").groupBy("stream_id").agg(F.array_join(F.transform(parts, lambda x: x["emitted"]), "").alias("text"))

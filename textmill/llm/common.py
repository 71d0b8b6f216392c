"""What the operators share: durable intermediate tables, size-checked broadcasts, tokens as arrays.

Tokens here are maximal runs of ASCII letters and digits and of characters beyond ASCII, in lower
case; a character of the Chinese, Japanese and Korean blocks is a token of its own. A token is known
by a 64-bit hash, so a batch of texts becomes a few numpy arrays and no token is ever a Python object.
"""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.memory import _TRIM, release  # noqa: F401

#: Rows up to which a side of a join is broadcast, after it was counted; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Bytes of text that are turned into arrays at a time; a longer text is a piece of its own.
PIECE_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="textmill-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


class Workspace:
    """Tables of one run of an operator in the shared folder: written once, so that a lost executor costs no lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def stash(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.mode("overwrite").options(**options).parquet(f"{self.path}/{name}")
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """The pyarrow file system of a path or URI, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose worker gives its memory back when the task is over."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``limit`` rows, else as it is, to be joined by a shuffle. df should be cheap to count."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    name = f"textmill_{name}"
    while name in {c.lower() for c in df.columns}:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def scramble(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_CLASS = np.zeros(256, np.uint8)
for _r in (range(48, 58), range(97, 123), range(65, 91), range(128, 256)):
    _CLASS[_r.start : _r.stop] = 1
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)


@dataclass
class Tokens:
    """Tokens of some rows: token i is ``raw[start[i]:end[i]]``; those of row r are ``first[r]:first[r + 1]``."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> str:
        return self.raw[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n tokens within a row, by position; and where each row's begin."""
        size = np.maximum(np.diff(self.first) - n + 1, 0)
        first = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], size)
        out = np.zeros(len(at), np.uint64)
        for k, by in enumerate(scramble(11, n)):
            out += self.hash[at + k] * by
        return mix(out), first


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A column of text with 64-bit offsets and '' for null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in a piece, and where each row begins."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def tokens_of(column: pa.Array) -> Tokens:
    """All tokens of a column that ``strings`` made; rows of nulls and empty texts have none."""
    raw, offsets = raw_bytes(pc.utf8_lower(column))
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Tokens(raw, none, none, np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64))
    word = _CLASS[raw].view(bool)
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    begins[inner] = word[inner]  # a row ends a token
    wide = (raw >= 0xE3) & (raw <= 0xED)  # U+3000 to U+DFFF: each character by itself
    if wide.any():
        at = np.flatnonzero(wide)
        begins[at] = True
        after = at + 3
        after = after[after < n]
        begins[after] |= word[after]
    start = np.flatnonzero(begins)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Tokens(raw, none, none, np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64))
    which = np.cumsum(begins, dtype=np.int32) - 1
    at = np.flatnonzero(word)
    within = at - start[which[at]]
    # the length of each token: the word bytes that belong to it
    length = np.bincount(which[at], minlength=len(start))
    values = (raw[at].astype(np.uint64) + np.uint64(1)) * _POWERS[within & 4095]
    if int(length.max()) > 4096:
        values *= (within >> 12).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    position = np.concatenate([[0], np.cumsum(length)[:-1]])
    return Tokens(raw, start, start + length, mix(np.add.reduceat(values, position)), np.searchsorted(start, offsets))


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each, or of one row."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, len(column))
        lo = hi


def tokens_in(column: pa.Array | pa.ChunkedArray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, Tokens]]:
    column = strings(column)
    for lo, hi in pieces(column, most):
        yield lo, hi, tokens_of(column.slice(lo, hi - lo))


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes of words that are tokens already."""
    return np.array([(t := tokens_of(pa.array([w], pa.large_string()))).hash[0] if w else 0 for w in words], np.uint64)


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list for each row from flat values."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))

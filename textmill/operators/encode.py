"""Encoding columns of text.

``inline`` splits in the JVM and merges in one Arrow function: no shuffle, and the form for large tables. ``relational``
is the same with joins: distinct chunks are looked up in the vocabulary, only the misses are merged, and ids are joined back
to the distinct chunks of each block of rows.
Functions give their results a slice of a batch at a time, so a worker holds one batch of chunks and little else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from textmill.functions.bytelevel import encode_col as mapped
from textmill.functions.codec import BYTE_LEVEL, SENTENCEPIECE, Codec, slices
from textmill.functions.memory import release
from textmill.operators.split import chunks, marked_chunks

IDS = ArrayType(IntegerType(), True)
#: Chunks of the rows that the relational form joins as one.
BLOCK = 1 << 18


def sliced(batches: Iterator, run: Callable[..., pa.Array]) -> Iterator[pa.Array]:
    """What run makes of each slice of batches of one column of lists or several."""
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        for lo, n in slices(columns[0]):
            yield run(*(c.slice(lo, n) for c in columns))
        release()


def over_chunks(kind, run: Callable[..., pa.Array], special: bool = False):
    """run as a function of columns of chunks, and of which are special tokens."""

    @F.arrow_udf(kind)
    def plain(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return sliced(batches, run)

    @F.arrow_udf(kind)
    def marked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return sliced(batches, run)

    return marked if special else plain


def encoder_udf(shared):
    """chunks -> ids, for a codec that was broadcast."""
    return over_chunks(IDS, lambda *x: shared.value.encode_arrow(*x))


def _inputs(codec: Codec, pattern: str, text: Column, with_special: bool) -> list[Column]:
    if with_special and codec.specials:
        marked = marked_chunks(text, pattern, list(codec.specials))
        return [F.transform(marked, lambda x: x["text"]), F.transform(marked, lambda x: x["special"])]
    return [chunks(text, pattern)]


def encode_col(spark, codec: Codec, pattern: str, text: Column, with_special: bool = False) -> Column:
    shared, inputs = spark.sparkContext.broadcast(codec), _inputs(codec, pattern, text, with_special)
    out = over_chunks(IDS, lambda *x: shared.value.encode_arrow(*x), len(inputs) > 1)(*inputs)
    out.__dict__["textmill_encoded"] = shared, inputs  # so that decoding them needs no second worker
    return out


def recoded(ids: Column, codec) -> Column | None:
    """The bytes that a broadcast codec makes of ids that encode_col just made, in one function; None for any other column."""
    shared, inputs = vars(ids).get("textmill_encoded", (None, []))
    return over_chunks(BinaryType(), lambda *x: codec.value.decode_arrow(shared.value.encode_arrow(*x)), len(inputs) > 1)(*inputs) if inputs else None


def count_col(spark, codec: Codec, pattern: str, text: Column, with_special: bool = False) -> Column:
    """Numbers of ids. Not an iterator's function, since several of those can't share a worker."""
    shared, inputs = spark.sparkContext.broadcast(codec), _inputs(codec, pattern, text, with_special)

    def count(*columns: pa.Array) -> pa.Array:
        sizes = [np.diff(np.asarray(shared.value.encode_arrow(*(c.slice(lo, n) for c in columns)).offsets)) for lo, n in slices(columns[0])]
        release()
        return pa.array(np.concatenate([np.zeros(0, np.int64), *sizes]), mask=~np.asarray(columns[0].is_valid()))

    @F.arrow_udf(LongType())
    def plain(words: pa.Array) -> pa.Array:
        return count(words)

    @F.arrow_udf(LongType())
    def marked(words: pa.Array, special: pa.Array) -> pa.Array:
        return count(words, special)

    return (marked if len(inputs) > 1 else plain)(*inputs)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (number, id, chunks): for each block of rows, known by its first one's number, a row with all ids and for each the codes of its chunks; and for each code a row with its chunk. The keys of those rows begin with w, others' with b and are in no table of chunks."""
    for batch in batches:
        row, ids, words = batch.columns
        for lo, n in slices(words, BLOCK):
            part = words.slice(lo, n)
            valid, flat = np.asarray(part.is_valid()), part.flatten().dictionary_encode()
            sizes = np.zeros(n, np.int64)
            sizes[valid] = np.diff(np.asarray(part.offsets))[valid]
            codes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(~valid, False)), flat.indices)
            docs, k, block = pa.StructArray.from_arrays([ids.slice(lo, n), codes], ["id", "codes"]), len(flat.dictionary), row[lo].as_py()
            none = np.arange(k + 2) > 0
            none[-1] = False  # where the last row ends
            docs = pa.ListArray.from_arrays(pa.array(np.append(0, np.full(k + 1, n)).astype(np.int32), mask=none), docs)
            keys = pa.concat_arrays([pa.array([f"b{block}"]), pc.binary_join_element_wise("w", flat.dictionary.cast(pa.string()), "")])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k + 1, block)), pa.array(np.arange(-1, k), pa.int32()), keys, docs], names=["block", "code", "key", "docs"])


def encode_relational(df: DataFrame, vocab: DataFrame, codec: Codec, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) by lookup of the distinct chunks, merging of what isn't found, and a join back. Rows are known by a number of their own, so ids may repeat or be null. For modes whose chunks are independent.
    Only the distinct chunks of a block of rows are shuffled as rows, and the numbers of all its chunks in one with them."""
    if codec.mode == SENTENCEPIECE:
        raise ValueError("chunks of this mode depend on each other; use the inline form")
    shared = df.sparkSession.sparkContext.broadcast(codec)
    words = chunks(F.col(text_col), pattern)
    numbered = df.select(F.monotonically_increasing_id().alias("textmill_row"), F.struct(id_col).alias("textmill_id"), words.alias("chunks"))
    docs = StructType([StructField("id", numbered.schema["textmill_id"].dataType), StructField("codes", IDS)])
    rows = numbered.mapInArrow(blocks, StructType([StructField("block", LongType()), StructField("code", IntegerType()), StructField("key", StringType()), StructField("docs", ArrayType(docs))]))
    distinct = df.select(F.explode(words).alias("chunk")).where("chunk is not null").distinct()
    raw = F.encode("chunk", "UTF-8")
    key = F.encode(mapped(raw), "UTF-8") if codec.mode == BYTE_LEVEL else raw
    looked = distinct.withColumn("token", key).join(F.broadcast(vocab), "token", "left")
    merged = encoder_udf(shared)(F.array("chunk"))
    ids = looked.where("rank is not null").select("chunk", F.array("rank").alias("own")).union(looked.where("rank is null").select("chunk", merged.alias("own")))
    own = F.collect_list(F.when(F.col("code") >= 0, F.struct("code", "own")))
    found = rows.join(ids.select(F.concat(F.lit("w"), "chunk").alias("key"), "own"), "key", "left").groupBy("block").agg(F.first("docs", ignorenulls=True).alias("docs"), F.transform(F.array_sort(own), lambda x: x["own"]).alias("own"))
    every = F.transform("docs", lambda d: F.struct(d["id"][id_col].alias(id_col), F.flatten(F.transform(d["codes"], lambda c: F.col("own")[c])).alias("ids")))
    return found.select(F.explode(every).alias("d")).select("d.*")

"""Decoding columns of ids: bytes by one gather in an Arrow function, UTF-8 by the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from textmill.functions.codec import SENTENCEPIECE, Codec, buffers
from textmill.operators.encode import recoded, sliced

#: Tokens that are packed into a row at most, and bytes of one of them.
PACKED, LONGEST = 128, 255


def bytes_col(spark, codec: Codec, ids: Column) -> Column:
    shared = spark.sparkContext.broadcast(codec)

    @F.arrow_udf(BinaryType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return sliced(batches, lambda x: shared.value.decode_arrow(x))

    made = recoded(ids, shared)
    return decode(ids.cast("array<int>")) if made is None else made


def text_col(spark, codec: Codec, ids: Column, on_error: str = "raise") -> Column:
    """on_error: ``raise`` fails the job, ``null`` gives null, ``replace`` puts U+FFFD for each maximal invalid part."""
    check = {"raise": F.validate_utf8, "null": F.try_validate_utf8, "replace": F.make_valid_utf8}[on_error]
    out = check(bytes_col(spark, codec, ids).cast("string"))
    return F.replace(out, F.lit("▁"), F.lit(" ")) if codec.mode == SENTENCEPIECE else out


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, tok_ix, bytes) as fewer: of rows of one id that follow each other and are numbered on, one with all bytes and each one's size. A token of more than LONGEST bytes is a row by itself, without a size."""
    for batch in batches:
        ids, at, token = batch.columns
        if not len(ids):
            continue
        raw, offsets = buffers(pc.fill_null(token, b""))
        size, number, known = np.diff(offsets), pc.fill_null(at, -1).to_numpy(zero_copy_only=False), np.asarray(at.is_valid())
        if pa.types.is_nested(ids.type):
            rows = ids.to_pylist()
            same = np.array([x == y for x, y in zip(rows, rows[1:])], bool)
        else:
            none = np.asarray(ids.is_null())
            same = pc.fill_null(pc.equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False) | (none[1:] & none[:-1])
        whole = size > LONGEST
        new = np.ones(len(ids), bool)
        new[1:] = ~same | ~known[1:] | ~known[:-1] | (number[1:] != number[:-1] + 1) | whole[1:] | whole[:-1]
        place = np.arange(len(ids))
        new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % PACKED == 0
        first = np.flatnonzero(new)
        take, stop = pa.array(first), np.append(first, len(ids))
        valid = pa.py_buffer(np.packbits(~whole[first], bitorder="little").tobytes())
        joined = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets[stop].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
        sizes = pa.Array.from_buffers(pa.binary(), len(first), [valid, pa.py_buffer(stop.astype(np.int32)), pa.py_buffer(size.astype(np.uint8))])
        yield pa.RecordBatch.from_arrays([ids.take(take), at.take(take), joined, sizes], names=[batch.schema.names[0], "tok_ix", "b", "sizes"])


def _tokens(x: Column) -> Column:
    """The rows that a packed one stands for: array of (tok_ix, b)."""
    sizes = F.transform(F.regexp_extract_all(F.hex(x["sizes"]), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))
    before = lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda n, k: n + k)
    each = F.transform(sizes, lambda n, i: F.struct((x["tok_ix"] + i).alias("tok_ix"), F.substring(x["b"], before(i) + 1, n).alias("b")))
    return F.when(x["sizes"].isNull(), F.array(F.struct(x["tok_ix"].alias("tok_ix"), x["b"].alias("b")))).otherwise(each)


def decode_relational(tokens: DataFrame, decoder: DataFrame, special: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, bytes) from rows (id, tok_ix, token_id) by joins; the decoder comes before the specials, and unknown ids stand for nothing. A row without a token (as ``posexplode_outer`` makes of an empty list) gives empty bytes.
    A vocabulary is small, and goes to every task, so no token is shuffled by its id; runs of an id's tokens are packed before they are shuffled by that. Where packed rows overlap, as of repeated ids, their tokens are sorted one by one."""
    own = decoder.select("token_id", F.col("token").alias("raw"))
    other = special.select("token_id", F.encode("token", "UTF-8").alias("other"))
    rows = tokens.join(F.broadcast(own), "token_id", "left").join(F.broadcast(other), "token_id", "left").select(id_col, F.col("tok_ix").cast("bigint").alias("tok_ix"), F.coalesce("raw", "other").alias("b"))
    runs = rows.mapInArrow(packed, StructType([rows.schema[0], StructField("tok_ix", LongType()), StructField("b", BinaryType()), StructField("sizes", BinaryType())]))
    found = runs.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("tok_ix", "b", "sizes"))).alias("p"))
    after = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda x, y: F.coalesce(x["tok_ix"] + F.coalesce(F.octet_length(x["sizes"]), F.lit(1)) <= y["tok_ix"], F.lit(False)))
    single = F.array_sort(F.flatten(F.transform("p", _tokens)))
    hexed = lambda x: F.hex(x["b"])
    h = F.array_join(F.when(F.forall(after, lambda x: x), F.transform("p", hexed)).otherwise(F.transform(single, hexed)), "")
    return found.select(id_col, F.unhex(h).alias("bytes"))

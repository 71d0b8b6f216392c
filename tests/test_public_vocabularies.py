"""Real vocabularies, against the library that they are made for."""

import base64
import os

import pytest
import tiktoken
from pyspark.sql import functions as F

from textmill import Tokenizer
from textmill.errors import TokenizerError
from textmill.operators.decode import decode_relational
from textmill.operators.split import alternation

FOLDER = "/opt/tokenizers"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
TEXTS = ["The quick year 2024 wasn't  warm.\n\n", "", "naïve café — 北京 😀", " x" * 300, "a" * 700, "\t\tdef f(x):\n        return x**2"]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_ids_are_those_of_another_library(spark, name):
    path = f"{FOLDER}/{name}.tiktoken"
    if not os.path.exists(path):
        pytest.skip(f"no {path}")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = Tokenizer(path, PATTERN)
    assert own.vocab_size == len(ranks)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    folder = "/root/testdata/sf0.001/documents.parquet"
    if os.path.exists(folder):
        docs = docs.union(spark.read.parquet(folder).select(F.col("doc_id") + 100, "text"))
    got = docs.select("text", own.encode_col("text").alias("ids"), own.decode_col(own.encode_col("text")).alias("back")).collect()
    for r in got:
        assert r["ids"] == other.encode_ordinary(r["text"]) and r["back"] == r["text"]
    assert own.encode(TEXTS[2]) == other.encode_ordinary(TEXTS[2])


def test_relational_form_with_null_and_repeated_ids(spark):
    own = Tokenizer.from_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % b for b in range(256)) + base64.b64encode(b"ab") + b" 300\n", r"\S+|\s+")
    texts = [(None, "ab c"), (2, "ab"), (2, "c ab"), (3, None), (3, ""), (None, None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    relational = own.encode_df(docs, strategy="relational")
    inline = docs.select("doc_id", own.encode_col("text").alias("ids"))
    assert sorted(map(str, relational.select("doc_id", "ids").collect())) == sorted(map(str, inline.collect()))


def test_rows_without_tokens_are_decoded(spark):
    lists = spark.createDataFrame([(1, [5]), (2, []), (3, None)], "doc_id bigint, ids array<int>")
    tokens = lists.select("doc_id", F.posexplode_outer("ids").alias("tok_ix", "token_id"))
    decoder = spark.createDataFrame([(5, b"x")], "token_id int, token binary")
    got = decode_relational(tokens, decoder, spark.createDataFrame([], "token string, token_id int"))
    assert {r["doc_id"]: bytes(r["bytes"]) for r in got.collect()} == {1: b"x", 2: b"", 3: b""}


def ends_first(specials, text):
    """Matches by the rule: the one that ends first, of those the longest, then on from there."""
    out, at = [], 0
    while at < len(text):
        found = min(((e, -len(s), s) for s in specials for e in [text.find(s, at) + len(s)] if text.find(s, at) >= 0), default=None)
        if found is None:
            break
        out.append(found[2])
        at = found[0]
    return out


@pytest.mark.parametrize("specials", [["<abcd>", "bc", "ab", "abcd"], ["aba", "bab", "b"], ["aab", "ab", "ba"], ["abc", "cd", "bcd"]])
def test_of_overlapping_specials_the_one_that_ends_first_wins(specials):
    import itertools
    import re

    for n in range(1, 8):
        for text in map("".join, itertools.product("abcd" if n < 6 else "ab", repeat=n)):
            assert re.findall(alternation(specials), text) == ends_first(specials, text)
    assert re.findall(alternation(specials), "<abcd>") == ends_first(specials, "<abcd>")


def test_ids_that_columns_can_t_hold_are_an_error():
    with pytest.raises(TokenizerError, match="2\\^31"):
        Tokenizer.from_bytes(b"", r"\S+", {"<a>": 3_000_000_000})

"""A query for each operator of the tokenization engine, over whole tables, with the tiny vocabulary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill import patterns
from textmill.functions import bytelevel
from textmill.operators import chat, decode, encode, split
from textmill.plans import registry, tiny
from textmill.sources import vocab
from textmill.sources.tables import spread
from textmill.streaming import decoder as streams
from textmill.tokenizer import Tokenizer

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source"))


def raw() -> Tokenizer:
    return Tokenizer.from_bytes(tiny.FILE.encode(), patterns.CL100K_BASE_PATTERN, tiny.CHAT)


def words() -> Tokenizer:
    """Raw bytes, cut at white space."""
    return Tokenizer.from_bytes(tiny.FILE.encode(), patterns.SENTENCEPIECE_PATTERN, tiny.SPECIALS)


def mapped() -> Tokenizer:
    return Tokenizer.from_bytes_byte_level(tiny.MAPPED_FILE.encode(), patterns.CL100K_BASE_PATTERN, tiny.SPECIALS)


def pieces() -> Tokenizer:
    return Tokenizer.from_bytes_sentencepiece(tiny.FILE.encode(), patterns.SENTENCEPIECE_PATTERN, tiny.SPECIALS)


def listed(ids: Column) -> Column:
    """Ids as text, which compares alike everywhere."""
    return F.array_join(ids.cast("array<string>"), ",")


def encoded(df: DataFrame, id_col: str, ids: Column) -> DataFrame:
    return df.select(id_col, ids.alias("x")).select(id_col, F.size("x").cast("bigint").alias("n_tokens"), listed(F.col("x")).alias("ids"))


def lines(spark: SparkSession) -> DataFrame:
    return vocab.numbered(spark.createDataFrame([(tiny.FILE,)], "value string"))


def hexed(df: DataFrame, number: str = "rank") -> DataFrame:
    return df.select(F.hex("token").alias("token"), number)


@query
def vocab_load(spark: SparkSession, d: str) -> DataFrame:
    return hexed(vocab.resolve(vocab.parsed(lines(spark))))


@query
def vocab_load_first(spark: SparkSession, d: str) -> DataFrame:
    return hexed(vocab.resolve(vocab.parsed(lines(spark)), "first"))


@query
def vocab_decoder(spark: SparkSession, d: str) -> DataFrame:
    return hexed(vocab.invert(vocab.resolve(vocab.parsed(lines(spark)))), "token_id")


@query
def vocab_full_decoder(spark: SparkSession, d: str) -> DataFrame:
    return hexed(vocab.full_decoder(vocab.parsed(lines(spark))), "token_id")


@query
def vocab_size(spark: SparkSession, d: str) -> DataFrame:
    own = vocab.invert(vocab.resolve(vocab.parsed(lines(spark)))).select("token_id").union(raw().special_df(spark).select("token_id"))
    return own.agg((F.max("token_id") + 1).alias("vocab_size"))


@query
def vocab_write_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts of the benchmark and all tokens as lines, parsed again."""
    own = vocab.resolve(vocab.parsed(lines(spark))).select("token", "rank")
    texts = table(spark, d, "benchmark").where("text is not null").select(F.encode("text", "UTF-8").alias("token"), (F.col("item_id") + 1000).cast("int").alias("rank"))
    rows = own.union(texts).select(F.col("rank").alias("line_no"), vocab.line_column(F.col("token"), F.col("rank")).alias("line"))
    return hexed(vocab.resolve(vocab.parsed(rows)))


@query
def byte_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Names of pieces as their bytes: all byte names, and the words of nations."""
    names = spark.range(256).select(F.format_string("<0x%02X>", F.col("id")).alias("name")).union(table(spark, d, "nation").select("n_name"))
    return names.select("name", F.hex(vocab.fallback_bytes(F.col("name"))).alias("token"))


@query
def byte_alphabet(spark: SparkSession, d: str) -> DataFrame:
    return bytelevel.alphabet(spark)


@query
def byte_level_encode(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", bytelevel.encode_col(F.encode("text", "UTF-8")).alias("mapped"))


@query
def byte_level_decode(spark: SparkSession, d: str) -> DataFrame:
    """Mapped texts back; and plain urls and texts, where those with a character outside the alphabet give null."""
    docs, pages = documents(spark, d), table(spark, d, "pages")
    back = docs.select(F.lit("back").alias("kind"), F.col("doc_id").alias("id"), F.hex(bytelevel.decode_col(bytelevel.encode_col(F.encode("text", "UTF-8")))).alias("bytes"))
    plain = docs.select(F.lit("text"), "doc_id", F.hex(bytelevel.decode_col(F.col("text"))))
    urls = pages.select(F.lit("url"), "page_id", F.hex(bytelevel.decode_bytes_col(F.encode("url", "UTF-8"))))
    return back.union(plain).union(urls)


def _split(pattern: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = documents(spark, d).select("doc_id", split.chunks(F.col("text"), pattern).alias("c"))
        return docs.select("doc_id", F.size("c").cast("bigint").alias("n_chunks"), F.array_join("c", "\x1e").alias("chunks"))

    return run


_ALL |= {f"split_{k}": _split(p) for k, p in (("cl100k", patterns.CL100K_BASE_PATTERN), ("o200k", patterns.O200K_BASE_PATTERN), ("llama3", patterns.LLAMA3_PATTERN), ("mistral_v3", patterns.MISTRAL_V3_PATTERN), ("sentencepiece", patterns.SENTENCEPIECE_PATTERN), ("custom", r"[a-z]{2,}|[0-9]+"))}


def thoughts(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations with special tokens around and between."""
    text = F.concat(F.lit("<|think|>"), F.col("role"), F.lit("<|/think|> <|sep|><|sep|>"), F.col("text"), F.lit("  <|pad|>"))
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), text.alias("text"))


@query
def special_split(spark: SparkSession, d: str) -> DataFrame:
    rows = thoughts(spark, d).select("turn_id", F.posexplode(split.segments(F.col("text"), list(tiny.SPECIALS))).alias("segment_ix", "s"))
    return rows.select("turn_id", "segment_ix", "s.special", F.col("s.text").alias("segment"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return split.chunk_rows(documents(spark, d), "doc_id", "text", patterns.CL100K_BASE_PATTERN)


@query
def bpe_fast_path(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that the vocabulary has as they are, by id; and under a null id, all others."""
    counted = _chunks(spark, d).groupBy("chunk").agg(F.count("*").alias("n")).withColumn("token", F.encode("chunk", "UTF-8"))
    found = counted.join(F.broadcast(raw().vocab_df(spark)), "token", "left")
    return found.groupBy(F.col("rank").alias("token_id")).agg(F.count("*").alias("distinct_chunks"), F.sum("n").alias("n_chunks"))


@query
def bpe_merge(spark: SparkSession, d: str) -> DataFrame:
    """Ids of all distinct chunks that need merging."""
    t = raw()
    misses = _chunks(spark, d).select("chunk").distinct().withColumn("token", F.encode("chunk", "UTF-8")).join(F.broadcast(t.vocab_df(spark)), "token", "left_anti")
    merge = encode.encoder_udf(spark.sparkContext.broadcast(t._codec))
    return misses.select("chunk", listed(merge(F.array("chunk"))).alias("ids"))


@query
def encode_raw(spark: SparkSession, d: str) -> DataFrame:
    return encoded(documents(spark, d), "doc_id", raw().encode_col("text"))


@query
def encode_bytelevel(spark: SparkSession, d: str) -> DataFrame:
    return encoded(documents(spark, d), "doc_id", mapped().encode_col("text"))


@query
def encode_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    return encoded(documents(spark, d), "doc_id", pieces().encode_col("text"))


@query
def encode_with_special(spark: SparkSession, d: str) -> DataFrame:
    return encoded(thoughts(spark, d), "turn_id", raw().encode_col("text", with_special=True))


@query
def encode_special_as_text(spark: SparkSession, d: str) -> DataFrame:
    return encoded(thoughts(spark, d), "turn_id", raw().encode_col("text"))


@query
def encode_sentencepiece_special(spark: SparkSession, d: str) -> DataFrame:
    return encoded(thoughts(spark, d), "turn_id", pieces().encode_col("text", with_special=True))


@query
def encode_parallel_equiv(spark: SparkSession, d: str) -> DataFrame:
    """The relational form: distinct chunks, a join with the vocabulary, and a join back."""
    return encoded(raw().encode_df(documents(spark, d), strategy="relational"), "doc_id", F.col("ids"))


@query
def encode_function(spark: SparkSession, d: str) -> DataFrame:
    """Encoding and decoding by registered SQL functions."""
    raw().register(spark, "tiny")
    table(spark, d, "benchmark").createOrReplaceTempView("textmill_benchmark")
    return spark.sql("SELECT item_id, size(tiny_encode(text)) AS n_tokens, tiny_decode(tiny_encode(text)) AS text FROM textmill_benchmark").withColumn("n_tokens", F.col("n_tokens").cast("bigint"))


@query
def tokenize_table_function(spark: SparkSession, d: str) -> DataFrame:
    """A row for each token, by the registered table function."""
    raw().register(spark, "tiny")
    table(spark, d, "benchmark").createOrReplaceTempView("textmill_benchmark")
    return spark.sql("SELECT item_id, pos, token_id, hex(token) AS token FROM textmill_benchmark, LATERAL tiny_tokenize(text)")


def codes(spark: SparkSession, d: str) -> DataFrame:
    """Texts with their characters' code points for ids: single bytes, pieces, specials and unknown ones, seldom UTF-8."""
    return documents(spark, d).select("doc_id", F.expr("transform(filter(split(text, ''), c -> c <> ''), c -> ascii(c))").alias("ids"))


@query
def decode_bytes(spark: SparkSession, d: str) -> DataFrame:
    return codes(spark, d).select("doc_id", F.hex(raw().decode_bytes_col("ids")).alias("bytes"))


@query
def decode_relational(spark: SparkSession, d: str) -> DataFrame:
    t = raw()
    out = decode.decode_relational(chat.token_rows(codes(spark, d), "doc_id"), t.decoder_df(spark), t.special_df(spark))
    return out.select("doc_id", F.hex("bytes").alias("bytes"))


@query
def decode_strict(spark: SparkSession, d: str) -> DataFrame:
    """Null where the bytes aren't UTF-8."""
    return codes(spark, d).select("doc_id", raw().decode_col("ids", on_error="null").alias("text"))


@query
def decode_lossy(spark: SparkSession, d: str) -> DataFrame:
    return codes(spark, d).select("doc_id", raw().decode_lossy_col("ids").alias("text"))


@query
def decode_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    t = pieces()
    return documents(spark, d).select("doc_id", t.decode_col(t.encode_col("text")).alias("text"))


@query
def roundtrip(spark: SparkSession, d: str) -> DataFrame:
    t = raw()
    return documents(spark, d).select("doc_id", t.decode_col(t.encode_col("text")).alias("text"))


@query
def roundtrip_bytelevel(spark: SparkSession, d: str) -> DataFrame:
    t = mapped()
    return documents(spark, d).select("doc_id", t.decode_col(t.encode_col("text")).alias("text"))


def token_stream(spark: SparkSession, d: str) -> DataFrame:
    """A token for each byte of the turns, a stream to a turn."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), F.hex(F.encode("text", "UTF-8")).alias("h"))
    rows = turns.select("stream_id", F.posexplode(F.regexp_extract_all("h", F.lit(".."), F.lit(0))).alias("seq", "b"))
    return rows.select("stream_id", F.col("seq").cast("bigint").alias("seq"), F.lit("token").alias("op"), F.conv("b", 16, 10).cast("int").alias("token_id"))


@query
def stream_decode(spark: SparkSession, d: str) -> DataFrame:
    return streams.decode_table(token_stream(spark, d), raw()._codec)


@query
def stream_decode_bytelevel(spark: SparkSession, d: str) -> DataFrame:
    return streams.decode_table(token_stream(spark, d), mapped()._codec, byte_level=True)


@query
def stream_pending(spark: SparkSession, d: str) -> DataFrame:
    """What each stream holds at most, and how often it holds anything."""
    out = streams.decode_table(token_stream(spark, d), raw()._codec)
    return out.groupBy("stream_id").agg(F.max("pending_bytes").alias("most"), F.count_if("has_pending").alias("times"))


@query
def stream_flush(spark: SparkSession, d: str) -> DataFrame:
    """Streams that end within a character: reset after the first half of it, then the same half flushed."""
    ends = token_stream(spark, d).select("stream_id").distinct()
    tail = F.array(*[F.struct(F.lit(1_000_000 + k).cast("bigint").alias("seq"), F.lit(op).alias("op"), F.lit(b).cast("int").alias("token_id")) for k, (op, b) in enumerate([("token", 0xE4), ("reset", None), ("token", 0xE4), ("token", 0xB8), ("flush", None)])])
    rows = token_stream(spark, d).union(ends.select("stream_id", F.explode(tail).alias("t")).select("stream_id", "t.*"))
    return streams.decode_table(rows, raw()._codec).where("seq >= 1000000")


@query
def stream_text(spark: SparkSession, d: str) -> DataFrame:
    return streams.texts_of(streams.decode_table(token_stream(spark, d), raw()._codec))


@query
def token_count_by_lang(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("lang", words().count_col("text").alias("n"))
    return docs.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))


@query
def token_count_cube(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by language, source, both and neither."""
    docs = documents(spark, d).select("lang", "source", raw().count_col("text").alias("n"))
    return docs.cube("lang", "source").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))


@query
def compression(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of two ways to cut, against bytes, by language."""
    docs = documents(spark, d).select("lang", F.octet_length("text").cast("bigint").alias("b"), raw().count_col("text").alias("x"), pieces().count_col("text").alias("y"))
    return docs.groupBy("lang").agg(F.sum("b").alias("bytes"), F.sum("x").alias("raw_tokens"), F.sum("y").alias("piece_tokens"))


@query
def token_frequency_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 20 most frequent tokens."""
    rows = documents(spark, d).select(F.explode(raw().encode_col("text")).alias("token_id")).groupBy("token_id").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "token_id").limit(20)


@query
def chat_formats(spark: SparkSession, d: str) -> DataFrame:
    """All conversations in all formats."""
    conversations, out = table(spark, d, "conversations"), None
    for form in chat.FORMATS:
        one = chat.render(conversations, form).select("conv_id", F.lit(form).alias("form"), "text")
        out = one if out is None else out.union(one)
    return out


@query
def chatml_tokens(spark: SparkSession, d: str) -> DataFrame:
    return encoded(chat.render(table(spark, d, "conversations"), "chatml"), "conv_id", raw().encode_col("text", with_special=True))


@query
def infill_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut in three at thirds of their characters."""
    third = F.expr("char_length(text) div 3").cast("int")
    cut = chat.infill(F.substring("text", F.lit(1), third), F.substring("text", third + 1, third), F.expr("substring(text, 2 * int(char_length(text) div 3) + 1)"))
    return encoded(documents(spark, d).withColumn("cut", cut), "doc_id", raw().encode_col("cut", with_special=True))


@query
def special_span_extract(spark: SparkSession, d: str) -> DataFrame:
    tokens = chat.token_rows(thoughts(spark, d), "turn_id", raw().encode_col("text", with_special=True))
    return chat.spans(tokens, tiny.SPECIALS["<|think|>"], tiny.SPECIALS["<|/think|>"], "turn_id")


@query
def agent_tokens(spark: SparkSession, d: str) -> DataFrame:
    return registry.agent_tokens(spark)


@query
def native_specials(spark: SparkSession, d: str) -> DataFrame:
    rows = [(n.name, t, k) for n in registry.NAMED.values() for t, k in n.native.items()]
    return spark.createDataFrame(rows, "vocab string, token string, token_id int")


@query
def vocab_registry(spark: SparkSession, d: str) -> DataFrame:
    return registry.registry(spark)


def queries() -> dict[str, Query]:
    return dict(_ALL)




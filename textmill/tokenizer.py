"""The tokenizer: one object for single texts on the driver and for columns of tables."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textmill import patterns
from textmill.errors import TokenizerError, VocabError
from textmill.functions.codec import BYTE_LEVEL, RAW, SENTENCEPIECE, Codec
from textmill.operators import decode as _decode
from textmill.operators import encode as _encode
from textmill.operators.split import alternation, chunks
from textmill.plans import registry
from textmill.sources import vocab as _vocab
from textmill.streaming.decoder import ByteLevelStreamingDecoder, StreamingDecoder


def _checked(specials: dict[str, int] | None) -> dict[str, int]:
    out = dict(specials or {})
    for token, k in out.items():
        if not isinstance(token, str) or not token or isinstance(k, bool) or not isinstance(k, int) or not 0 <= k <= 0x7FFFFFFF:
            raise TokenizerError(f"a special token is a string and an id from 0 to 2^31 - 1, as columns of ids are of 32 bits with a sign, not {token!r}: {k!r}")
    return out


class Tokenizer:
    """``mode``: raw bytes, byte_level or sentencepiece. ``duplicates``: which line of equal tokens gives the id. ``full_decoder``: ids of the other lines decode too."""

    def __init__(self, vocab_path: str, pattern: str, special_tokens: dict[str, int] | None = None, *, mode: str = RAW, duplicates: str = "last", full_decoder: bool = False, cache_size: int = 4096):
        self._set(_vocab.parse(_vocab.read_bytes(vocab_path)), pattern, special_tokens, mode, duplicates, full_decoder, cache_size)

    def _set(self, rows, pattern, specials, mode, duplicates, full_decoder, cache_size) -> None:
        encoder = _vocab.encoder_of(rows, duplicates)
        self._put(encoder, {k: t for t, k in rows} if full_decoder else _vocab.build_decoder(encoder), specials, pattern, mode, cache_size)

    def _put(self, encoder, decoder, specials, pattern, mode, cache_size) -> None:
        import regex

        if mode not in (RAW, BYTE_LEVEL, SENTENCEPIECE):
            raise TokenizerError(f"unknown mode {mode!r}")
        self.pattern, self.mode, self.cache_size = pattern, mode, cache_size
        self._regex = patterns.compiled(pattern)
        self._codec = Codec(encoder, decoder, _checked(specials), mode)
        self._special_regex = regex.compile(alternation(list(self._codec.specials))) if self._codec.specials else None
        self._backend: dict[str, bool] = {}

    @classmethod
    def _made(cls, *args) -> Tokenizer:
        out = cls.__new__(cls)
        out._set(*args)
        return out

    @classmethod
    def from_file(cls, path: str, pattern: str, special_tokens: dict[str, int] | None = None, **options) -> Tokenizer:
        return cls(path, pattern, special_tokens, **options)

    @classmethod
    def from_bytes(cls, data: bytes, pattern: str, special_tokens: dict[str, int] | None = None, *, mode: str = RAW, duplicates: str = "last", full_decoder: bool = False, cache_size: int = 4096) -> Tokenizer:
        return cls._made(_vocab.parse(data), pattern, special_tokens, mode, duplicates, full_decoder, cache_size)

    @classmethod
    def from_bytes_byte_level(cls, data: bytes, pattern: str, special_tokens: dict[str, int] | None = None) -> Tokenizer:
        return cls.from_bytes(data, pattern, special_tokens, mode=BYTE_LEVEL)

    @classmethod
    def from_bytes_sentencepiece(cls, data: bytes, pattern: str, special_tokens: dict[str, int] | None = None) -> Tokenizer:
        return cls.from_bytes(data, pattern, special_tokens, mode=SENTENCEPIECE)

    @classmethod
    def from_bytes_sentencepiece_with_decoder(cls, data: bytes, pattern: str, special_tokens: dict[str, int] | None = None) -> Tokenizer:
        """All ids decode, the first line of equal tokens gives the id, and special tokens are in the decoder too."""
        out = cls.from_bytes(data, pattern, special_tokens, mode=SENTENCEPIECE, duplicates="first", full_decoder=True)
        out._codec.decoder |= {k: t.encode() for t, k in out._codec.specials.items()}
        return out

    @classmethod
    def from_maps(cls, encoder: dict[bytes, int], special_tokens: dict[str, int] | None = None, pattern: str = patterns.CL100K_BASE_PATTERN, *, decoder: dict[int, bytes] | None = None, mode: str = RAW, cache_size: int = 4096) -> Tokenizer:
        out = cls.__new__(cls)
        out._put(dict(encoder), _vocab.build_decoder(encoder) if decoder is None else dict(decoder), special_tokens, pattern, mode, cache_size)
        return out

    @classmethod
    def from_table(cls, vocab: DataFrame, pattern: str, special_tokens: dict[str, int] | None = None, **options) -> Tokenizer:
        """From rows (token, rank); a vocabulary is small, and goes to every task."""
        return cls.from_maps({bytes(r["token"]): r["rank"] for r in vocab.toLocalIterator()}, special_tokens, pattern, **options)

    @classmethod
    def from_pretrained(cls, name: str, folder: str | None = None, duplicates: str = "last") -> Tokenizer:
        """A named vocabulary from its file in ``folder`` or TEXTMILL_VOCAB_DIR."""
        n = registry.from_name(name)
        out = cls(registry.vocab_path(name, folder), n.pattern, n.special_tokens(), mode=n.mode, duplicates=duplicates, full_decoder=duplicates == "first")
        if duplicates == "first" and n.mode == SENTENCEPIECE:
            out._codec.decoder |= {k: t.encode() for t, k in out._codec.specials.items()}
        return out

    from_vocab = from_pretrained

    # one text

    def encode(self, text: str) -> list[int]:
        out = self._codec.encode_chunks([m.group() for m in self._regex.finditer(text)])
        self._trim()
        return out

    encode_rayon = encode

    def encode_with_special(self, text: str) -> list[int]:
        if self._special_regex is None:
            return self.encode(text)
        out, last = [], 0
        for m in self._special_regex.finditer(text):
            out += self.encode(text[last : m.start()]) + [self._codec.specials[m.group()]]
            last = m.end()
        return out + self.encode(text[last:])

    def encode_batch(self, texts: Iterable[str]) -> list[list[int]]:
        return [self.encode(t) for t in texts]

    def encode_batch_with_special(self, texts: Iterable[str]) -> list[list[int]]:
        return [self.encode_with_special(t) for t in texts]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return self._codec.decode_bytes(ids)

    def _text(self, s: str) -> str:
        return s.replace("▁", " ") if self.mode == SENTENCEPIECE else s

    def decode(self, ids: Iterable[int]) -> str:
        try:
            return self._text(self.decode_bytes(ids).decode("utf-8"))
        except UnicodeDecodeError as e:
            raise TokenizerError(f"Decoding error: invalid UTF-8 at byte {e.start}") from e

    def decode_lossy(self, ids: Iterable[int]) -> str:
        return self._text(self.decode_bytes(ids).decode("utf-8", "replace"))

    def decode_batch(self, lists: Iterable[Iterable[int]]) -> list[str]:
        return [self.decode(x) for x in lists]

    def decode_batch_lossy(self, lists: Iterable[Iterable[int]]) -> list[str]:
        return [self.decode_lossy(x) for x in lists]

    # columns

    def encode_col(self, text: Column | str, with_special: bool = False) -> Column:
        spark = SparkSession.active()
        return _encode.encode_col(spark, self._codec, self.pattern, F.col(text) if isinstance(text, str) else text, with_special)

    def count_col(self, text: Column | str, with_special: bool = False) -> Column:
        return _encode.count_col(SparkSession.active(), self._codec, self.pattern, F.col(text) if isinstance(text, str) else text, with_special)

    def decode_bytes_col(self, ids: Column | str) -> Column:
        return _decode.bytes_col(SparkSession.active(), self._codec, F.col(ids) if isinstance(ids, str) else ids)

    def decode_col(self, ids: Column | str, on_error: str = "raise") -> Column:
        return _decode.text_col(SparkSession.active(), self._codec, F.col(ids) if isinstance(ids, str) else ids, on_error)

    def decode_lossy_col(self, ids: Column | str) -> Column:
        return self.decode_col(ids, "replace")

    def chunk_col(self, text: Column | str) -> Column:
        return chunks(F.col(text) if isinstance(text, str) else text, self.pattern)

    def encode_df(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", strategy: str = "inline") -> DataFrame:
        """(id, ids); ``relational`` looks distinct chunks up by joins."""
        if strategy == "inline":
            return df.select(id_col, self.encode_col(text_col).alias("ids"))
        return _encode.encode_relational(df, self.vocab_df(df.sparkSession), self._codec, self.pattern, id_col, text_col)

    def register(self, spark: SparkSession, prefix: str = "bpe") -> None:
        """SQL functions <prefix>_encode(text), <prefix>_decode(ids) and the table function <prefix>_tokenize(text)."""
        from pyspark.sql.functions import udtf

        shared, regex_text = spark.sparkContext.broadcast(self._codec), self.pattern
        kept: dict = {}

        @F.arrow_udf(_encode.IDS)
        def encode(text: pa.Array) -> pa.Array:
            r = kept.setdefault("r", patterns.compiled(regex_text))
            words = [None if t is None else [m.group() for m in r.finditer(t)] for t in text.to_pylist()]
            return shared.value.encode_arrow(pa.array(words, pa.list_(pa.string())))

        @F.arrow_udf(StringType())
        def decode(ids: pa.Array) -> pa.Array:
            codec = shared.value
            space = codec.mode == SENTENCEPIECE
            texts = [None if b is None else b.decode("utf-8") for b in codec.decode_arrow(ids).to_pylist()]
            return pa.array([t.replace("▁", " ") if space and t is not None else t for t in texts], pa.string())

        codec = self._codec

        @udtf(returnType="pos int, token_id int, token binary")
        class Tokenize:
            def eval(self, text: str):
                if text is not None:
                    r = patterns.compiled(regex_text)
                    for i, k in enumerate(codec.encode_chunks([m.group() for m in r.finditer(text)])):
                        yield i, k, codec.token_bytes(k)

        spark.udf.register(f"{prefix}_encode", encode)
        spark.udf.register(f"{prefix}_decode", decode)
        spark.udtf.register(f"{prefix}_tokenize", Tokenize)

    # what it knows

    @property
    def vocab_size(self) -> int:
        """The largest id of tokens and specials, and one."""
        return max([0, *self._codec.decoder, *self._codec.specials.values()]) + 1

    def encoder(self) -> dict[bytes, int]:
        return dict(self._codec.ranks)

    def decoder(self) -> dict[int, bytes]:
        return dict(self._codec.decoder)

    def special_tokens(self) -> dict[str, int]:
        return dict(self._codec.specials)

    def special_tokens_decoder(self) -> dict[int, str]:
        return {k: t for t, k in self._codec.specials.items()}

    def vocab_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(bytearray(t), k) for t, k in self._codec.ranks.items()], "token binary, rank int")

    def decoder_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, bytearray(t)) for k, t in self._codec.decoder.items()], "token_id int, token binary")

    def special_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self._codec.specials.items()), "token string, token_id int")

    # caches and engines

    def _keys(self) -> list:
        return [x for x in self._codec.kept if isinstance(x, tuple) and not x[1] and (x[2] or x[0].encode("utf-8", "surrogatepass") not in self._codec.ranks)]

    def _trim(self) -> None:
        if len(self._codec.kept) > 4 * self.cache_size:
            self._codec.kept.clear()

    @property
    def cache_len(self) -> int:
        """Chunks kept that needed merging, up to the cache's size."""
        return min(len(self._keys()), self.cache_size)

    def clear_cache(self) -> None:
        self._codec.kept.clear()

    def _like(self, **backend: bool) -> Tokenizer:
        out = self.from_maps(self._codec.ranks, self._codec.specials, self.pattern, decoder=self._codec.decoder, mode=self.mode, cache_size=self.cache_size)
        out._backend = self._backend | backend
        return out

    def pcre2(self, use: bool = True) -> Tokenizer:
        """Another engine with the same matches: here there is one, so the results are the same by construction."""
        return self._like(pcre2=bool(use))

    def jit(self, use: bool = True) -> Tokenizer:
        return self._like(jit=bool(use))

    def streaming_decoder(self) -> StreamingDecoder:
        return StreamingDecoder(self._codec)

    def byte_level_streaming_decoder(self) -> ByteLevelStreamingDecoder:
        return ByteLevelStreamingDecoder(self._codec)

    def __repr__(self) -> str:
        return f"Tokenizer(vocab_size={self.vocab_size})"


__all__ = ["Tokenizer", "TokenizerError", "VocabError"]

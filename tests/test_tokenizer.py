import base64

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import textmill
from textmill import Tokenizer, TokenizerError, VocabError, byte_level_decode, byte_level_decode_bytes, byte_level_encode, byte_pair_encode, patterns
from textmill.functions import bpe, bytelevel
from textmill.plans import registry, tiny
from textmill.sources import vocab

ABC = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4, b"abc": 5}
RANKS = vocab.encoder_of(tiny.LINES)
TEXTS = ["", "1234567890", "Hello, world!", "one\ntwo\n\n  three", "Sphinx of black quartz, judge my vow.", "!@#$%^&*()", "こんにちは 世界 🦀", "   \n\t  ", "a — b “c” d’s", "x   y", "　 　z", "a\u0085b\u0085\u0085c", " \n b", "\r\n\r\n  k", "\x0b\x0bq", "'ſt don'ſ", "İI'LL", "!/\n//", "def f(x):\n    return x * 2\n"]


def raw(**options):
    return Tokenizer.from_bytes(tiny.FILE.encode(), patterns.CL100K_BASE_PATTERN, tiny.SPECIALS, **options)


def pieces():
    return Tokenizer.from_bytes_sentencepiece(tiny.FILE.encode(), patterns.SENTENCEPIECE_PATTERN, tiny.SPECIALS)


def mapped():
    return Tokenizer.from_bytes_byte_level(tiny.MAPPED_FILE.encode(), patterns.CL100K_BASE_PATTERN, tiny.SPECIALS)


@pytest.mark.parametrize("text,ids", [("", []), ("a", [0]), ("ab", [3]), ("abc", [5]), ("ac", [0, 2]), ("abcb", [5, 1]), ("axb", [0, 1])])
def test_merge_micro(text, ids):
    assert byte_pair_encode(text.encode(), ABC) == ids


def naive(piece, ranks):
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts if p in ranks]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"th", b"the ", b"in", b"tion", b"a", b"n", b"d", b"\xe2", b"\x96\x81", b"z", b"aXb", b"oun"]), max_size=40))
def test_scan_and_heap_against_a_loop(parts):
    piece = b"".join(parts)
    want = naive(piece, RANKS) if piece else []
    assert byte_pair_encode(piece, RANKS) == want
    if piece and piece not in RANKS:
        assert [RANKS[p] for p in bpe._scan(piece, RANKS)] == [RANKS[p] for p in bpe._heap(piece, RANKS)] == want


@pytest.mark.parametrize("text,ids,mode", [("the", [264], "raw"), ("the  moment", [264, 32, 32, 109, 111, 280], "raw"), ("and the", [269, 271], "raw"), ("zz", [284, 284], "raw"), ("aXb", [285], "raw"), ("aXbc", [97, 88, 98, 99], "raw"), ("été", [279, 116, 279], "raw"), ("thé\n", [263, 279, 10], "raw"), ("the  moment", [264, 226, 150, 129, 226, 150, 129, 109, 111, 280], "pieces"), ("and the", [269, 283], "pieces"), ("a　 b", [97, 227, 128, 128, 32, 98], "pieces"), (" ", [282], "pieces"), ("a\n b", [97, 10, 226, 150, 129, 98], "pieces")])
def test_expected_ids(text, ids, mode):
    assert (raw() if mode == "raw" else pieces()).encode(text) == ids


def test_first_line_wins_if_asked_to():
    assert raw(duplicates="first").encode("zz") == [122, 122]
    assert raw(duplicates="first", full_decoder=True).decode([122, 284]) == "zz"
    assert raw().decode([122, 284]) == "z"


@pytest.mark.parametrize("pattern", ["CL100K_BASE_PATTERN", "O200K_BASE_PATTERN", "MISTRAL_V3_PATTERN", "SENTENCEPIECE_PATTERN"])
def test_columns_split_as_the_driver_does(spark, pattern):
    p = getattr(textmill, pattern)
    t = Tokenizer.from_bytes(tiny.FILE.encode(), p)
    texts = [*TEXTS, "a b᠎ c​d", "x\xa0\xa0y", "　 ab", "ǅungla Ǆ", "١٢٣٤ ½ Ⅷ", "a̐éö̲"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", t.chunk_col("text").alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == [regex.findall(p, x) for x in texts]


@pytest.mark.parametrize("make", [raw, pieces, mapped])
def test_columns_and_driver_agree(spark, make):
    t = make()
    texts = [None, *TEXTS, "<|think|>a  <|/think|> <|sep|>", "  <|pad|>", "x" * 5000 + " the" * 3000, "\x00\x01"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    got = df.select("i", t.encode_col("text").alias("a"), t.encode_col("text", True).alias("b"), t.count_col("text").alias("n"), t.decode_col(t.encode_col("text")).alias("back")).orderBy("i").collect()
    assert got[0]["a"] is None and got[0]["b"] is None and got[0]["back"] is None
    for r, text in list(zip(got, texts))[1:]:
        assert r["a"] == t.encode(text) and r["b"] == t.encode_with_special(text) and r["n"] == len(r["a"])
        assert r["back"] == t.decode(r["a"]) == text


def test_relational_form_agrees(spark):
    for t in (raw(), mapped()):
        df = spark.createDataFrame(list(enumerate([None, *TEXTS])), "doc_id int, text string")
        assert {r[0]: r[1] for r in t.encode_df(df, strategy="relational").collect()} == {r[0]: r[1] for r in t.encode_df(df).collect()}
    with pytest.raises(ValueError):
        pieces().encode_df(df, strategy="relational")


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_round_trips(text):
    for t in (raw(), mapped()):
        assert t.decode(t.encode(text)) == text
    assert pieces().decode(pieces().encode(text)) == text.replace("▁", " ")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="the and ing\n\té'12 <", max_size=60))
def test_against_an_independent_encoder(text):
    tiktoken = pytest.importorskip("tiktoken")
    # all tokens that merging reaches, one id to each
    ranks = {t: k for t, k in tiny.LINES if k < 282}
    other = tiktoken.Encoding("tiny", pat_str=patterns.CL100K_BASE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert Tokenizer.from_maps(ranks, pattern=patterns.CL100K_BASE_PATTERN).encode(text) == other.encode_ordinary(text)


def test_special_tokens():
    t = raw()
    assert t.encode_with_special("<|think|>the<|/think|>") == [302, 264, 303]
    assert t.encode("<|sep|>") == naive_all(t, "<|sep|>")
    assert t.decode([302, 264, 303, 9999]) == "<|think|>the<|/think|>"
    assert t.encode_with_special("<|SEP|>") == t.encode("<|SEP|>")
    with pytest.raises(TokenizerError):
        Tokenizer.from_maps(ABC, {"x": -1})
    with pytest.raises(TokenizerError):
        Tokenizer.from_maps(ABC, {"x": "1"})


def naive_all(t, text):
    return [k for c in regex.findall(t.pattern, text) for k in naive(c.encode(), RANKS)]


def test_decoding_errors(spark):
    t = raw()
    with pytest.raises(TokenizerError, match="invalid UTF-8"):
        t.decode([0xE4, 0xB8])
    assert t.decode_lossy([0xE4, 0xB8, 65]) == "�A" and t.decode_bytes([0xFF, 7777, 65]) == b"\xffA"
    df = spark.createDataFrame([(1, [0xE4, 0xB8]), (2, [65]), (3, None), (4, []), (5, [None, -5, 66])], "i int, ids array<int>")
    assert [r[1] for r in df.select("i", t.decode_col("ids", "null").alias("x")).orderBy("i").collect()] == [None, "A", None, "", "B"]
    assert [r[1] for r in df.select("i", t.decode_lossy_col("ids").alias("x")).orderBy("i").collect()] == ["�", "A", None, "", "B"]
    with pytest.raises(Exception, match="INVALID_UTF8_STRING"):
        df.select(t.decode_col("ids")).collect()
    with pytest.raises(TokenizerError):
        t.decode_batch([[65], [0xFF]])


def test_ids_far_apart(spark):
    t = Tokenizer.from_maps({b"a": 0, b"b": 2_000_000_000}, {"<|x|>": 7})
    df = spark.createDataFrame([([0, 2_000_000_000, 7, 5, -1],)], "ids array<int>")
    assert df.select(t.decode_col("ids")).first()[0] == t.decode([0, 2_000_000_000, 7, 5, -1]) == "ab<|x|>"
    assert Tokenizer.from_maps({}).decode([1]) == "" and df.select(Tokenizer.from_maps({}).decode_col("ids")).first()[0] == ""


def test_what_it_knows(spark):
    t = raw()
    assert t.vocab_size == 304 and repr(t) == "Tokenizer(vocab_size=304)"
    assert Tokenizer.from_maps({}).vocab_size == 1
    assert t.encoder()[b"the"] == 264 and t.decoder()[264] == b"the" and t.special_tokens_decoder()[300] == "<|sep|>"
    assert t.vocab_df(spark).count() == len(t.encoder()) == 285 and t.special_df(spark).count() == 4


def test_caches_and_engines():
    t = raw()
    t.encode("unknownword the the")
    assert t.cache_len > 0
    t.clear_cache()
    assert t.cache_len == 0
    for other in (t.pcre2(), t.pcre2(False), t.jit(), t.jit(False)):
        assert other is not t and other.encode_batch(TEXTS) == t.encode_batch(TEXTS) == [t.encode_rayon(x) for x in TEXTS]


def test_custom_patterns():
    assert Tokenizer.from_bytes(tiny.FILE.encode(), ".").decode(Tokenizer.from_bytes(tiny.FILE.encode(), ".").encode("a\nb")) == "ab"
    with pytest.raises(TokenizerError):
        Tokenizer.from_bytes(tiny.FILE.encode(), "(")


@pytest.mark.parametrize("data", [b"SGVsbG8=", b"SGVsbG8 0\n", b"!!!! 1\n", b"SGVsbG8= x\n", b"SGVsbG8= -1\n", b"SGVsbG8= 99999999999\n"])
def test_bad_vocabularies(spark, tmp_path, data):
    with pytest.raises(VocabError):
        Tokenizer.from_bytes(data, ".")
    (tmp_path / "bad").write_bytes(data)
    with pytest.raises(Exception, match=r"."):
        vocab.read_vocab(spark, str(tmp_path / "bad")).collect()
    with pytest.raises(OSError):
        Tokenizer("/nowhere/at/all", ".")


def test_vocabulary_files(spark, tmp_path):
    data = b"SGVsbG8= 0\r\n\nV29ybGQ= 1\nSGVsbG8= 7"
    (tmp_path / "v").write_bytes(data)
    read = lambda how: {bytes(r["token"]): r["rank"] for r in vocab.read_vocab(spark, str(tmp_path / "v"), how).collect()}
    assert read("last") == vocab.encoder_of(vocab.parse(data)) == {b"Hello": 7, b"World": 1}
    assert read("first") == vocab.encoder_of(vocab.parse(data), "first") == {b"Hello": 0, b"World": 1}
    table = raw().vocab_df(spark)
    vocab.write_vocab(table, str(tmp_path / "out"))
    again = vocab.read_vocab(spark, str(next((tmp_path / "out").glob("part-*"))))
    assert {(bytes(r["token"]), r["rank"]) for r in again.collect()} == set(raw().encoder().items())
    assert Tokenizer.from_table(again, patterns.CL100K_BASE_PATTERN).encode("the") == [264]


def test_byte_alphabet():
    assert byte_level_encode("你好".encode()) == "ä½łå¥½" and byte_level_encode(b" hello") == "Ġhello"
    every = bytes(range(256))
    assert byte_level_decode(byte_level_encode(every)) == every and len(set(byte_level_encode(every))) == 256
    assert byte_level_decode("世") is None and byte_level_decode_bytes(b"\xff") is None
    assert bytelevel.is_byte_level_char("Ġ") and not bytelevel.is_byte_level_char(" ") and bytelevel.get_byte_level_byte(bytelevel.get_byte_level_char(7)) == 7


def test_byte_alphabet_columns(spark):
    df = spark.createDataFrame([(bytearray(range(256)),), (bytearray(b""),), (None,)], "b binary")
    got = df.select(bytelevel.encode_col(df["b"]).alias("t")).select("t", bytelevel.decode_col(F.col("t")).alias("b")).collect()
    assert got[0]["t"] == byte_level_encode(bytes(range(256))) and bytes(got[0]["b"]) == bytes(range(256))
    assert got[1]["t"] == "" and got[2]["t"] is None


def test_registry():
    assert len(registry.supported_names()) == 12 and set(registry.NAMED) == {"cl100k_base", "o200k_base", "llama3", "deepseek_v3", "mistral_v1", "mistral_v2", "mistral_v3"}
    for n in registry.NAMED.values():
        ids = n.special_tokens()
        assert len(set(ids.values())) == len(ids) and max(ids.values()) + 1 == n.vocab_size
        assert not any(a != b and a in b for a in ids for b in ids)
    assert registry.eos_token_id("llama3.1") == 128001 and registry.eos_token_id_by_name("nobody") == 0 and registry.bos_token_id("cl100k_base") is None and registry.pad_token_id("mistral") == 32039
    assert registry.uses_byte_level("mistral_v3") and not registry.uses_byte_level("mistral_v2")
    assert textmill.CL100K_AGENT_TOKENS.THINK == 100282 and textmill.MISTRAL_V3_AGENT_TOKENS.FUNCTION == 131087 and textmill.MISTRAL_V2_AGENT_TOKENS.THINK == 32773
    assert textmill.DEEPSEEK_V3_AGENT_TOKENS.THINK_NATIVE == 128798 and textmill.LLAMA3_AGENT_TOKENS.IMAGE == 128256
    for bad in ("mistral-v1", "mistral-7b", "x"):
        with pytest.raises(TokenizerError, match="cl100k_base"):
            registry.from_name(bad)
    with pytest.raises(VocabError):
        Tokenizer.from_pretrained("cl100k_base", "/nowhere")


def test_named_vocabulary_from_its_file(tmp_path):
    (tmp_path / "mistral.tiktoken").write_text(tiny.FILE)
    t = Tokenizer.from_pretrained("mistral", str(tmp_path))
    assert t.mode == "sentencepiece" and t.encode_with_special("</s>the") == [2, 264] and t.vocab_size == 32054
    assert base64.b64encode(t.decode_bytes([264])) == b"dGhl"


def test_sql_functions(spark):
    t = raw()
    t.register(spark, "own")
    r = spark.sql("SELECT own_encode('the and') AS a, own_decode(array(264)) AS b, own_encode(NULL) AS c").first()
    assert (r["a"], r["b"], r["c"]) == (t.encode("the and"), "the", None)
    assert [x["token_id"] for x in spark.sql("SELECT * FROM own_tokenize('the and') ORDER BY pos").collect()] == t.encode("the and")

"""The named vocabularies: modes, patterns, special ids; and the agent tokens that all of them have, by one table."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession

from textmill import patterns
from textmill.errors import TokenizerError, VocabError

#: Names in order of their ids; + adds the closing token.
_AGENT = "system user assistant im_start im_end think+ plan+ step+ act+ observe+ function+ result+ error+ code+ output+ lang+ context+ quote+ cite+ source+ memory+ recall+ pad stop sep image+ audio+ video+ title+ section+ summary+"
_MEDIA = {"image", "audio", "video"}


def agent_table(base: int, media: bool = True) -> list[tuple[str, str, int]]:
    """(constant, token, id) of the agent tokens of a vocabulary."""
    out, k = [], base
    for word in _AGENT.split():
        name = word.rstrip("+")
        for const, mark in [(name.upper(), name), (f"{name.upper()}_END", f"/{name}")][: 1 + word.endswith("+")]:
            if media or name not in _MEDIA:
                out.append((const, f"<|{mark}|>", k))
            k += 1
    return out


def _run(first: int, words: str, shape: str = "<|{}|>") -> dict[str, int]:
    return {shape.format(w): first + k for k, w in enumerate(words.split())}


_WIDE = "<｜{}｜>"
_CALLS = "[{}]"


@dataclass(frozen=True)
class Named:
    name: str
    aliases: tuple[str, ...]
    mode: str
    pattern: str
    bos: int | None
    eos: int
    pad: int
    agent_base: int
    vocab_size: int
    native: dict[str, int]
    constants: dict[str, int] = field(default_factory=dict)
    media: bool = True
    file: str = ""

    def agent(self) -> list[tuple[str, str, int]]:
        return agent_table(self.agent_base, self.media)

    def special_tokens(self) -> dict[str, int]:
        return self.native | {token: k for _, token, k in self.agent()}


_LLAMA = {"<|begin_of_text|>": 128000, "<|end_of_text|>": 128001} | _run(128002, "reserved_special_token_0 reserved_special_token_1") | _run(128004, "finetune_right_pad_id step_id start_header_id end_header_id eom_id eot_id python_tag") | _run(128256, "image /image audio /audio video /video")
_DEEP = _run(0, "begin▁of▁sentence end▁of▁sentence ▁pad▁", _WIDE) | {"<think>": 128798, "</think>": 128799} | _run(128800, "fim▁hole fim▁begin fim▁end User Assistant", _WIDE) | {"<|EOT|>": 128805} | _run(128806, " ".join(f"tool▁{x}▁{y}" for x in ("calls", "call", "outputs", "output") for y in ("begin", "end")) + " tool▁sep", _WIDE)
_V1 = _run(0, "unk s /s", "<{}>")
_V2 = _run(3, "INST /INST TOOL_CALLS AVAILABLE_TOOLS /AVAILABLE_TOOLS TOOL_RESULTS /TOOL_RESULTS", _CALLS)
_V3 = _V1 | _run(3, "INST /INST AVAILABLE_TOOLS /AVAILABLE_TOOLS TOOL_RESULTS /TOOL_RESULTS TOOL_CALLS", _CALLS)


def _consts(tokens: dict[str, int], rename: dict[str, str] | None = None, skip: tuple[str, ...] = ()) -> dict[str, int]:
    out = {}
    for token, k in tokens.items():
        word = token.strip("<>[]|｜").strip("▁")
        name = word.lstrip("/").replace("▁", "_").upper() + ("_END" if word.startswith("/") else "")
        if token not in skip:
            out[(rename or {}).get(name, name)] = k
    return out


_NATIVE_NAMES = {n: f"{n}_NATIVE" for n in ("PAD", "THINK", "THINK_END", "USER", "ASSISTANT")}
NAMED = {
    n.name: n
    for n in (
        Named("cl100k_base", (), "raw", patterns.CL100K_BASE_PATTERN, None, 100257, 100316, 100277, 100331, _run(100257, "endoftext fim_prefix fim_middle fim_suffix") | {"<|endofprompt|>": 100276}, file="cl100k_base.tiktoken"),
        Named("o200k_base", (), "raw", patterns.O200K_BASE_PATTERN, None, 199999, 200058, 200019, 200073, {"<|endoftext|>": 199999, "<|endofprompt|>": 200018}, file="o200k_base.tiktoken"),
        Named("llama3", tuple(f"llama3.{k}" for k in (1, 2, 3)), "raw", patterns.LLAMA3_PATTERN, 128000, 128001, 128339, 128300, 128354, _LLAMA, _consts(_LLAMA, skip=("<|reserved_special_token_0|>", "<|reserved_special_token_1|>")), False, "llama3.tiktoken"),
        Named("deepseek_v3", ("deepseek-v3",), "byte_level", patterns.LLAMA3_PATTERN, 0, 1, 2, 128900, 128954, _DEEP, _consts(_DEEP, _NATIVE_NAMES), file="deepseek_v3.tiktoken"),
        Named("mistral_v1", ("mistral",), "sentencepiece", patterns.SENTENCEPIECE_PATTERN, 1, 2, 32039, 32000, 32054, _V1, file="mistral.tiktoken"),
        Named("mistral_v2", (), "sentencepiece", patterns.SENTENCEPIECE_PATTERN, 1, 2, 32807, 32768, 32822, _V2, file="mistral_v2.tiktoken"),
        Named("mistral_v3", (), "byte_level", patterns.MISTRAL_V3_PATTERN, 1, 2, 131111, 131072, 131126, _V3, _consts({t: k for t, k in _V3.items() if k > 2}), file="mistral_v3.tiktoken"),
    )
}
_BY_NAME = {alias: n for n in NAMED.values() for alias in (n.name, *n.aliases)}


def supported_names() -> list[str]:
    return list(_BY_NAME)


def from_name(name: str) -> Named:
    if name not in _BY_NAME:
        raise TokenizerError(f"unknown vocabulary {name!r}; known: {', '.join(_BY_NAME)}")
    return _BY_NAME[name]


def eos_token_id_by_name(name: str) -> int:
    """0 if the name is unknown."""
    return _BY_NAME[name].eos if name in _BY_NAME else 0


def eos_token_id(name: str) -> int:
    return from_name(name).eos


def bos_token_id(name: str) -> int | None:
    return from_name(name).bos


def pad_token_id(name: str) -> int:
    return from_name(name).pad


def pattern(name: str) -> str:
    return from_name(name).pattern


def special_tokens(name: str) -> dict[str, int]:
    return from_name(name).special_tokens()


def uses_byte_level(name: str) -> bool:
    """Whether tokens are written in the byte alphabet; so too for mistral_v3, whose mode is byte level."""
    return from_name(name).mode == "byte_level"


def vocab_path(name: str, folder: str | None = None) -> str:
    """Where a named vocabulary's file should be: in ``folder``, else in the folder that TEXTMILL_VOCAB_DIR names."""
    n, folder = from_name(name), folder or os.environ.get("TEXTMILL_VOCAB_DIR")
    if not folder:
        raise VocabError(f"{n.name} needs its file {n.file}: give its folder, or set TEXTMILL_VOCAB_DIR")
    path = os.path.join(folder, n.file)
    if not os.path.exists(path):
        raise VocabError(f"{n.name} needs {path}, which isn't there")
    return path


def _class(name: str) -> SimpleNamespace:
    n = NAMED[name]
    return SimpleNamespace(**({c: k for c, _, k in n.agent()} | n.constants))


AGENT_TOKENS = {name: _class(name) for name in NAMED}
CL100K_AGENT_TOKENS = AGENT_TOKENS["cl100k_base"]
O200K_AGENT_TOKENS = AGENT_TOKENS["o200k_base"]
LLAMA3_AGENT_TOKENS = AGENT_TOKENS["llama3"]
DEEPSEEK_V3_AGENT_TOKENS = AGENT_TOKENS["deepseek_v3"]
MISTRAL_V1_AGENT_TOKENS = AGENT_TOKENS["mistral_v1"]
MISTRAL_V2_AGENT_TOKENS = AGENT_TOKENS["mistral_v2"]
MISTRAL_V3_AGENT_TOKENS = AGENT_TOKENS["mistral_v3"]


def registry(spark: SparkSession) -> DataFrame:
    rows = [(alias, n.name, n.mode, n.pattern, n.bos, n.eos, n.pad, n.agent_base, n.vocab_size, len(n.special_tokens())) for n in NAMED.values() for alias in (n.name, *n.aliases)]
    return spark.createDataFrame(rows, "name string, alias_of string, mode string, pattern string, bos int, eos int, pad int, agent_base int, vocab_size int, n_special int")


def agent_tokens(spark: SparkSession) -> DataFrame:
    rows = [(n.name, c, token, k) for n in NAMED.values() for c, token, k in n.agent()]
    return spark.createDataFrame(rows, "vocab string, const_name string, token string, token_id int")

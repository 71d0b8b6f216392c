"""Byte-pair tokenization of tables of text, on Spark."""

from textmill.errors import TokenizerError, VocabError
from textmill.functions.bpe import byte_pair_encode
from textmill.functions.bytelevel import byte_level_decode, byte_level_decode_bytes, byte_level_encode
from textmill.patterns import CL100K_BASE_PATTERN, LLAMA3_PATTERN, MISTRAL_V3_PATTERN, O200K_BASE_PATTERN, SENTENCEPIECE_PATTERN
from textmill.plans.registry import AGENT_TOKENS, CL100K_AGENT_TOKENS, DEEPSEEK_V3_AGENT_TOKENS, LLAMA3_AGENT_TOKENS, MISTRAL_V1_AGENT_TOKENS, MISTRAL_V2_AGENT_TOKENS, MISTRAL_V3_AGENT_TOKENS, O200K_AGENT_TOKENS
from textmill.streaming.decoder import ByteLevelStreamingDecoder, StreamingDecoder
from textmill.tokenizer import Tokenizer

__all__ = ["AGENT_TOKENS", "CL100K_AGENT_TOKENS", "CL100K_BASE_PATTERN", "DEEPSEEK_V3_AGENT_TOKENS", "LLAMA3_AGENT_TOKENS", "LLAMA3_PATTERN", "MISTRAL_V1_AGENT_TOKENS", "MISTRAL_V2_AGENT_TOKENS", "MISTRAL_V3_AGENT_TOKENS", "MISTRAL_V3_PATTERN", "O200K_AGENT_TOKENS", "O200K_BASE_PATTERN", "SENTENCEPIECE_PATTERN", "ByteLevelStreamingDecoder", "StreamingDecoder", "Tokenizer", "TokenizerError", "VocabError", "byte_level_decode", "byte_level_decode_bytes", "byte_level_encode", "byte_pair_encode"]

"""DuckDB SQL for the queries, with the vocabulary written into it.

Its regular expressions have no look-ahead. So a mark (U+E000) is put before the last blank of a run that
a non-blank follows, and patterns end a run there. Merging is a recursion over lists of parts in hex.
"""

from __future__ import annotations

from textmill.plans import registry, tiny

_W = r"\s\x0b\x{85}\p{Z}"
_MARK = r"\x{E000}"
_MARKED = rf"regexp_replace(CASE WHEN contains(text, chr(57344)) THEN error('a text has U+E000') ELSE text END, '([\t\x0b\x0c\x{{85}}\p{{Z}}])([^{_W}])', chr(57344) || '\1\2', 'g')"
_END = rf"[{_W}]*[\r\n]+|[{_W}]+"
_ENGLISH = "(?i:" + "|".join("''" + x for x in "s t re ve m ll d".split()) + ")"
_LEAD = rf"[^\r\n\p{{L}}\p{{N}}{_MARK}]?"
_UP, _LOW = ("[" + "".join(rf"\p{{{x}}}" for x in c.split()) + "]" for c in ("Lu Lt Lm Lo M", "Ll Lm Lo M"))


def _marks(tail: str) -> str:
    return rf" ?[^{_W}\p{{L}}\p{{N}}{_MARK}]+[{tail}]*"


def _cased(end: str) -> str:
    return f"{_LEAD}{_UP}*{_LOW}+{end}|{_LEAD}{_UP}+{_LOW}*{end}"


PATTERNS = {
    "cl100k": rf"{_ENGLISH}|{_LEAD}\p{{L}}+|\p{{N}}{{1,3}}|{_marks(r'\r\n')}|{_END}",
    "o200k": rf"{_cased(_ENGLISH + '?')}|\p{{N}}{{1,3}}|{_marks(r'\r\n')}|{_END}",
    "mistral_v3": rf"{_cased('')}|\p{{N}}|{_marks(r'\r\n/')}|{_END}",
}
PATTERNS["llama3"] = PATTERNS["o200k"]


def chunks(name: str) -> str:
    """Chunks of ``text``."""
    if name == "sentencepiece":
        return f"regexp_extract_all(text, '[^{_W}]+|[{_W}]+')"
    if name == "custom":
        return "regexp_extract_all(text, '[a-z]{2,}|[0-9]+')"
    return f"regexp_extract_all({_MARKED}, '{PATTERNS[name]}')"


def _split(name: str) -> str:
    return f"WITH c AS (SELECT doc_id, {chunks(name)} AS c FROM documents) SELECT doc_id, len(c)::BIGINT AS n_chunks, array_to_string(c, chr(30)) AS chunks FROM c"


_LINES = ", ".join(f"({k}, '{t.hex().upper()}', {r})" for k, (t, r) in enumerate(tiny.LINES))
_VOCAB = f"lines(line_no, token, rank) AS (VALUES {_LINES}),\nvocab AS (SELECT token, arg_max(rank, line_no) AS rank FROM lines GROUP BY token)"
_MAPPED_CHAR = "chr(CASE WHEN b <= 32 THEN 256 + b WHEN b BETWEEN 127 AND 160 THEN 162 + b WHEN b = 173 THEN 323 ELSE b END)"


def mapped(text: str) -> str:
    """A text in the byte alphabet."""
    return f"list_aggregate(list_transform(list_transform(regexp_extract_all(hex({text}), '..'), lambda h: ('0x' || h)::INT), lambda b: {_MAPPED_CHAR}), 'string_agg', '')"


def _unmapped(text: str) -> str:
    """The bytes, in hex, of a text in the byte alphabet, or null."""
    byte = "CASE WHEN b BETWEEN 256 AND 288 THEN b - 256 WHEN b BETWEEN 289 AND 322 THEN b - 162 WHEN b = 323 THEN 173 ELSE b END"
    return rf"CASE WHEN regexp_full_match({text}, '[\x21-\x7e\xa1-\xac\xae-\xff\x{{100}}-\x{{143}}]*') THEN coalesce(list_aggregate(list_transform(list_transform(regexp_extract_all({text}, '(?s).'), lambda c: unicode(c)), lambda b: printf('%02X', {byte})), 'string_agg', ''), '') END"


_MAPPED_VOCAB = f"plain(line_no, token, rank) AS (VALUES {_LINES}),\nlines AS (SELECT line_no, hex({mapped('unhex(token)')}) AS token, rank FROM plain),\nvocab AS (SELECT token, arg_max(rank, line_no) AS rank FROM lines GROUP BY token)"

#: Ids of each ``piece`` (in hex) of ``pieces``, as a list: looked up whole, else merged.
_MERGE = """
todo AS (SELECT DISTINCT piece FROM pieces),
merging(piece, parts) AS (
  SELECT piece, regexp_extract_all(piece, '..') FROM todo WHERE piece NOT IN (SELECT token FROM vocab)
  UNION ALL
  SELECT piece, parts[:i - 1] || [parts[i] || parts[i + 1]] || parts[i + 2:]
  FROM (SELECT x.piece, x.parts, arg_min(x.i, v.rank::BIGINT * 10000000 + x.i) AS i
        FROM (SELECT piece, parts, unnest(range(1, len(parts))) AS i FROM merging) x JOIN vocab v ON v.token = x.parts[x.i] || x.parts[x.i + 1]
        GROUP BY x.piece, x.parts)),
ended AS (SELECT piece, arg_min(parts, len(parts)) AS parts FROM merging GROUP BY piece),
own AS (
  SELECT piece, [rank] AS ids FROM todo JOIN vocab ON token = piece
  UNION ALL
  SELECT e.piece, coalesce(list(v.rank ORDER BY e.i) FILTER (v.rank IS NOT NULL), []) FROM (SELECT piece, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM ended) e LEFT JOIN vocab v ON v.token = e.p GROUP BY e.piece)"""


def ids_of(source: str, id_col: str, hex_of: str, pattern: str, vocab: str = _VOCAB) -> str:
    """CTEs up to ``coded`` (id, ids) for the texts of a source without special tokens."""
    return f"""WITH RECURSIVE {vocab},
texts AS (SELECT {id_col} AS id, text FROM {source}),
cut AS (SELECT id, unnest(c) AS chunk, generate_subscripts(c, 1) AS ix FROM (SELECT id, {chunks(pattern)} AS c FROM texts)),
pieces AS (SELECT id, ix, {hex_of} AS piece FROM cut),{_MERGE},
coded AS (SELECT t.id, coalesce(any_value(x.ids), []) AS ids FROM texts t LEFT JOIN (SELECT id, flatten(list(ids ORDER BY ix)) AS ids FROM pieces JOIN own USING (piece) GROUP BY id) x USING (id) WHERE t.text IS NOT NULL GROUP BY t.id)"""


def _shown(id_col: str) -> str:
    return f"\nSELECT id AS {id_col}, len(ids)::BIGINT AS n_tokens, array_to_string(ids, ',') AS ids FROM coded"


#: Pieces of texts where spaces become marks and wait for the next piece.
_UNITS = r"""
bytewise AS (
  SELECT id, seg, ix, 0 AS sub, hex(chunk) AS h, 'w' AS kind FROM cut WHERE NOT regexp_matches(chunk, '^[ \t\n\x0c\r]')
  UNION ALL
  SELECT id, seg, ix, sub, h, CASE WHEN h = '20' THEN 's' ELSE 'b' END
  FROM (SELECT id, seg, ix, unnest(regexp_extract_all(hex(chunk), '..')) AS h, generate_subscripts(regexp_extract_all(hex(chunk), '..'), 1) AS sub FROM cut WHERE regexp_matches(chunk, '^[ \t\n\x0c\r]'))),
runs AS (SELECT *, coalesce(sum(CASE WHEN kind <> 's' THEN 1 ELSE 0 END) OVER (PARTITION BY id, seg ORDER BY ix, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM bytewise),
units AS (SELECT id, seg, g, count(*) FILTER (kind = 's') AS spaces, max(h) FILTER (kind <> 's') AS h, max(kind) FILTER (kind <> 's') AS kind FROM runs GROUP BY id, seg, g),
pieces AS (
  SELECT id, seg, g, unnest(p) AS piece, generate_subscripts(p, 1) AS sub
  FROM (SELECT id, seg, g, CASE WHEN kind = 'w' THEN [repeat('E29681', spaces) || h] ELSE CASE WHEN spaces > 0 THEN [repeat('E29681', spaces)] ELSE [] END || CASE WHEN kind = 'b' THEN [h] ELSE [] END END AS p FROM units)),"""

_PIECEWISE = f"""WITH RECURSIVE {_VOCAB},
cut AS (SELECT doc_id AS id, 0 AS seg, unnest(c) AS chunk, generate_subscripts(c, 1) AS ix FROM (SELECT doc_id, {chunks("sentencepiece")} AS c FROM documents)),{_UNITS}{_MERGE},
coded AS (SELECT t.doc_id AS id, coalesce(x.ids, []) AS ids FROM documents t LEFT JOIN (SELECT id, flatten(list(ids ORDER BY g, sub)) AS ids FROM pieces JOIN own USING (piece) GROUP BY id) x ON x.id = t.doc_id WHERE t.text IS NOT NULL)"""

_THOUGHTS = "thoughts AS (SELECT conv_id * 1000 + turn AS turn_id, '<|think|>' || role || '<|/think|> <|sep|><|sep|>' || text || '  <|pad|>' AS text FROM conversations)"


def _segments(source: str, id_col: str, specials: dict[str, int]) -> str:
    any_special = "|".join(s.replace("|", r"\|") for s in specials)
    inside = ", ".join(f"('{s}', {k})" for s, k in specials.items())
    return f"""specials(token, token_id) AS (VALUES {inside}),
cutting AS (SELECT {id_col} AS id, list_filter(string_split(regexp_replace(text, '({any_special})', chr(57345) || '\\1' || chr(57345), 'g'), chr(57345)), lambda x: x <> '') AS s FROM {source}),
segments AS (SELECT c.id, c.ix, c.s AS segment, p.token_id FROM (SELECT id, unnest(s) AS s, generate_subscripts(s, 1) AS ix FROM cutting) c LEFT JOIN specials p ON p.token = c.s)"""


def with_special(ctes: str, source: str, id_col: str, specials: dict[str, int] = tiny.CHAT) -> str:
    """Texts cut at special tokens, the gaps encoded apart."""
    return f"""WITH RECURSIVE {_VOCAB}, {ctes},
{_segments(source, id_col, specials)},
cut AS (SELECT id, seg, unnest(c) AS chunk, generate_subscripts(c, 1) AS ix FROM (SELECT id, ix AS seg, {chunks("cl100k")} AS c FROM (SELECT id, ix, segment AS text FROM segments WHERE token_id IS NULL))),
pieces AS (SELECT id, seg, ix, hex(chunk) AS piece FROM cut),{_MERGE},
coded AS (SELECT id, flatten(list(ids ORDER BY seg, ix)) AS ids FROM (SELECT id, seg, ix, ids FROM pieces JOIN own USING (piece) UNION ALL SELECT id, ix, 0, [token_id] FROM segments WHERE token_id IS NOT NULL) GROUP BY id)"""


_PIECE_SPECIAL = f"""WITH RECURSIVE {_VOCAB}, {_THOUGHTS},
{_segments("thoughts", "turn_id", tiny.SPECIALS)},
cut AS (SELECT id, seg, unnest(c) AS chunk, generate_subscripts(c, 1) AS ix FROM (SELECT id, ix AS seg, {chunks("sentencepiece")} AS c FROM (SELECT id, ix, segment AS text FROM segments WHERE token_id IS NULL))),{_UNITS}{_MERGE},
coded AS (SELECT id, flatten(list(ids ORDER BY seg, g, sub)) AS ids FROM (SELECT id, seg, g, sub, ids FROM pieces JOIN own USING (piece) UNION ALL SELECT id, ix, 0, 0, [token_id] FROM segments WHERE token_id IS NOT NULL) GROUP BY id)"""

_RAW = ids_of("documents", "doc_id", "hex(chunk)", "cl100k")
_BENCH = ids_of("benchmark", "item_id", "hex(chunk)", "cl100k")
#: What each id stands for; z's byte has none, as its second line counts.
_DECODER = f"""WITH {_VOCAB},
decoder AS (SELECT rank AS token_id, token FROM vocab UNION ALL SELECT * FROM (VALUES {", ".join(f"({k}, '{s.encode().hex().upper()}')" for s, k in tiny.CHAT.items())})),
ids AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS c, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) AS ix FROM documents),
joined AS (SELECT doc_id, string_agg(token, '' ORDER BY ix) AS h FROM ids JOIN decoder ON token_id = unicode(c) GROUP BY doc_id),
bytes AS (SELECT doc_id, coalesce(h, '') AS h FROM documents LEFT JOIN joined USING (doc_id) WHERE text IS NOT NULL)"""
_DECODED = _DECODER + "\nSELECT doc_id, h AS bytes FROM bytes"

#: For each byte of a text, what it completes; the byte of z is unknown.
_STREAM = """WITH chars AS (SELECT conv_id * 1000 + turn AS stream_id, unnest(regexp_extract_all(text, '(?s).')) AS c, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) AS ix FROM conversations),
placed AS (SELECT *, strlen(c) AS n, sum(strlen(c)) OVER (PARTITION BY stream_id ORDER BY ix) - strlen(c) AS first FROM chars),
bytewise AS (SELECT stream_id, (first + k - 1)::BIGINT AS seq, CASE WHEN k = n AND c <> 'z' THEN c END AS emitted, (CASE WHEN k < n THEN k ELSE 0 END)::INT AS pending_bytes FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM placed))"""
_STREAMED = _STREAM + "\nSELECT *, pending_bytes > 0 AS has_pending FROM bytewise"


def _counted(by: str) -> str:
    return f"\nSELECT {by}, count(*)::BIGINT AS docs, sum(len(ids))::BIGINT AS tokens FROM coded JOIN documents ON doc_id = id GROUP BY "


def _chat(form: str, before: str, **roles: tuple[str, str]) -> str:
    cases = " ".join(f"WHEN role = '{r}' THEN '{a}' || coalesce(text, '') || '{b}'" for r, (a, b) in roles.items())
    return f"SELECT conv_id, '{form}' AS form, '{before}' || string_agg(CASE {cases} ELSE coalesce(text, '') END, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id"


_CHATML = {r: (f"<|im_start|>{r}\n", "<|im_end|>\n") for r in ("system", "user", "assistant")}
_FORMS = "\nUNION ALL ".join([
    _chat("chatml", "", **_CHATML),
    _chat("header", "<|begin_of_text|>", **{r: (f"<|start_header_id|>{r}<|end_header_id|>\n\n", "<|eot_id|>") for r in _CHATML}),
    _chat("wide", "<｜begin▁of▁sentence｜>", system=("", ""), user=("<｜User｜>", ""), assistant=("<｜Assistant｜>", "<｜end▁of▁sentence｜>")),
    _chat("instruct", "<s>", system=("[INST] ", " [/INST]"), user=("[INST] ", " [/INST]"), assistant=(" ", "</s>")),
])
_INFILL = "infill AS (SELECT doc_id, '<|fim_prefix|>' || substring(text, 1, length(text) // 3) || '<|fim_suffix|>' || substring(text, 2 * (length(text) // 3) + 1) || '<|fim_middle|>' || substring(text, length(text) // 3 + 1, length(text) // 3) AS text FROM documents)"
_BASES = [("cl100k_base", 100277), ("o200k_base", 200019), ("llama3", 128300), ("deepseek_v3", 128900), ("mistral_v1", 32000), ("mistral_v2", 32768), ("mistral_v3", 131072)]
_AGENTS = "system,user,assistant,im_start,im_end,think,/think,plan,/plan,step,/step,act,/act,observe,/observe,function,/function,result,/result,error,/error,code,/code,output,/output,lang,/lang,context,/context,quote,/quote,cite,/cite,source,/source,memory,/memory,recall,/recall,pad,stop,sep,image,/image,audio,/audio,video,/video,title,/title,section,/section,summary,/summary"
_KNOWN = [
    ("cl100k_base", "cl100k_base", "raw", None, 100257, 100316, 100277, 100331, 59),
    ("o200k_base", "o200k_base", "raw", None, 199999, 200058, 200019, 200073, 56),
    *((x, "llama3", "raw", 128000, 128001, 128339, 128300, 128354, 65) for x in ("llama3", *(f"llama3.{k}" for k in range(1, 4)))),
    *((x, "deepseek_v3", "byte_level", 0, 1, 2, 128900, 128954, 74) for x in ("deepseek_v3", "deepseek-v3")),
    *((x, "mistral_v1", "sentencepiece", 1, 2, 32039, 32000, 32054, 57) for x in ("mistral_v1", "mistral")),
    ("mistral_v2", "mistral_v2", "sentencepiece", 1, 2, 32807, 32768, 32822, 61),
    ("mistral_v3", "mistral_v3", "byte_level", 1, 2, 131111, 131072, 131126, 64),
]

_LISTS = [
    ("cl100k_base", 100257, "<|endoftext|>,<|fim_prefix|>,<|fim_middle|>,<|fim_suffix|>"), ("cl100k_base", 100276, "<|endofprompt|>"),
    ("o200k_base", 199999, "<|endoftext|>"), ("o200k_base", 200018, "<|endofprompt|>"),
    ("llama3", 128000, "<|begin_of_text|>,<|end_of_text|>,<|reserved_special_token_0|>,<|reserved_special_token_1|>,<|finetune_right_pad_id|>,<|step_id|>,<|start_header_id|>,<|end_header_id|>,<|eom_id|>,<|eot_id|>,<|python_tag|>"),
    ("llama3", 128256, "<|image|>,<|/image|>,<|audio|>,<|/audio|>,<|video|>,<|/video|>"),
    ("deepseek_v3", 0, "<｜begin▁of▁sentence｜>,<｜end▁of▁sentence｜>,<｜▁pad▁｜>"), ("deepseek_v3", 128798, "<think>,</think>"),
    ("deepseek_v3", 128800, "<｜fim▁hole｜>,<｜fim▁begin｜>,<｜fim▁end｜>,<｜User｜>,<｜Assistant｜>,<|EOT|>,<｜tool▁calls▁begin｜>,<｜tool▁calls▁end｜>,<｜tool▁call▁begin｜>,<｜tool▁call▁end｜>,<｜tool▁outputs▁begin｜>,<｜tool▁outputs▁end｜>,<｜tool▁output▁begin｜>,<｜tool▁output▁end｜>,<｜tool▁sep｜>"),
    ("mistral_v1", 0, "<unk>,<s>,</s>"),
    ("mistral_v2", 3, "[INST],[/INST],[TOOL_CALLS],[AVAILABLE_TOOLS],[/AVAILABLE_TOOLS],[TOOL_RESULTS],[/TOOL_RESULTS]"),
    ("mistral_v3", 0, "<unk>,<s>,</s>,[INST],[/INST],[AVAILABLE_TOOLS],[/AVAILABLE_TOOLS],[TOOL_RESULTS],[/TOOL_RESULTS],[TOOL_CALLS]"),
]


def _value(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _rows(rows, columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)}) AS t({columns})"


SQL: dict[str, str] = {
    "vocab_load": f"WITH {_VOCAB} SELECT token, rank FROM vocab",
    "vocab_load_first": f"WITH {_VOCAB} SELECT token, arg_min(rank, line_no) AS rank FROM lines GROUP BY token",
    "vocab_decoder": f"WITH {_VOCAB} SELECT rank AS token_id, token FROM vocab",
    "vocab_full_decoder": f"WITH {_VOCAB} SELECT rank AS token_id, token FROM lines",
    "vocab_size": f"SELECT {max(tiny.CHAT.values())} + 1 AS vocab_size",
    "vocab_write_roundtrip": f"WITH {_VOCAB}, every AS (SELECT token, rank FROM vocab UNION ALL SELECT hex(text), (item_id + 1000)::INT FROM benchmark WHERE text IS NOT NULL) SELECT token, max(rank) AS rank FROM every GROUP BY token",
    "byte_fallback": "SELECT name, token FROM (SELECT printf('<0x%02X>', i) AS name, printf('%02X', i) AS token FROM range(256) t(i) UNION ALL SELECT n_name, hex(n_name) FROM nation)",
    "byte_alphabet": f"SELECT b::INT AS byte, {_MAPPED_CHAR.replace('chr(', 'chr((').replace('END)', 'END)::INT)')} AS ch FROM range(256) t(b)",
    "byte_level_encode": f"SELECT doc_id, coalesce({mapped('text')}, '') AS mapped FROM documents",
    "byte_level_decode": f"SELECT 'back' AS kind, doc_id AS id, hex(text) AS bytes FROM documents UNION ALL SELECT 'text', doc_id, {_unmapped('text')} FROM documents UNION ALL SELECT 'url', page_id, {_unmapped('url')} FROM pages",
    **{f"split_{k}": _split(k) for k in ("cl100k", "o200k", "llama3", "mistral_v3", "sentencepiece", "custom")},
    "special_split": f"WITH {_THOUGHTS}, {_segments('thoughts', 'turn_id', tiny.SPECIALS)} SELECT id AS turn_id, (ix - 1)::INT AS segment_ix, token_id IS NOT NULL AS special, segment FROM segments",
    "bpe_fast_path": f"WITH {_VOCAB}, cut AS (SELECT unnest({chunks('cl100k')}) AS chunk FROM documents), n AS (SELECT chunk, count(*) AS n FROM cut GROUP BY chunk) SELECT rank AS token_id, count(*)::BIGINT AS distinct_chunks, sum(n)::BIGINT AS n_chunks FROM n LEFT JOIN vocab ON token = hex(chunk) GROUP BY rank",
    "bpe_merge": _RAW + "\nSELECT chunk, array_to_string(ids, ',') AS ids FROM (SELECT DISTINCT chunk FROM cut) c JOIN own ON piece = hex(chunk) WHERE hex(chunk) NOT IN (SELECT token FROM vocab)",
    "encode_raw": _RAW + _shown("doc_id"),
    "encode_bytelevel": ids_of("documents", "doc_id", f"hex({mapped('chunk')})", "cl100k", _MAPPED_VOCAB) + _shown("doc_id"),
    "encode_sentencepiece": _PIECEWISE + _shown("doc_id"),
    "encode_with_special": with_special(_THOUGHTS, "thoughts", "turn_id") + _shown("turn_id"),
    "encode_special_as_text": ids_of("(SELECT conv_id * 1000 + turn AS turn_id, '<|think|>' || role || '<|/think|> <|sep|><|sep|>' || text || '  <|pad|>' AS text FROM conversations)", "turn_id", "hex(chunk)", "cl100k") + _shown("turn_id"),
    "encode_sentencepiece_special": _PIECE_SPECIAL + _shown("turn_id"),
    "encode_parallel_equiv": _RAW + _shown("doc_id"),
    "encode_function": _BENCH + "\nSELECT item_id, len(ids)::BIGINT AS n_tokens, text FROM coded JOIN benchmark ON item_id = id",
    "tokenize_table_function": _BENCH + ", flat AS (SELECT id, unnest(ids) AS token_id, generate_subscripts(ids, 1) AS i FROM coded)\nSELECT id AS item_id, (i - 1)::INT AS pos, token_id, token FROM flat JOIN vocab ON rank = token_id",
    "decode_bytes": _DECODED,
    "decode_relational": _DECODED,
    "decode_strict": _DECODER + "\nSELECT doc_id, TRY(decode(unhex(h))) AS text FROM bytes",
    "decode_sentencepiece": "SELECT doc_id, replace(text, '▁', ' ') AS text FROM documents",
    "roundtrip": "SELECT doc_id, text FROM documents",
    "roundtrip_bytelevel": "SELECT doc_id, text FROM documents",
    "stream_decode": _STREAMED,
    "stream_decode_bytelevel": _STREAMED,
    "stream_pending": _STREAM + "\nSELECT stream_id, max(pending_bytes)::INT AS most, count(*) FILTER (pending_bytes > 0)::BIGINT AS times FROM bytewise GROUP BY stream_id",
    "stream_flush": "SELECT conv_id * 1000 + turn AS stream_id, seq::BIGINT AS seq, emitted, pending_bytes::INT AS pending_bytes, pending_bytes > 0 AS has_pending FROM conversations, (VALUES (1000000, NULL, 1), (1000001, NULL, 0), (1000002, NULL, 1), (1000003, NULL, 2), (1000004, chr(65533), 0)) t(seq, emitted, pending_bytes) WHERE text <> ''",
    "stream_text": "SELECT conv_id * 1000 + turn AS stream_id, replace(text, 'z', '') AS text FROM conversations WHERE replace(text, 'z', '') <> ''",
    "token_count_by_lang": ids_of("documents", "doc_id", "hex(chunk)", "sentencepiece") + _counted("lang") + "lang",
    "token_count_cube": _RAW + _counted("lang, source") + "CUBE (lang, source)",
    "compression": _PIECEWISE.replace("coded AS", "piecewise AS").replace("own AS", "piece_ids AS").replace("JOIN own", "JOIN piece_ids").replace("WITH RECURSIVE", "WITH RECURSIVE") + ", raw_counts AS (SELECT doc_id, n_tokens FROM (" + _RAW + _shown("doc_id") + "))\nSELECT lang, sum(strlen(text))::BIGINT AS bytes, sum(n_tokens)::BIGINT AS raw_tokens, sum(len(ids))::BIGINT AS piece_tokens FROM documents JOIN raw_counts USING (doc_id) JOIN piecewise ON id = doc_id GROUP BY lang",
    "token_frequency_topk": _RAW + ", flat AS (SELECT unnest(ids) AS token_id FROM coded)\nSELECT token_id, count(*)::BIGINT AS n FROM flat GROUP BY token_id ORDER BY n DESC, token_id LIMIT 20",
    "chat_formats": _FORMS,
    "chatml_tokens": with_special("rendered AS (" + _chat("chatml", "", **_CHATML) + ")", "rendered", "conv_id") + _shown("conv_id"),
    "infill_tokens": with_special(_INFILL, "infill", "doc_id") + _shown("doc_id"),
    "special_span_extract": with_special(_THOUGHTS, "thoughts", "turn_id") + ", marks AS (SELECT id, list_position(ids, 302) AS a, list_position(ids, 303) AS b FROM coded)\nSELECT id AS turn_id, 0 AS span_ix, a::INT AS first, (b - 1)::INT AS last FROM marks",
    "agent_tokens": f"""WITH names AS (SELECT unnest(string_split('{_AGENTS}', ',')) AS name, generate_subscripts(string_split('{_AGENTS}', ','), 1) - 1 AS k),
bases AS ({_rows(_BASES, "vocab, base")})
SELECT vocab, CASE WHEN name[1] = '/' THEN upper(name[2:]) || '_END' ELSE upper(name) END AS const_name, '<|' || name || '|>' AS token, (base + k)::INT AS token_id FROM names, bases WHERE NOT (vocab = 'llama3' AND ltrim(name, '/') IN ('image', 'audio', 'video'))""",
    "native_specials": "SELECT vocab, unnest(string_split(list, ',')) AS token, (first - 1 + generate_subscripts(string_split(list, ','), 1))::INT AS token_id FROM (" + _rows(_LISTS, "vocab, first, list") + ")",
    "vocab_registry": "SELECT name, alias_of, mode, pattern, bos::INT AS bos, eos, pad, agent_base, vocab_size, n_special FROM (" + _rows([(*r[:3], registry.NAMED[r[1]].pattern, *r[3:]) for r in _KNOWN], "name, alias_of, mode, pattern, bos, eos, pad, agent_base, vocab_size, n_special") + ")",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

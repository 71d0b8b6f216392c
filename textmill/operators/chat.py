"""Chat and infilling formats as columns, and spans between special tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of each format: what comes before a conversation, and for each role (other: any other) what comes before and after its text.
FORMATS: dict[str, tuple[str, dict[str, tuple[str, str]]]] = {
    "chatml": ("", {r: (f"<|im_start|>{r}\n", "<|im_end|>\n") for r in ("system", "user", "assistant")}),
    "header": ("<|begin_of_text|>", {r: (f"<|start_header_id|>{r}<|end_header_id|>\n\n", "<|eot_id|>") for r in ("system", "user", "assistant")}),
    "wide": ("<｜begin▁of▁sentence｜>", {"system": ("", ""), "user": ("<｜User｜>", ""), "assistant": ("<｜Assistant｜>", "<｜end▁of▁sentence｜>")}),
    "instruct": ("<s>", {"system": ("[INST] ", " [/INST]"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")}),
}


def turn_text(role: Column, text: Column, form: str) -> Column:
    """One turn; a role that the format doesn't know is written as plain text, a null text as none."""
    out = F.coalesce(text, F.lit(""))
    whole = out
    for name, (before, after) in FORMATS[form][1].items():
        whole = F.when(role == name, F.concat(F.lit(before), out, F.lit(after))).otherwise(whole)
    return whole


def render(conversations: DataFrame, form: str, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, text): whole conversations, their turns in order; the shuffle is by conversation."""
    turns = conversations.select(id_col, F.struct(F.col(turn_col), turn_text(F.col(role_col), F.col(text_col), form).alias("t")).alias("x"))
    parts = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"])
    return turns.groupBy(id_col).agg(F.concat(F.lit(FORMATS[form][0]), F.array_join(parts, "")).alias("text"))


def infill(prefix: Column, middle: Column, suffix: Column) -> Column:
    """Prefix, suffix, then the middle to be filled in."""
    return F.concat(F.lit("<|fim_prefix|>"), prefix, F.lit("<|fim_suffix|>"), suffix, F.lit("<|fim_middle|>"), middle)


def token_rows(df: DataFrame, id_col: str, ids_col: Column | str = "ids") -> DataFrame:
    """(id, tok_ix, token_id). Ids that are to be encoded are best given as that column: of a column's name, Spark makes a filter, which would encode them once more."""
    return df.select(id_col, F.posexplode(ids_col).alias("tok_ix", "token_id"))


def spans(tokens: DataFrame, opening: int, closing: int, id_col: str = "doc_id") -> DataFrame:
    """(id, span_ix, first, last) of the tokens between an opening and the next closing token. An opening without a closing has no span; of two in a row, the later counts."""
    at = Window.partitionBy(id_col).orderBy("tok_ix")
    marks = tokens.where(F.col("token_id").isin(opening, closing))
    found = marks.withColumns({"before": F.lag("token_id").over(at), "opened": F.lag("tok_ix").over(at)}).where((F.col("token_id") == closing) & (F.col("before") == opening))
    return found.select(id_col, (F.row_number().over(at) - 1).alias("span_ix"), (F.col("opened") + 1).alias("first"), F.col("tok_ix").alias("last"))

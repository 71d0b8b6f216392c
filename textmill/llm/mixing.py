"""Mixing sources to target weights, to the exact token.

Every document gets a hash-random key. The keys are uniform, so the leading hex digits of a key cut
each source into ranges that can be sorted apart; the ranges' token counts, summed over all ranges
before, carry a document's place in its range to its place in the source. A source of B tokens to
spend and T tokens in all is taken B div T times whole and then up to its (B mod T)th token; the
document on that border gives just the tokens that are still missing.

Only ids, keys and counts are shuffled, never texts.

Defined results: a null or empty text has no tokens and is never taken. Documents of null source form
a source of their own. A null id counts as an empty one. Rows that repeat are documents each; rows that
agree in id and text are taken in the order of their languages, nulls first, and keep those. Columns beyond those named are ignored.
A source without tokens or weight takes no part, and the whole goes to the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import Workspace

WORD = r"[^ \t\n\r\f]+"
#: Hex digits that name a range of keys: 65,536 ranges of each source, of 150,000 documents each if it has ten thousand million.
RANGE_DIGITS = 4


def token_count(text: Column) -> Column:
    """Runs of characters other than space, tab, newline, return and form feed."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def budgets(totals: DataFrame, total_tokens: int | None, weights: dict[str, int] | None) -> DataFrame:
    """Each source's exact budget from whole-numbered weights (all alike if none are given); what division leaves goes, token by token, to the largest remainders, then by name. total_tokens is that of the corpus if not given."""
    if weights is None:
        w = totals.withColumn("w", F.lit(1))
    else:
        pairs = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,int>")
        w = totals.withColumn("w", F.coalesce(F.element_at(pairs, F.col("src")), F.lit(0)))
    w = w.where("w > 0 and total > 0")
    everything = Window.partitionBy()  # a row for each source
    w = w.withColumn("goal", F.lit(total_tokens) if total_tokens is not None else F.sum("total").over(everything))
    part = F.col("goal").cast("decimal(20,0)") * F.col("w").cast("decimal(10,0)")
    w = w.withColumns({"part": part, "sum_w": F.sum("w").over(everything)}).withColumns({"base": F.expr("part div sum_w"), "left_over": F.expr("part % sum_w")})
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("left_over"), F.asc("src")))
    extra = F.when(rank <= F.col("goal") - F.sum("base").over(everything), 1).otherwise(0)
    return w.withColumn("budget", F.col("base") + extra).selectExpr("src", "budget", "budget div total full", "budget % total rest")


def _group(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))


def _key(seed: int, id_col: str, text_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))


def mix_sources(docs: DataFrame, weights: dict[str, int] | None = None, total_tokens: int | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each document and epoch that is taken: its place in its source (``start_token``), its tokens, and how many of them are taken."""
    return plan(docs, weights, total_tokens, seed, id_col, text_col, source_col).select("doc_id", F.when(F.col("src") != "", F.expr("substr(src, 2)")).alias("source"), "epoch", "start_token", "n_tokens", "take_tokens")


def plan(docs: DataFrame, weights: dict[str, int] | None, total_tokens: int | None, seed: int, id_col: str, text_col: str, source_col: str, lang_col: str | None = None) -> DataFrame:
    """As ``mix_sources``, with the group (``src``), key and language of each document. Texts are read once, for their keys and counts."""
    lang = F.lit(None).cast("string") if lang_col is None else F.col(lang_col)
    keyed = docs.select(F.col(id_col).alias("doc_id"), _group(source_col).alias("src"), lang.alias("lang"), token_count(F.col(text_col)).alias("n"), _key(seed, id_col, text_col).alias("key")).where("n > 0")
    keyed = Workspace(docs.sparkSession, "mixing").stash(keyed, "keys", compression="zstd")
    ranges = keyed.groupBy("src", F.substring("key", 1, RANGE_DIGITS).alias("range")).agg(F.sum("n").alias("tokens"))
    ranges = ranges.withColumn("before", F.sum("tokens").over(Window.partitionBy("src").orderBy("range")) - F.col("tokens"))
    weights = weights and {f"={k}" if k is not None else "": v for k, v in weights.items()}
    goals = budgets(ranges.groupBy("src").agg(F.sum("tokens").alias("total")), total_tokens, weights)
    place = ranges.join(goals, "src").select("src", "range", "before", "full", "rest")
    within = Window.partitionBy("src", "range").orderBy("key", "doc_id", "lang")
    placed = keyed.withColumn("range", F.substring("key", 1, RANGE_DIGITS)).withColumn("inner", F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).join(place, ["src", "range"]).withColumn("start", F.col("before") + F.col("inner"))
    last = F.greatest(F.lit(0), F.least(F.col("n"), F.col("rest") - F.col("start")))
    taken = placed.withColumn("epoch", F.explode(F.expr("sequence(0L, full)"))).withColumn("take", F.when(F.col("epoch") < F.col("full"), F.col("n")).otherwise(last)).where("take > 0")
    return taken.select("doc_id", "src", "lang", "key", "epoch", F.col("start").alias("start_token"), F.col("n").alias("n_tokens"), F.col("take").alias("take_tokens"))


def mix_texts(docs: DataFrame, weights: dict[str, int] | None = None, total_tokens: int | None = None, seed: int = 0) -> DataFrame:
    """The mixture itself: as ``mix_sources``, with language and text, which ends after the last token that is taken. Texts are shuffled once, by the key that the plan is joined on."""
    own = docs.select(_group("source").alias("src"), _key(seed, "doc_id", "text").alias("key"), "text").groupBy("src", "key").agg(F.first("text").alias("text"))
    cut = F.when(F.col("take_tokens") == F.col("n_tokens"), F.col("text")).otherwise(F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"[ \\t\\n\\r\\f]*{WORD}"), F.lit(0)), F.lit(1), F.col("take_tokens").cast("int")), ""))
    mixed = plan(docs, weights, total_tokens, seed, "doc_id", "text", "source", "lang").join(own, ["src", "key"])
    return mixed.select("doc_id", F.when(F.col("src") != "", F.expr("substr(src, 2)")).alias("source"), "lang", "epoch", "start_token", "n_tokens", "take_tokens", cut.alias("text"))


SQL = r"""
WITH k AS (
  SELECT doc_id, coalesce('=' || source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+')) AS n,
         md5('0|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS key
  FROM documents),
p AS (SELECT *, sum(n) OVER (PARTITION BY src ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - n AS start FROM k WHERE n > 0),
t AS (SELECT src, sum(n)::HUGEINT AS total FROM k WHERE n > 0 GROUP BY src),
g AS (SELECT *, sum(total) OVER () AS goal, count(*) OVER () AS m FROM t),
b AS (SELECT src, total, goal // m + CASE WHEN row_number() OVER (ORDER BY src) <= goal % m THEN 1 ELSE 0 END AS budget FROM g),
e AS (SELECT p.*, unnest(generate_series(0, (budget // total)::BIGINT)) AS epoch, budget // total AS whole, budget % total AS rest FROM p JOIN b USING (src))
SELECT doc_id, CASE WHEN src <> '' THEN src[2:] END AS source, epoch, start::BIGINT AS start_token, n::BIGINT AS n_tokens,
       (CASE WHEN epoch < whole THEN n ELSE greatest(0, least(n, rest - start)) END)::BIGINT AS take_tokens
FROM e WHERE (CASE WHEN epoch < whole THEN n ELSE greatest(0, least(n, rest - start)) END) > 0
"""

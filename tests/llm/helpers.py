"""Small tables with the hard cases: nulls in any column, empty and long texts, repeated rows, columns with clashing names."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use for columns of their own.
CLASHES = ["node", "key", "hub", "hash", "uid", "term", "entity", "actions", "action", "rank", "r", "h", "n", "range", "group_id", "n_docs", "keep", "gone_id", "again_id", "shard", "tuples", "entities", "removed", "src", "epoch", "total", "perplexity", "of", "middle", "accepted", "share", "batch", "item_id", "textmill_uid", "textmill_new"]


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame([(*r, *([None] * (5 - len(r)))) if schema == DOCS else r for r in rows], schema)


def clashing(df):
    for c in CLASHES:
        if c not in df.columns:
            df = df.selectExpr("*", f"'x' AS {c}")
    return df


def words(seed, n, size=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def long_text(seed=0, n=200_000):
    """Of more than a million characters."""
    return words(seed, n, 50_000)


def hard(text="plain words here"):
    return [(None, text, "en", "a"), (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", None, None), (4, text, None, "b"), (5, text, "en", None), (5, text, "en", None), (6, text, "en", "a")]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)

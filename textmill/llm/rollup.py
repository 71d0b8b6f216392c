"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A rollup is a folder. A batch of changes becomes rows of additive deltas, written to
``deltas/<batch>/<attempt>``; the batch takes effect when ``commits/<batch>`` is created, which names that attempt and can be
created once only. So a batch that is sent again, by a retry or by mistake, changes nothing, and one that broke off leaves
nothing that is read. Totals are sums over committed deltas. ``compact`` commits the sum of all batches so far as a base and
remembers their names, so that they still count as sent.

Changes are rows (op, source, lang, tokenizer, n_tokens, old_source, old_lang, old_tokenizer, old_tokens): ``insert`` adds a document, ``delete``
takes one away (its counts are the old ones), ``revise`` does both.

Defined results: null sources, languages and versions are groups of their own; null counts are 0. Documents of null or empty text count as documents of no tokens.
Repeated rows count each. A group that comes to no documents and no tokens has no row. Unknown ops are an error. An empty batch is committed like any other.
Columns beyond those named are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import Workspace

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"
#: Tokenizer versions: the pattern whose matches they count.
WORDS, PIECES = "words-1", "pieces-2"
PATTERNS = {WORDS: r"[^ \t\n\r\f]+", PIECES: r"[a-zA-Z\x{80}-\x{10FFFF}]+|[0-9]|[^ \t\n\r\fa-zA-Z0-9\x{80}-\x{10FFFF}]"}


def count(text: Column, version: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PATTERNS[version])), F.lit(0)).cast("bigint")


def tokenizer_count(tokenizer) -> Callable[[Column], Column]:
    """A counter of the tokens of a ``textmill`` Tokenizer, for a version of that name."""
    return lambda text: F.coalesce(tokenizer.count_col(text), F.lit(0)).cast("bigint")


def deltas(changes: DataFrame) -> DataFrame:
    """The signed sums of a batch, by group."""
    old = F.struct(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.col("old_tokenizer").alias("tokenizer"), F.lit(-1).cast("bigint").alias("docs"), (-F.coalesce("old_tokens", F.lit(0))).alias("tokens"))
    new = F.struct("source", "lang", "tokenizer", F.lit(1).cast("bigint").alias("docs"), F.coalesce("n_tokens", F.lit(0)).alias("tokens"))
    parts = F.when(F.col("op") == "insert", F.array(new)).when(F.col("op") == "delete", F.array(old)).when(F.col("op") == "revise", F.array(old, new)).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))))
    return changes.select(F.explode(parts).alias("d")).select("d.*").groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _list(self, name: str) -> list[str]:
        p = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p) if not s.getPath().getName().startswith(".")) if self._fs.exists(p) else []

    def _get(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, name: str, value: dict) -> bool:
        """Creates a file whole and once: written beside, then given its name. On a local file system that is a hard link, which fails if the name is taken; elsewhere a rename, which HDFS refuses in one step if it is. A store whose rename overwrites can't hold a rollup with more than one writer."""
        self._fs.mkdirs(self._path(name).getParent())
        beside = self._path(f"tmp/{uuid.uuid4().hex}")
        stream = self._fs.create(beside, False)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        target = self._path(name)
        if self._fs.getScheme() == "file":
            try:
                os.link(beside.toUri().getPath(), target.toUri().getPath())
                done = True
            except FileExistsError:
                done = False
            self._fs.delete(beside, False)
            return done
        done = not self._fs.exists(target) and self._fs.rename(beside, target)
        if not done:
            self._fs.delete(beside, False)
        return done

    def _base(self) -> dict:
        bases = self._list("bases")
        return self._get(f"bases/{bases[-1]}") if bases else {"attempt": None, "batches": []}

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits a batch; False if it was committed before."""
        if f"{batch}.json" in self._list("commits") or batch in self._base()["batches"]:
            return False
        attempt = f"deltas/{batch}/{uuid.uuid4().hex}"
        deltas(changes).write.parquet(f"{self.path}/{attempt}")
        return self._put(f"commits/{batch}.json", {"attempt": attempt})

    def _sum(self, base: dict, commits: list[str]) -> DataFrame:
        paths = [f"{self.path}/{self._get(f'commits/{c}')['attempt']}" for c in commits if c[:-5] not in base["batches"]]
        paths += [f"{self.path}/{base['attempt']}"] if base["attempt"] else []
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*paths).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        return self._sum(self._base(), self._list("commits"))

    def compact(self) -> None:
        """One base instead of many deltas."""
        base, commits = self._base(), self._list("commits")
        attempt = f"compacted/{uuid.uuid4().hex}"
        self._sum(base, commits).coalesce(1).write.parquet(f"{self.path}/{attempt}")
        n = len(self._list("bases"))
        self._put(f"bases/{n:09d}.json", {"attempt": attempt, "batches": sorted({*base["batches"], *(c[:-5] for c in commits)})})


def maintain(docs: DataFrame, labels: DataFrame, rollup: Rollup, counters: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """The rollup of a corpus' life: all documents come in, those labelled toxic go, those of quality 0 are counted anew by the next tokenizer; each batch is sent twice. ``counters`` are the two tokenizer versions, in order, and what counts their tokens: by default, two patterns."""
    (first, words), (second, pieces) = (counters or {v: functools.partial(count, version=v) for v in PATTERNS}).items()
    counted = docs.select("doc_id", "source", "lang", words(F.col("text")).alias("words"), pieces(F.col("text")).alias("pieces"))
    counted = Workspace(docs.sparkSession, "counts").stash(counted, "counts")
    none = {"old_source": "string", "old_lang": "string", "old_tokenizer": "string", "old_tokens": "bigint"}
    came = counted.select(F.lit("insert").alias("op"), "source", "lang", F.lit(first).alias("tokenizer"), F.col("words").alias("n_tokens"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    marked = counted.join(marks, "doc_id")
    was = [F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.lit(first).alias("old_tokenizer"), F.col("words").alias("old_tokens")]
    gone = marked.where("toxic = 1").select(F.lit("delete").alias("op"), *[F.lit(None).cast("string").alias(c) for c in KEYS], F.lit(None).cast("bigint").alias("n_tokens"), *was)
    anew = marked.where("quality = 0 and (toxic is null or toxic <> 1)").select(F.lit("revise").alias("op"), "source", "lang", F.lit(second).alias("tokenizer"), F.col("pieces").alias("n_tokens"), *was)
    for _ in range(2):
        for name, changes in (("came", came), ("gone", gone), ("anew", anew)):
            rollup.apply(name, changes)
    rollup.compact()
    return rollup.totals()


SQL = r"""
WITH m AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT source, lang, coalesce(toxic, 0) AS toxic, quality,
             len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+')) AS words,
             len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z\x{80}-\x{10FFFF}]+|[0-9]|[^ \t\n\r\fa-zA-Z0-9\x{80}-\x{10FFFF}]')) AS pieces
      FROM documents LEFT JOIN m USING (doc_id))
SELECT source, lang, CASE WHEN quality = 0 THEN 'pieces-2' ELSE 'words-1' END AS tokenizer, count(*)::BIGINT AS docs,
       sum(CASE WHEN quality = 0 THEN pieces ELSE words END)::BIGINT AS tokens
FROM d WHERE toxic <> 1 GROUP BY ALL
"""

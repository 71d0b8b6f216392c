"""Near duplicates by MinHash with tensored banding.

A document is the set of its runs of three tokens. Two collections of ``tables`` short minhash tuples,
``width`` minhashes in each, are computed; the key of table (i, j) joins tuple i of the first collection with tuple j of the
second. So 11 x 11 = 121 tables of four minhashes each cost 44 minhashes, where independent tables would cost 484.
Two documents of similarity s meet in some table with probability (1 - (1 - s^2)^11)^2: 0.92 at the
threshold of 0.5, 0.96 at 0.55, 0.99 at 0.65; 0.0007 at 0.05.

Every candidate is verified by the exact Jaccard similarity of the sets. Documents of the same
token sequence are one node from the start. First, each bucket's smallest node is compared with the others of its
bucket; what passes is joined into components. Wherever a bucket still holds nodes of more than
one component, pairs across components are compared as well: all of them in a bucket of ``FEW`` nodes at most. The nodes of larger buckets
are joined by prefix filtering instead, which loses no pair: two sets of similarity t or more share one of the |a| - ceil(t |a|) + 1 terms of a that are rarest
among those nodes, and one of b's. Pairs within one component are left out, since
they can't change it, and never meet in that join: two components meet at the highest bit in which their hashes differ. So the groups are the components of all verified candidate pairs (and of
pairs that only the prefix join met), and thousands of copies cost one comparison each.

Defined results: null and empty texts, and texts without tokens, are nobody's duplicates. A text of one or
two tokens is a duplicate of texts with the same tokens only. Of a group, the document of the smallest id
stays; null ids come last. Rows that repeat in id and text count as copies, and one stays. What goes is known by id and text, so other
texts of the same id, or of null ids, stay. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from textmill.llm.common import Workspace, mix, release, scramble, small, tidy, tokens_in

SHINGLE = 3
#: Nodes up to which all pairs of a bucket across components are compared.
FEW = 32


def _hashes(t, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's hash of its token sequence (0: no tokens), its shingles, and where they begin; a row too short for any has that hash as its shingle."""
    n = np.diff(t.first)
    at = np.arange(len(t.hash)) - np.repeat(t.first[:-1], n)
    term = mix(t.hash + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    total = np.concatenate([[np.uint64(0)], np.cumsum(term, dtype=np.uint64)])
    node = mix(total[t.first[1:]] - total[t.first[:-1]] + n.astype(np.uint64)) >> np.uint64(1)
    node[n == 0] = 0
    grams, first = t.grams(SHINGLE)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        grams = np.insert(grams, first[short], node[short])
        first = first + np.concatenate([[0], np.cumsum((n > 0) & (n < SHINGLE))])
    return node, grams, first


def sketch(docs: DataFrame, tables: int = 11, width: int = 2, seed: int = 1) -> DataFrame:
    """For each document (doc_id, text, text_hash) with tokens: its node and the tuples of both collections."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = scramble(seed, 2 * tables * width)
        for b in batches:
            for lo, hi, t in tokens_in(b.column(1)):
                node, grams, first = _hashes(t, lo, hi)
                rows = np.flatnonzero(node)
                if not len(rows):
                    continue
                tuples = np.zeros((len(rows), 2 * tables), np.uint64)
                for k, a in enumerate(by):
                    low = np.minimum.reduceat((grams * a) >> np.uint64(32), first[rows])
                    tuples[:, k // width] = mix(tuples[:, k // width] + low + np.uint64(k))
                flat = pa.array(tuples.ravel().view(np.int64))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo).take(pa.array(rows)) for c in (0, 2)), pa.array(node[rows].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (2 * tables)), flat)], ["doc_id", "text_hash", "node", "tuples"])

    return docs.mapInArrow(run, "doc_id bigint, text_hash bigint, node bigint, tuples array<bigint>")


def buckets(nodes: DataFrame, tables: int) -> DataFrame:
    """A row for each node and table."""
    keys = F.expr(f"flatten(transform(slice(tuples, 1, {tables}), a -> transform(slice(tuples, {tables + 1}, {tables}), (b, j) -> xxhash64(a, b, j))))")
    return nodes.select("node", F.explode(keys).alias("key"))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sorted 32-bit shingles of the wanted nodes (doc_id, node), from the texts of the documents that stand for them."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, t in tokens_in(b.column(1)):
                node, grams, first = _hashes(t, lo, hi)
                rows = np.flatnonzero(node)
                low = (grams >> np.uint64(32)).astype(np.uint32)
                sets = [np.unique(low[first[r] : first[r + 1]]).tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(node[rows].view(np.int64)), pa.array(sets, pa.binary())], ["node", "shingles"])

    ids = small(wanted.select("doc_id").distinct())
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").mapInArrow(run, "node bigint, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


#: Bytes of shingles that are compared at a time.
COMPARED = 1 << 21


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a column of sets, and where each set begins."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 4
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint32, int(at[-1])) if data is not None and at[-1] else np.zeros(0, np.uint32)
    return flat[at[0] :], at - at[0]


@F.arrow_udf(DoubleType())
def jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    """Of sorted sets without repeats, a row at a time in name only: the sets of many rows are two sorted arrays of (row, shingle)."""
    out, (x, i), (y, j) = np.zeros(len(a)), _flat(a), _flat(b)
    lo = 0
    while lo < len(out):
        hi = max(lo + 1, int(np.searchsorted(i + j, i[lo] + j[lo] + COMPARED // 4, "right")) - 1)
        row = np.arange(hi - lo, dtype=np.uint64) << np.uint64(32)
        n, m = np.diff(i[lo : hi + 1]), np.diff(j[lo : hi + 1])
        p, q = np.repeat(row, n) | x[i[lo] : i[hi]], np.repeat(row, m) | y[j[lo] : j[hi]]
        if len(p) and len(q):
            at = np.minimum(np.searchsorted(q, p), len(q) - 1)
            both = np.bincount((p[q[at] == p] >> np.uint64(32)).astype(np.int64), minlength=hi - lo)
            out[lo:hi] = both / np.maximum(n + m - both, 1)
        lo = hi
    release()
    return pa.array(out)


def verify(docs: DataFrame, edges: DataFrame, nodes: DataFrame, ws: Workspace, name: str, threshold: float) -> DataFrame:
    """The edges (a, b) whose sets reach the threshold."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = ws.stash(_sets(docs, nodes.select("doc_id", "node").join(ends, "node")), f"sets-{name}", compression="zstd")
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    good = edges.join(left, "a").join(right, "b").where(jaccard("set_a", "set_b") >= threshold).select("a", "b")
    good = ws.stash(good, f"good-{name}")
    ws.drop(f"sets-{name}")
    return good


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(node, root) for every node of the edges (a, b): alternating stars, each round a table, until nothing changes."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    last, k = None, 0
    while True:
        both = now.union(now.select("b", "a"))
        # each node's neighbours above it go to the least of its neighbours and itself
        large = both.withColumn("m", F.least("a", F.min("b").over(Window.partitionBy("a")))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # then each node and its neighbours below it go to the least of them
        low = large.where("a > b").distinct().withColumn("m", F.min("b").over(Window.partitionBy("a")))
        star = low.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a > b").distinct()
        now = ws.stash(star, f"stars-{name}-{k}")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if k:
            ws.drop(f"stars-{name}-{k - 1}")
        if mark == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        last, k = mark, k + 1


def across(docs: DataFrame, split: DataFrame, nodes: DataFrame, ws: Workspace, threshold: float) -> DataFrame:
    """Pairs (a, b) to compare of buckets (key, node, root, size) that hold more than one component."""
    x, y = (split.where(F.col("size") <= FEW).select("key", F.col("node").alias(n), F.col("root").alias(f"r{n}")) for n in "ab")
    pairs = x.join(y, "key").where("a < b and ra <> rb").select("a", "b").distinct()
    hot = ws.stash(split.where(F.col("size") > FEW).select("node", "root").distinct(), "hot")
    return pairs if hot.isEmpty() else pairs.union(_sharing(docs, hot, nodes, ws, threshold)).distinct()


def _sharing(docs: DataFrame, hot: DataFrame, nodes: DataFrame, ws: Workspace, threshold: float) -> DataFrame:
    """Pairs (a, b) of the nodes (node, root), of different roots, that share a term of their prefixes."""
    kind = "node bigint, root bigint, size int, term bigint"

    @tidy
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                flat, first = _flat(part.column(2))
                n = np.diff(first)
                of = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(np.repeat(n, n).astype(np.int32)), pa.array(flat.astype(np.int64))], ["node", "root", "size", "term"])

    found = _sets(docs, nodes.join(hot.select("node"), "node", "left_semi")).join(hot, "node").select("node", "root", "shingles")
    all_terms = ws.stash(found.mapInArrow(terms, kind), "terms", compression="zstd")
    common = all_terms.groupBy("term").agg(F.count("*").alias("n")).where("n > 1")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("n", F.lit(1)), "term"))
    kept = all_terms.join(common, "term", "left").withColumn("rank", rank).where((F.col("rank") <= F.col("size") - F.ceil(threshold * F.col("size") - 1e-9) + 1) & F.col("n").isNotNull())
    levels = kept.select("node", "size", "term", F.xxhash64("root").bitwiseAND(0xFFFFFFFF).alias("h"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("level"))
    levels = levels.select("node", "size", "term", "level", F.expr("shiftrightunsigned(h, level + 1)").alias("above"), F.expr("shiftrightunsigned(h, level) & 1").alias("bit"))
    x, y = (levels.where(F.col("bit") == k).select("term", "level", "above", F.col("node").alias(f"n{k}"), F.col("size").alias(f"s{k}")) for k in (0, 1))
    pairs = x.join(y, ["term", "level", "above"]).where(F.least("s0", "s1") >= threshold * F.greatest("s0", "s1") - 1e-9)
    return pairs.select(F.least("n0", "n1").alias("a"), F.greatest("n0", "n1").alias("b")).distinct()


def _members(docs: DataFrame, threshold: float = 0.5, tables: int = 11, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, root, group_id, n_docs) of each document that has duplicates."""
    ws = Workspace(docs.sparkSession, "neardup")
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    drawn = ws.stash(sketch(docs.withColumn("text_hash", F.xxhash64("text")), tables, width), "sketch", compression="zstd")
    nodes = drawn.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("tuples").alias("tuples"))
    hub = F.first("node").over(Window.partitionBy("key").orderBy("node").rowsBetween(Window.unboundedPreceding, 0))
    met = ws.stash(buckets(nodes, tables).withColumn("hub", hub).where("node <> hub"), "met", compression="zstd")
    first = ws.stash(met.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "edges-1")
    nodes = ws.stash(nodes.select("node", "doc_id"), "nodes")
    good = verify(docs, first, nodes, ws, "1", threshold)
    roots = components(good, ws, "1")

    def rooted(df: DataFrame, node: str, root: str) -> DataFrame:
        own = roots.select(F.col("node").alias(node), F.col("root").alias(root))
        return df.join(own, node, "left").withColumn(root, F.coalesce(root, node))

    # what failed and lies in two components still
    apart = ws.stash(rooted(rooted(first.join(good, ["a", "b"], "left_anti"), "a", "ra"), "b", "rb").where("ra <> rb").select(F.col("a").alias("hub"), F.col("b").alias("node")), "apart")
    keys = met.join(small(apart), ["hub", "node"], "left_semi").select("key").distinct()
    there = met.join(keys, "key", "left_semi").select("key", F.explode(F.array("hub", "node")).alias("node")).distinct()
    split = ws.stash(rooted(there.join(there.groupBy("key").agg(F.count("*").alias("size")), "key"), "node", "root"), "split")
    second = ws.stash(across(docs, split, nodes, ws, threshold).join(first, ["a", "b"], "left_anti"), "edges-2")
    if not second.isEmpty():
        more = verify(docs, second, nodes, ws, "2", threshold)
        if not more.isEmpty():
            roots = components(good.union(more), ws, "2")

    member = rooted(drawn.select("doc_id", "text_hash", "node"), "node", "root")
    group = member.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n_docs")).where("n_docs > 1")
    return member.join(group, "root").select("doc_id", "text_hash", "root", "group_id", "n_docs")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """A row for each document that has duplicates: its group, named by the id that stays, the group's size, and whether it is the one that stays."""
    return _members(docs, **options).select("doc_id", "group_id", "n_docs", F.col("doc_id").eqNullSafe(F.col("group_id")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs without all but one document of each group."""
    ws = Workspace(docs.sparkSession, "dedup")
    found = ws.stash(_members(docs, **options), "groups")
    ours = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    marked = found.withColumn("stays", ours == F.min(ours).over(Window.partitionBy("root")))
    marked = ws.stash(marked.groupBy("doc_id", "text_hash").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("n")), "marked")

    def of(rows: DataFrame):
        rows = small(rows.select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash")))
        return rows, docs["doc_id"].eqNullSafe(rows["found_id"]) & (F.xxhash64(docs["text"].cast("string")) == rows["found_hash"])

    kept = docs.join(*of(marked.where("not stays")), "left_anti")
    # one of the rows that repeat in id and text stays
    again = marked.where("stays and n > 1")
    if again.isEmpty():
        return kept
    again, is_again = of(again)
    return kept.join(again, is_again, "left_anti").unionByName(kept.join(again, is_again, "left_semi").dropDuplicates(["doc_id", "text"]))

"""Information-theoretic sanitisation of personal data.

Protected entities are found by pattern and always replaced by the name of their kind. A term can give an entity
away as well: let a token of the corpus be *near* an entity if it stands within ``window`` tokens of one of
its mentions. Over all tokens, an entity's information content is IC(e) = -log2 P(near e), and what
a term t tells of it is PMI(e; t) = log2(P(near e | t) / P(near e)), at most IC(e), when t stands nowhere else. A term with PMI >= ``generalise``
x IC is generalised (a number to ``[NUMBER]``, any other term to ``[TERM]``), and one with PMI >= ``remove``
x IC is removed, wherever it stands in a document that mentions the entity. Tokens that are part of a mention
aren't occurrences of a term. An estimate from ``support`` distinct contexts in which t is near e is taken as it is. One from fewer is
taken at the lower end of its confidence interval (Wilson's, ``doubt`` standard deviations down), with equal contexts counted once: a term that stands nowhere but in
k contexts of e is believed to do so with probability k / (k + 1), for a doubt of 1. So entities named once are judged as well, and copies of one passage count as one. Counts are over all documents.

Python's patterns only read the texts that a relaxed form of them, compiled by RE2 (``screen``), lets through: every text with a match, and few more.
Only mentions, their neighbours and counts are shuffled, and the texts of those documents that mention anything.

Defined results: a null text stays null, an empty one empty. A text without a mention is returned as it was, byte for byte. Repeated rows
are sanitised alike. Null ids don't matter. Of mentions that begin at one place the first kind counts; terms of equal scores are treated alike. ``n_chars``, if there is one, counts the new text; all other columns stay as they are,
but for those named like a column of the report, which takes their place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from textmill.llm.common import Workspace, mix, release, strings, tidy, tokens_in, unused

#: Kinds of entities and their patterns; the first that matches at a place wins. All ignore case. None is limited in length where what it finds isn't,
#: and those that aren't begin where a run of their characters begins and never give one back, so that a long run is read once.
PATTERNS = {
    "SECRET": r"\b(?:(?:access[_-]?|auth[_-]?)?token|api[_-]?key|secret(?:[_-]?key)?|password|passwd|pwd)\b\s*+[=:]\s*+[\"']?[^\s\"']{6,}+[\"']?|\bakia[0-9a-z]{16}\b|\bsk-[0-9a-z_-]{20,}+|\bgh[pousr]_[0-9a-z]{30,}+|(?<![0-9a-z])[0-9a-f]{32,}+(?![0-9a-z])",
    "EMAIL": r"(?<![^\s@<>()\[\]\"',;:|=])[^\s@<>()\[\]\"',;:|=]++@[a-z0-9-]++(?:\.[a-z0-9-]++)++",
    "IP": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d])|(?<![\w:.])(?=[0-9a-f:]*\d)(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,5})?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,5})?)(?![\w:])",
    "PHONE": r"(?<![\w+])\+\d(?:[ .()/-]{0,2}\d){7,14}(?!\d)|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "SSN": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    # the third group of a number is digits and the second has some, or words of four letters would do
    "IBAN": r"\b[a-z]{2}\d{2} ?[a-z0-9]{4} ?(?=[a-z]{0,3}\d)[a-z0-9]{4} ?\d{4}(?: ?[a-z0-9]{4}){0,4}(?: ?[a-z0-9]{1,3})?\b(?<=\d)",
    "ACCOUNT": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
}
_WORD = re.compile(r"[　-\udfff]|(?:[0-9A-Za-z]|[^\x00-\x7f　-\udfff])+")


_LOOK_AROUND = re.compile(r"\(\?<?[=!](?:\[(?:\\.|[^\]\\])*\]|\\.|[^()\\\[])*\)")
_SPACE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def relaxed(pattern: str) -> str:
    """A pattern of RE2, which runs in time linear in the text, that matches wherever the given one does, and more: without what it asks of the characters around, and giving back what it took."""
    pattern = re.sub(r"([+*?}])\+", r"\1", _LOOK_AROUND.sub("", pattern).replace(r"\b", ""))
    out, i, within = [], 0, ""
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[0] == "\\":
            # digits and spaces beyond ASCII; a class of all but ASCII spaces holds more than one of all but spaces
            out.append(r"\p{Nd}" if two == r"\d" else two if two != r"\s" or within == "[^" else _SPACE if within else f"[{_SPACE}]")
            i += 2
            continue
        if two[0] == "[" and not within:
            within = "[^" if two == "[^" else "["
        elif two[0] == "]":
            within = ""
        out.append(two[0])
        i += 1
    return "".join(out)


def screen(patterns: dict[str, str]) -> Callable[[pa.Array], pa.Array]:
    """A quick test of a column: true for every text in which a pattern matches, and for few others; null texts are false."""
    either = "|".join(f"(?:{relaxed(p)})" for p in patterns.values())
    try:
        pc.match_substring_regex(pa.array([""], pa.large_string()), either, ignore_case=True)
    except pa.ArrowInvalid:  # not a pattern of RE2: all texts are looked at
        return lambda column: pc.is_valid(column)

    def test(column: pa.Array) -> pa.Array:
        for dotted in "İı":  # these agree with i in Python's patterns, not in RE2's
            if pc.any(pc.match_substring(column, dotted)).as_py():
                column = pc.replace_substring(column, dotted, "i")
        return pc.fill_null(pc.match_substring_regex(column, either, ignore_case=True), False)

    return test


def finder(patterns: dict[str, str]) -> re.Pattern:
    return re.compile("|".join(f"(?P<{k}>{p})" for k, p in patterns.items()), re.IGNORECASE)


def mentions(docs: DataFrame, patterns: dict[str, str], window: int) -> DataFrame:
    """For each mention and each term near it: (uid of the row, entity, term, the term's hash, the context's hash); term is null once for each mention, with the number of tokens near it as ``n``; with a term, n is 0 if that token was near the entity already; entity is null for the tokens of mentions themselves."""
    look, worth = finder(patterns), screen(patterns)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("uid", pa.int64()), ("entity", pa.string()), ("term", pa.string()), ("hash", pa.int64()), ("context", pa.int64()), ("n", pa.int32())])
        for b in batches:
            b = b.filter(worth(b.column(1)))
            uids = b.column(0).to_pylist()
            for lo, hi, t in tokens_in(b.column(1)):
                rows = []
                cut = np.concatenate([t.first[:-1], [len(t.hash)]])
                offsets = None
                for r, text in enumerate(strings(b.column(1)).slice(lo, hi - lo).to_pylist()):
                    low = text.lower()
                    found = [(m.lastgroup, m.group(), m.start(), m.end()) for m in look.finditer(low)]
                    if not found:
                        continue
                    if offsets is None:
                        lowered = strings(pc.utf8_lower(strings(b.column(1)).slice(lo, hi - lo)))
                        offsets = np.frombuffer(lowered.buffers()[1], np.int64)[lowered.offset : lowered.offset + len(lowered) + 1]
                    base, first, last = offsets[r] - offsets[0], cut[r], cut[r + 1]
                    spans = [(base + len(low[:s].encode("utf-8", "replace")), base + len(low[:e].encode("utf-8", "replace"))) for _, _, s, e in found]
                    inside = np.zeros(last - first, bool)
                    for s, e in spans:
                        inside[max(0, np.searchsorted(t.end[first:last], s, "right")) : np.searchsorted(t.start[first:last], e, "left")] = True
                    free = first + np.flatnonzero(~inside)
                    rows += [(uids[lo + r], None, None, h, 0, 1) for h in t.hash[first:last][inside].view(np.int64).tolist()]
                    met = set()
                    for (k, value, _, _), (s, e) in zip(found, spans):
                        before = free[: np.searchsorted(t.start[free], s)][-window:]
                        after = free[np.searchsorted(t.start[free], e) :][:window]
                        near = np.concatenate([before, after]).astype(np.int64)
                        context = int((mix(t.hash[near] + np.arange(len(near), dtype=np.uint64)).sum(dtype=np.uint64) >> np.uint64(1)).astype(np.int64)) if len(near) else 0
                        rows.append((uids[lo + r], f"{k}:{value}", None, 0, context, len(near)))
                        rows += [(uids[lo + r], f"{k}:{value}", t.word(i), int(t.hash[i].view(np.int64)), context, int((k, value, i) not in met)) for i in near.tolist()]
                        met.update((k, value, i) for i in near.tolist())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    return docs.mapInArrow(run, "uid bigint, entity string, term string, hash bigint, context bigint, n int")


#: Terms up to which a count over the corpus looks for just these; of more, all terms are counted and joined.
WATCHED_TERMS = 1_000_000
#: Distinct terms that a task counts before it passes them on.
HELD_TERMS = 1 << 20


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Values and their counts, of several such pairs."""
    values, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    return values, np.bincount(at, np.concatenate([n for _, n in parts]), len(values)).astype(np.int64)


def occurrences(docs: DataFrame, terms: DataFrame, watched: int = WATCHED_TERMS) -> DataFrame:
    """(hash, total) of each wanted term over all documents, and the number of all tokens under a null hash."""
    few = terms.limit(watched + 1).count() <= watched
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in terms.toLocalIterator()], np.int64))) if few else None

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, []
        sums = np.zeros(len(wanted.value), np.int64) if wanted else None
        for b in batches:
            for _, _, t in tokens_in(b.column(0)):
                n += len(t.hash)
                h = t.hash.view(np.int64)
                if wanted is None:
                    held.append(np.unique(h, return_counts=True))
                    if len(held) > 64:
                        held = [merged(held)]
                        if len(held[0][0]) > HELD_TERMS:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["hash", "total"])
                elif len(sums):
                    at = np.minimum(np.searchsorted(wanted.value, h), len(sums) - 1)
                    sums += np.bincount(at[wanted.value[at] == h], minlength=len(sums))
        if wanted and len(sums):
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(wanted.value[some]), pa.array(sums[some])], ["hash", "total"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(held)], ["hash", "total"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n], pa.int64())], ["hash", "total"])

    found = docs.select("text").mapInArrow(run, "hash bigint, total bigint").groupBy("hash").agg(F.sum("total").alias("total"))
    return found if few else found.join(terms, "hash", "left_semi").union(found.where("hash is null"))


def lowest(k, n, doubt: float):
    """The lower end of Wilson's interval for a probability of which k of n cases were seen."""
    z = doubt * doubt
    return (k + z / 2 - doubt * F.sqrt(k * (n - k) / n + z / 4)) / (n + z)


def disclosures(docs: DataFrame, found: DataFrame, ws: Workspace, generalise: float, remove: float, support: int, doubt: float = 1.645) -> DataFrame:
    """(entity, term, action, near_only) for each term that gives an entity away; near_only: of fewer contexts than ``support``, and nowhere but near the entity."""
    near = found.where("term is null and entity is not null").groupBy("entity").agg(F.sum("n").alias("n_entity"))
    pairs = found.where("term is not null").groupBy("entity", "term", "hash").agg(F.count("*").alias("n_pair"), F.sum("n").alias("n_near"), F.countDistinct("context").alias("contexts"))
    pairs = ws.stash(pairs, "pairs", compression="zstd")
    counts = ws.stash(occurrences(docs, pairs.select("hash").distinct()), "counts")
    total = counts.where("hash is null").agg(F.sum("total")).first()[0] or 1
    inside = found.where("entity is null").groupBy("hash").agg(F.sum("n").alias("inside"))
    counts = counts.join(inside, "hash", "left").withColumn("total", F.col("total") - F.coalesce("inside", F.lit(0)))
    share = pairs.join(near, "entity").join(counts, "hash").withColumn("p", F.least(F.lit(1.0), F.col("n_entity") / F.lit(total)))
    few, away = F.col("contexts") < support, F.greatest(F.col("total") - F.col("n_near"), F.lit(0))
    part = F.when(few, lowest(F.col("contexts"), F.col("contexts") + away, doubt)).otherwise(F.least(F.lit(1.0), F.col("n_pair") / F.col("total")))
    ic, pmi = -F.log2("p"), F.log2(part / F.col("p"))
    share = share.withColumns({"ic": ic, "pmi": pmi}).where((F.col("ic") > 0) & (F.col("pmi") >= generalise * F.col("ic")))
    return share.select("entity", "term", F.when(F.col("pmi") >= remove * F.col("ic"), F.lit("remove")).otherwise(F.lit("generalise")).alias("action"), (few & (away == 0)).alias("near_only"))


def rewrite(text: str, look: re.Pattern, actions: dict[str, str]) -> tuple[str, int, int, int]:
    """The sanitised text; how many entities were replaced, and terms generalised and removed."""
    counts = [0, 0, 0]

    def term(m: re.Match) -> str:
        action = actions.get(m.group().lower())
        if action is None:
            return m.group()
        counts[1 + (action == "remove")] += 1
        return "" if action == "remove" else "[NUMBER]" if m.group().isdigit() else "[TERM]"

    out, last = [], 0
    for m in look.finditer(text):
        part = text[last : m.start()]
        out += [_WORD.sub(term, part) if actions else part, f"[{m.lastgroup}]"]
        counts[0] += 1
        last = m.end()
    if not counts[0]:
        return text, 0, 0, 0
    out.append(_WORD.sub(term, text[last:]) if actions else text[last:])
    return "".join(out), *counts


_RESULT = StructType([StructField("text", StringType()), StructField("entities", IntegerType()), StructField("generalised", IntegerType()), StructField("removed", IntegerType())])


def sanitise(docs: DataFrame, patterns: dict[str, str] | None = None, window: int = 8, generalise: float = 0.9, remove: float = 0.97, support: int = 3, doubt: float = 1.645, report: bool = True) -> DataFrame:
    """All documents with sanitised texts; with ``report``, also how many entities were replaced and terms generalised and removed."""
    patterns = patterns or PATTERNS
    worth = screen(patterns)

    @F.arrow_udf(BooleanType())
    def screened(text: pa.Array) -> pa.Array:
        out = worth(text)
        release()
        return out

    maybe = screened(F.col("text").cast("string"))
    uid = F.xxhash64("doc_id", "text")
    ws = Workspace(docs.sparkSession, "pii")
    found = ws.stash(mentions(docs.select(uid.alias("uid"), F.col("text").cast("string")), patterns, window), "mentions", compression="zstd")
    bad = ws.stash(disclosures(docs.select("text"), found, ws, generalise, remove, support, doubt), "disclosures", compression="zstd")
    # terms that stand nowhere but near the entity are joined where they stand; a join of all texts of an entity with all its terms would grow with their product
    everywhere = found.where("entity is not null").select("uid", "entity").distinct().join(bad.where("not near_only").drop("near_only"), "entity", "left")
    there = found.where("entity is not null and term is not null").select("uid", "entity", "term").join(bad.where("near_only").drop("near_only"), ["entity", "term"])
    # a term that one entity wants removed and another generalised is removed
    worst = everywhere.select("uid", "term", "action").union(there.select("uid", "term", "action")).groupBy("uid", "term").agg(F.max("action").alias("action"))
    by_row = ws.stash(worst.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "action")))).alias("actions")), "actions")
    look = finder(patterns)

    @F.pandas_udf(_RESULT)
    def cleaned(text, actions):
        import pandas as pd

        out = pd.DataFrame([rewrite(t, look, dict(a) if a is not None else {}) for t, a in zip(text, actions)], columns=["text", "entities", "generalised", "removed"])
        release()
        return out

    counts = ["entities", "generalised", "removed"] if report else []
    names = [c for c in docs.columns if c.lower() not in counts]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    uids, actions, fresh = (unused(docs, x) for x in ("uid", "actions", "new"))
    # an exchange between the two functions, or each task would keep two workers
    marked = docs.where(maybe).withColumn(uids, uid).hint("rebalance").join(by_row.select(F.col("uid").alias(uids), F.col("actions").alias(actions)), uids, "left").withColumn(fresh, cleaned("text", actions))
    new = {"text": F.col(f"{fresh}.text")} | ({"n_chars": F.when(F.col(f"{fresh}.entities") > 0, F.char_length(f"{fresh}.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in names else {})
    changed = marked.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in names], *[F.col(f"{fresh}.{c}") for c in counts])
    return docs.where(~maybe).select("*", *[F.lit(0).alias(c) for c in counts]).union(changed)

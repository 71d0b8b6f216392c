"""Quality by n-gram perplexity, under a modified Kneser-Ney model of each language's characters.

Texts are read as symbols: lower-case characters, every digit as 0, every run of white space as one space, with spaces
before the first. Spark counts the runs of ``ORDER`` symbols over all documents of each language and fold, and from them, by joins, all of the model; nothing of it passes through the driver. The counts of
shorter runs are continuation counts, each run counting once for every symbol that it follows. Discounts for
counts of one, two, and three or more come from the counts of counts. A document is of one of two folds, by its text, and is scored by the model
of the other one, so that neither it nor its copies vouch for it. The model is a table; a worker reads the part that it needs into a sorted array of 64-bit hashes for each length
with the interpolated probabilities, and one with the weights that a context gives to the shorter one.
That part is of some languages, of ``ROUND_RUNS`` runs in all, and only their documents are scored with it; then those of the next. The model of a language that has more is
read in slices by the symbol before the last one, which all runs that end with a symbol have in common: each pass scores the symbols of its slice, and the passes add up to
the same result. Runs that occur fewer than ``least`` times (1: none) can be left out.

A language's band is the median of its documents' log-perplexities, less ``below`` and plus ``above`` times their median deviation
from it (times 1.4826, the ratio of standard to median deviation of a normal distribution). What lies outside is rejected.
A mean over few symbols varies more, so for n symbols, n under ``typical``, both bounds are sqrt(typical / n) times as far off.

Defined results: texts of fewer than ``shortest`` symbols (null and empty ones have none) say too little to be judged; they are kept, with their perplexity,
which is null if there are no symbols. Documents of null language have a model and band of their own. Where the other fold has no text of the language, all symbols are equally probable. Repeated rows get
a result each. Ids may be null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import Workspace, filesystem, mix, pieces, strings

ORDER = 5
_BITS = 12
_MASK = np.uint64((1 << _BITS) - 1)
PIECE = 1 << 20
#: Runs of the languages that are scored together.
ROUND_RUNS = 20_000_000


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all rows, as numbers of 12 bits, and where each row's begin; white space at either end of a text is none."""
    joined = "\x00".join(column.to_pylist()).lower() if len(column) else ""
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    end = c == 0
    if int(end.sum()) != len(column) - 1:  # texts with zeros in them
        c = np.frombuffer("\x00".join(t.replace("\x00", " ") for t in column.to_pylist()).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        end = c == 0
    space = ((c >= 9) & (c <= 13)) | (c == 32) | (c == 0x85) | (c == 0xA0) | ((c >= 0x2000) & (c <= 0x200B)) | (c == 0x3000)
    c = np.where((c >= 48) & (c <= 57), 48, np.where(space, 32, c))
    c = np.where(c < 2048, c, 2048 + (c * np.uint32(0x9E3779B1) >> np.uint32(21))).astype(np.uint16)
    before = np.concatenate([[True], space[:-1] | end[:-1]])
    after = np.concatenate([end[1:], [True]])
    keep = ~end & ~(space & (before | after))
    row = np.cumsum(end)[keep] if len(c) else np.zeros(0, np.int64)
    c = c[keep]
    # a space that is left before the end of a row
    last = np.concatenate([row[1:] != row[:-1], [True]]) if len(row) else np.zeros(0, bool)
    drop = last & (c == 32)
    c, row = c[~drop], row[~drop]
    return c, np.searchsorted(row, np.arange(len(column) + 1))


def grams(c: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each symbol, the run of ORDER symbols that ends with it, those before the row being spaces."""
    n = np.diff(first)
    own = np.repeat(np.arange(len(n)) * ORDER + ORDER - 1, n)
    at = np.arange(len(c)) + own - np.repeat(np.arange(len(n)), n)
    wide = np.full(len(c) + len(n) * (ORDER - 1), 32, np.uint64)
    wide[at] = c
    out = np.zeros(len(c), np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(_BITS)) | wide[at - (ORDER - 1 - k)]
    return out


def key(g: np.ndarray, lang: int | np.ndarray, order: int) -> np.ndarray:
    """The hash of a run in a language."""
    return mix(g * np.uint64(2 * ORDER + 1) + np.uint64(order) + np.asarray(lang, np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fold() -> Column:
    """Documents are of one of two folds, by text, and each is scored by the model of the other."""
    return F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")


RUNS = "lang string, fold int, run bigint, n bigint"


def count_runs(docs: DataFrame) -> DataFrame:
    """(lang, fold, run, n) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}

        def add(of: tuple[str, int], values: np.ndarray, times: np.ndarray) -> None:
            parts = kept.setdefault(of, [])
            parts.append((values, times))
            if len(parts) > 8:
                v, i = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                kept[of] = [(v, np.bincount(i, np.concatenate([p[1] for p in parts]), len(v)).astype(np.int64))]

        for b in batches:
            names, texts = list(zip(b.column(0).to_pylist(), b.column(2).to_pylist())), strings(b.column(1))
            for lo, hi in pieces(texts, PIECE):
                c, first = symbols(texts.slice(lo, hi - lo))
                g, n = grams(c, first), np.diff(first)
                found, inverse = np.unique(np.array([f"{f}{x}" for x, f in names[lo:hi]], object), return_inverse=True)
                of = np.repeat(inverse, n)
                for k, name in enumerate(found):
                    add((name[1:], int(name[0])), *np.unique(g[of == k], return_counts=True))
        for (lang, half), parts in kept.items():
            for v, n in parts:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v), pa.string()), pa.array(np.full(len(v), half, np.int32)), pa.array(v.view(np.int64)), pa.array(n)], ["lang", "fold", "run", "n"])

    return docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.col("text").cast("string"), fold().alias("fold")).mapInArrow(run, RUNS).groupBy("lang", "fold", "run").agg(F.sum("n").alias("n"))


def discounts(level: DataFrame) -> DataFrame:
    """By language and fold, what counts of 1, 2, and 3 or more lose; 0.5, 1, 1.5 where the counts of counts give no estimate."""
    n = level.groupBy("lang", "fold").agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.expr("n1 / (n1 + 2 * n2)")
    known = F.expr("n1 > 0 and n2 > 0 and n3 > 0 and n4 > 0")

    def of(k: int) -> Column:
        d = F.when(known, k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")).otherwise(F.lit(k / 2))
        return F.least(F.lit(float(k)), F.greatest(F.lit(0.05 * k), d)).alias(f"d{k}")

    return n.select("lang", "fold", *[of(k) for k in (1, 2, 3)])


def fit(counted: DataFrame, ws: Workspace) -> DataFrame:
    """The model, a table (lang, fold, size, back, run, value, at): ``back`` false, of the runs of ``size`` symbols, the interpolated probabilities; true, of what stands before the last of ``size`` symbols, the weights given to the shorter run; ``at`` is the symbol before the last."""
    of, model, shorter = ["lang", "fold"], None, None
    levels = {ORDER: counted}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = ws.stash(levels[k + 1].groupBy(*of, F.col("run").bitwiseAND((1 << (_BITS * k)) - 1).alias("run")).agg(F.count("*").alias("n")), f"level-{k}", compression="zstd")
    uniform = levels[1].groupBy(*of).agg((1.0 / (F.count("*") + 1)).alias("below"))
    for k in range(1, ORDER + 1):
        lost = F.when(F.col("n") >= 3, F.col("d3")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d1"))
        runs = levels[k].join(F.broadcast(discounts(levels[k])), of).select(*of, "run", "n", lost.alias("lost"), F.shiftright("run", _BITS).alias("context"))
        contexts = ws.stash(runs.groupBy(*of, "context").agg(F.sum("n").alias("total"), (F.sum("lost") / F.sum("n")).alias("weight")), f"contexts-{k}", compression="zstd")
        runs = runs.join(contexts, [*of, "context"])
        # two rows a language, or the level below
        runs = runs.join(F.broadcast(uniform), of) if shorter is None else runs.withColumn("end", F.col("run").bitwiseAND((1 << (_BITS * (k - 1))) - 1)).join(shorter, [*of, "end"])
        p = ws.stash(runs.select(*of, "run", ((F.col("n") - F.col("lost")) / F.col("total") + F.col("weight") * F.col("below")).alias("p")), f"p-{k}", compression="zstd")
        shorter = p.select(*of, F.col("run").alias("end"), F.col("p").alias("below"))
        own = p.select(*of, F.lit(k).alias("size"), F.lit(False).alias("back"), "run", F.col("p").cast("float").alias("value"))
        own = own.union(contexts.select(*of, F.lit(k), F.lit(True), "context", F.col("weight").cast("float")))
        model = own if model is None else model.union(own)
    return ws.stash(model.withColumn("at", before_last(F.col("run"), F.col("size"), F.col("back"))), "model", compression="zstd")


def before_last(run: Column, size: Column, back: Column) -> Column:
    """The symbol before the one that a row of the model is about; null where there is none."""
    return F.when(back & (size > 1), run).when(~back & (size > 1), F.shiftright(run, _BITS)).bitwiseAND((1 << _BITS) - 1)


class KneserNey:
    """Sorted arrays of hashes: of runs of each length, with probabilities, and of contexts, with weights. ``langs`` are (language, fold)."""

    def __init__(self, langs: list[tuple[str, int]], batches: Iterable[pa.RecordBatch]):
        self.langs = langs
        number = {x: k for k, x in enumerate(langs)}
        self.runs, self.weights, self.uniform = {}, {}, np.full(len(langs) + 1, 1 / (1 << _BITS))
        into, seen = {False: self.runs, True: self.weights}, np.zeros(len(langs), np.int64)
        parts: dict = {(back, k): ([], []) for back in into for k in range(1, ORDER + 1)}
        for b in batches:  # only hashes and values stay
            lang, fold = b["lang"].dictionary_encode(), b["fold"].to_numpy()
            names = lang.dictionary.to_pylist()
            code = np.array([[number.get((x, f), -1) for f in (0, 1)] for x in names], np.int64).reshape(-1, 2)[lang.indices.to_numpy(), fold]
            kind = b["size"].to_numpy().astype(np.int64) * 2 + b["back"].to_numpy(zero_copy_only=False)
            run, value = b["run"].to_numpy().view(np.uint64), b["value"].to_numpy()
            for x in np.unique(kind).tolist():
                k, back = x // 2, bool(x % 2)
                at = np.flatnonzero((kind == x) & (code >= 0))
                if k == 1 and not back:
                    seen += np.bincount(code[at], minlength=len(langs))
                parts[back, k][0].append(key(run[at], code[at], ORDER + k if back else k))
                parts[back, k][1].append(value[at].astype(np.float32))
        self.uniform[:-1][seen > 0] = 1.0 / (seen[seen > 0] + 1)
        for (back, k), x in parts.items():
            into[back][k] = self._sorted(x)
            x[0].clear()
            x[1].clear()

    @staticmethod
    def _sorted(x: tuple[list, list]) -> tuple[np.ndarray, np.ndarray]:
        h, v = np.concatenate([*x[0], np.zeros(0, np.uint64)]), np.concatenate([*x[1], np.zeros(0, np.float32)])
        order = np.argsort(h)
        return h[order], v[order]

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], h: np.ndarray, default: float) -> np.ndarray:
        if not len(table[0]):
            return np.full(len(h), default, np.float32)
        at = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
        return np.where(table[0][at] == h, table[1][at], np.float32(default))

    def log_p(self, run: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """The log-probability of the last symbol of each run after the others."""
        out = np.zeros(len(run))
        left, weight = np.arange(len(run)), np.ones(len(run))
        for k in range(ORDER, 0, -1):
            g, own = run[left] & np.uint64((1 << (_BITS * k)) - 1), lang[left]
            p = self._find(self.runs[k], key(g, own, k), -1.0)
            seen = p >= 0
            out[left[seen]] = np.log(weight[seen] * p[seen])
            # an unseen run: the context's weight, or 1 where the context is unseen as well
            w = self._find(self.weights[k], key(g >> np.uint64(_BITS), own, ORDER + k), 1.0)
            left, weight = left[~seen], (weight * w)[~seen]
        out[left] = np.log(weight * self.uniform[lang[left]])
        return out


#: The model that a worker has read last, by its folder and the part of it.
_READ: dict = {}


def read_model(uri: str, part: tuple) -> KneserNey:
    """A part (languages with folds, slices, the slice) of the model in a folder, from its files, once for each worker."""
    if (uri, part) not in _READ:
        import pyarrow.dataset as ds

        _READ.clear()
        langs, slices, slice_ = part
        fs, path = filesystem(uri)
        names = sorted({x for x, _ in langs})
        wanted = pc.field("lang").isin(names)
        if slices > 1:
            wanted &= pc.field("at").is_null() | pc.field("at").isin([x for x in range(1 << _BITS) if x % slices == slice_])
        batches = ds.dataset(path, filesystem=fs, format="parquet").to_batches(columns=["lang", "fold", "size", "back", "run", "value"], filter=wanted, batch_size=1 << 16, batch_readahead=1, fragment_readahead=1, use_threads=False)
        _READ[uri, part] = KneserNey(list(langs), batches)
    return _READ[uri, part]


def rounds(counted: DataFrame, most: int) -> list[tuple]:
    """What is scored together: (languages with folds, slices, the slice), of ``most`` runs in all, or of about that in a slice of one language's model."""
    out: list[tuple] = []
    held: list[tuple[str, int]] = []
    n = 0
    for r in counted.groupBy("lang", "fold").count().orderBy("lang", "fold").collect():
        one = (r["lang"], r["fold"])
        if held and n + r["count"] > most:
            out.append((tuple(held), 1, 0))
            held, n = [], 0
        if r["count"] > most:
            slices = -(-r["count"] // most)
            out += [((one,), slices, k) for k in range(slices)]
        else:
            held.append(one)
            n += r["count"]
    return [*out, (tuple(held), 1, 0)] if held else out


def perplexities(docs: DataFrame, uri: str, part: tuple) -> DataFrame:
    """(doc_id, lang, text_hash, n_symbols, total) of every document: the log-probability of those of its symbols that a part of the model is about."""
    kind = "doc_id bigint, lang string, text_hash bigint, n_symbols bigint, total double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = read_model(uri, part)
            number = {x: k for k, x in enumerate(m.langs)}
            texts, langs = strings(b.column(2)), b.column(1)
            codes = np.array([number.get((x or "", 1 - f), len(m.langs)) for x, f in zip(langs.to_pylist(), b.column(3).to_pylist())], np.int64)
            for lo, hi in pieces(texts, PIECE):
                c, first = symbols(texts.slice(lo, hi - lo))
                n = np.diff(first)
                g, own, of = grams(c, first), np.repeat(codes[lo:hi], n), np.repeat(np.arange(hi - lo), n)
                if part[1] > 1:
                    mine = (g >> np.uint64(_BITS) & _MASK) % np.uint64(part[1]) == part[2]
                    g, own, of = g[mine], own[mine], of[mine]
                total = np.zeros(hi - lo)
                # every distinct run of a language is looked up once
                for code in np.unique(codes[lo:hi]):
                    at = own == code
                    distinct, inverse = np.unique(g[at], return_inverse=True)
                    total += np.bincount(of[at], m.log_p(distinct, np.full(len(distinct), code))[inverse], hi - lo)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(lo, hi - lo) for k in (0, 1, 4)), pa.array(n), pa.array(total)], ["doc_id", "lang", "text_hash", "n_symbols", "total"])

    return docs.select(F.col("doc_id").cast("bigint"), "lang", F.col("text").cast("string"), fold().alias("fold"), F.xxhash64("text").alias("text_hash")).mapInArrow(run, kind)


def score(docs: DataFrame, ws: Workspace, least: int = 1, most: int = ROUND_RUNS) -> DataFrame:
    """(doc_id, lang, n_symbols, log_perplexity) of all documents, each under its language's model of the other fold."""
    docs = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    counted = ws.stash(count_runs(docs).where(F.col("n") >= least), "runs", compression="zstd")
    fit(counted, ws)
    parts = rounds(counted, most) or [((), 1, 0)]
    known = [x for langs, _, _ in parts for x in langs]
    lang = F.concat((1 - fold()).cast("string"), F.coalesce("lang", F.lit("")))
    whole = split = None
    for k, part in enumerate(parts):
        own_names = [f"{f}{x}" for x, f in part[0]]
        others = [f"{f}{x}" for x, f in known if (x, f) not in part[0]]
        # documents that no model is about are in a round of their own, or in the first if that is of whole models
        own = docs if not others else docs.where(lang.isin(own_names)) if k or part[1] > 1 else docs.where(~lang.isin(others))
        scored = ws.stash(perplexities(own, f"{ws.path}/model", part), f"scores-{k}")
        if part[1] > 1:
            scored = scored.withColumn("slices", F.lit(part[1]))
            split = scored if split is None else split.union(scored)
        else:
            whole = scored if whole is None else whole.union(scored)
    if parts[0][1] > 1:
        rest = ws.stash(perplexities(docs.where(~lang.isin([f"{f}{x}" for x, f in known])), f"{ws.path}/model", ((), 1, 0)), "scores-rest")
        whole = rest if whole is None else whole.union(rest)
    if split is not None:  # a row's symbols are in several slices, and rows may repeat
        summed = split.groupBy("doc_id", "lang", "text_hash", "n_symbols", "slices").agg(F.sum("total").alias("total"), F.count("*").alias("n"))
        one = summed.withColumn("copies", F.expr("n div slices")).withColumn("total", F.col("total") / F.col("copies")).withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
        whole = whole.union(one.select(*whole.columns)) if whole is not None else one.select("doc_id", "lang", "text_hash", "n_symbols", "total")
    return whole.select("doc_id", "lang", "n_symbols", F.when(F.col("n_symbols") > 0, -F.col("total") / F.col("n_symbols")).alias("log_perplexity"))


def judge(docs: DataFrame, below: float = 5.0, above: float = 8.0, shortest: int = 100, typical: int = 1000, least: int = 1) -> DataFrame:
    """A row for each document: its perplexity, its language's band, and whether it is kept."""
    ws = Workspace(docs.sparkSession, "quality")
    scored = score(docs, ws, least)
    long = scored.where(F.col("n_symbols") >= shortest)
    middle = long.groupBy(F.col("lang").alias("of")).agg(F.percentile_approx("log_perplexity", 0.5, 100_000).alias("middle"))
    off = long.join(middle, F.col("lang").eqNullSafe(F.col("of"))).select("of", "middle", F.abs(F.col("log_perplexity") - F.col("middle")).alias("off"))
    band = off.groupBy("of").agg(F.first("middle").alias("middle"), (F.percentile_approx("off", 0.5, 100_000) * 1.4826).alias("off"))
    band = ws.stash(band, "bands")
    wide = F.greatest(F.lit(1.0), F.sqrt(F.lit(float(typical)) / F.greatest("n_symbols", F.lit(1)))) * F.col("off")
    lower, upper = F.exp(F.col("middle") - below * wide), F.exp(F.col("middle") + above * wide)
    ppl = F.exp("log_perplexity")
    keep = (F.col("n_symbols") < shortest) | ppl.between(lower, upper)
    return scored.join(band, F.col("lang").eqNullSafe(F.col("of")), "left").select("doc_id", "lang", "n_symbols", ppl.alias("perplexity"), lower.alias("lower"), upper.alias("upper"), F.coalesce(keep, F.lit(True)).alias("keep"))

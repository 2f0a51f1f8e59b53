"""Source divergence audit: how far the term frequencies of the sources of a language lie apart.

Terms (``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased) are counted per (language, source), by slices of a few MB in the tasks, then with
map-side combination; a language keeps the terms of at least ``MIN_DOCS`` of its
documents and numbers them densely in (language, term) order. A group's share of a term is an integer,
``1 + floor(UNIT * (count + 1) / (N + V))``, and a term's cost against another share q is ``floor((p - q)**2 / q)``.

Pairs of sources: a group's kept terms become sorted (term id, count) arrays, cut into blocks of ``BLOCK`` ids. Each unordered
pair of sources is a task per block: the two arrays are co-grouped, the smaller one gallops through the larger one, and
overlaps and one-sided terms are priced in both directions at once. Terms that neither group has cost the same everywhere, so they are
priced by their number when the blocks are added up. So a task holds two arrays of at most ``BLOCK`` entries, whatever the size of a
source, and the arrays, not the texts, meet in pairs (as many pairs as the result has rows, halved).

Terms of a group: the shares are compared with the language's own; the leading ``TOP`` are ranked with Spark's partial window limit.

Defined cases: null text, lang and source are empty strings; a group without terms and a language without kept terms
take part (pair values of 0 without any kept term); null and repeated doc_ids are documents of their own; a
language with one source has no pairs; an empty table gives an empty result; other columns are ignored. Totals of a
language stay below 9e15 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfage.llm.common import giving_back, slices, text_buffer, token_bounds
from shelfage.session import scratch_path

MIN_DOCS = 3
UNIT = 1_000_000_000
BLOCK = 1 << 16
TOP = 200
RUN = 64               # terms that gallop together

COUNTED = "lang string, source string, term string, count long, docs long"
PRICED = "lang string, a string, b string, terms long, ab long, ba long"


# ---------------------------------------------------------------- counts
def _letters() -> np.ndarray:
    """Term bytes of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``: ASCII letters and all bytes of other characters."""
    t = np.zeros(256, bool)
    t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    return t


def _slice_counts(piece: pa.RecordBatch) -> pa.RecordBatch:
    """Occurrences and documents of every (lang, source, term) of a slice, by exact terms."""
    letters, lower = _letters(), np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    data, off = text_buffer(piece.column("text"))
    starts, ends, before = token_bounds(data, off, letters)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    raw = lower[data[letters[data]]]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
    lang, source = (piece.column(c).dictionary_encode() for c in ("lang", "source"))
    group = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
    n = max(1, len(words.dictionary))
    # once per document and term, then once per group and term
    seen, times = np.unique(np.repeat(np.arange(piece.num_rows), np.diff(before)) * n + words.indices.to_numpy(), return_counts=True)
    key = group[seen // n] * n + seen % n
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    key, docs = key[first], np.diff(np.append(first, len(key)))
    count = np.add.reduceat(times, first) if len(first) else np.zeros(0, np.int64)
    group, term = key // n, key % n
    size = max(1, len(source.dictionary))
    return pa.RecordBatch.from_arrays(
        [lang.dictionary.take(pa.array(group // size)), source.dictionary.take(pa.array(group % size)),
         words.dictionary.take(pa.array(term)).cast(pa.large_string()).cast(pa.string()), pa.array(count, pa.int64()), pa.array(docs, pa.int64())],
        names=[x.split()[0] for x in COUNTED.split(", ")])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch):
            yield _slice_counts(piece)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): occurrences, and documents that hold the term."""
    return _groups(docs, "text").mapInArrow(giving_back(_count), COUNTED).groupBy("lang", "source", "term") \
        .agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _groups(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), *more)


def kept_terms(spark: SparkSession, counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, id): the terms of enough documents, numbered densely in order of (lang, term)."""
    path = scratch_path(spark, "divergence-terms")
    counts.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs) \
        .repartitionByRange("lang", "term").sortWithinPartitions("lang", "term") \
        .select("lang", "term", "total", F.monotonically_increasing_id().alias("pos")).write.parquet(path)
    terms = spark.read.parquet(path).withColumn("part", F.shiftright("pos", 33))
    # the running sum is over one row per range
    before = terms.groupBy("part").agg(F.count(F.lit(1)).alias("n")) \
        .select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return terms.join(before, "part").select("lang", "term", "total", (F.col("before") + F.col("pos").bitwiseAND((1 << 33) - 1)).alias("id"))


def share(count: str, total: str) -> str:
    """SQL of a term's share: 1 + floor(UNIT * (count + 1) / total), in decimals."""
    return f"CAST(1 + (CAST({UNIT} AS DECIMAL(20,0)) * CAST({count} + 1 AS DECIMAL(18,0))) div CAST({total} AS DECIMAL(20,0)) AS BIGINT)"


def cost(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


# ---------------------------------------------------------------- pair tasks
def shares(count: np.ndarray, total: int) -> np.ndarray:
    """``share`` by long division in steps of 1000, so that no product leaves 64 bits."""
    rest = count + 1
    out = rest // total
    for _ in range(3):
        rest = rest % total * 1000
        out = out * 1000 + rest // total
    return out + 1


def gallop(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Where the sorted ``few`` stand in the sorted ``many``: steps double until they pass a run of them, a binary search ends it."""
    at, low = np.empty(len(few), np.int64), 0
    for i in range(0, len(few), RUN):
        run, step = few[i: i + RUN], RUN
        while low + step < len(many) and many[low + step] < run[-1]:
            step *= 2
        at[i: i + RUN] = low + np.searchsorted(many[low: low + step + 1], run)
        low = int(at[i + len(run) - 1])
    return at


def merge(ids_a: np.ndarray, count_a: np.ndarray, ids_b: np.ndarray, count_b: np.ndarray, total_a: int, total_b: int) -> tuple[int, int, int]:
    """Of the terms that either group has: how many, and their costs of a against b and of b against a."""
    if len(ids_a) > len(ids_b):
        terms, ba, ab = merge(ids_b, count_b, ids_a, count_a, total_b, total_a)
        return terms, ab, ba
    at = gallop(ids_a, ids_b)
    both = np.zeros(len(ids_a), bool)
    both[at < len(ids_b)] = ids_b[at[at < len(ids_b)]] == ids_a[at < len(ids_b)]
    alone = np.ones(len(ids_b), bool)
    alone[at[both]] = False
    none = np.zeros(1, np.int64)
    pa_, pb = shares(count_a, total_a), shares(count_b, total_b)
    none_a, none_b = shares(none, total_a)[0], shares(none, total_b)[0]
    p = np.concatenate([pa_, np.full(int(alone.sum()), none_a)])
    q = np.concatenate([np.where(both, pb[np.minimum(at, max(len(pb) - 1, 0))] if len(pb) else none_b, none_b), pb[alone]])
    square = (p - q) * (p - q)
    return len(p), int((square // q).sum()), int((square // p).sum())


def _price(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    lang, a, b, _ = (k.as_py() for k in key)
    total = [(left.column(c) if left.num_rows else right.column(f"{c}_"))[0].as_py() for c in ("total_a", "total_b")]
    side = [t.column(c)[0].values.to_numpy(zero_copy_only=False) if t.num_rows else np.zeros(0, np.int64)
            for t, own in ((left, ""), (right, "_")) for c in (f"ids{own}", f"counts{own}")]
    return pa.table([[x] for x in (lang, a, b, *merge(*side, *total))], schema=pa.schema(
        [(c, pa.string()) for c in ("lang", "a", "b")] + [(c, pa.int64()) for c in ("terms", "ab", "ba")]))


def pair_values(kept: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, source, item, value) for both directions of every pair of sources of a language.

    ``kept``: lang, source, id, count; ``groups``: lang, source, total (N + V), v (kept terms of the language)."""
    entry = F.struct("id", "count")
    arrays = kept.groupBy("lang", "source", F.expr(f"id div {int(block)}").alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("e")) \
        .select("lang", "source", "block", F.col("e.id").alias("ids"), F.col("e.count").alias("counts"))
    x, y = (groups.select("lang", F.col("source").alias(s), F.col("total").alias(f"total_{s}"), *more) for s, more in (("a", ["v"]), ("b", [])))
    pairs = x.join(y, "lang").where("a < b")
    left, right = (pairs.drop("v").join(arrays.withColumnRenamed("source", s), ["lang", s]) for s in ("a", "b"))
    keys = ["lang", "a", "b", "block"]
    right = right.select(*[F.col(c).alias(f"{c}_") for c in right.columns])   # columns of its own, as both sides come from the same tables
    priced = left.groupBy(*keys).cogroup(right.groupBy(*[f"{c}_" for c in keys])).applyInArrow(_price, PRICED) \
        .groupBy("lang", "a", "b").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("terms", "ab", "ba")])
    none = {s: share("0", f"total_{s}") for s in "ab"}
    every = pairs.join(priced, ["lang", "a", "b"], "left").selectExpr(
        "lang", "a", "b", "v", "coalesce(ab, 0) AS ab", "coalesce(ba, 0) AS ba", "v - coalesce(terms, 0) AS absent",
        f"CASE WHEN v > 0 THEN {none['a']} END AS none_a", f"CASE WHEN v > 0 THEN {none['b']} END AS none_b")
    value = lambda s, p, q: f"CASE WHEN v > 0 THEN CAST({s} + absent * ({cost(p, q)}) AS BIGINT) ELSE 0 END"
    both = f"array(named_struct('source', a, 'item', b, 'value', {value('ab', 'none_a', 'none_b')}), " \
           f"named_struct('source', b, 'item', a, 'value', {value('ba', 'none_b', 'none_a')}))"
    return every.selectExpr("lang", f"inline({both})")


# ---------------------------------------------------------------- audit
def audit(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """Ranked sources (part ``pair``, all) and terms (part ``term``, the first ``top``) of every (lang, source) group."""
    path = scratch_path(spark, "divergence-counts")
    term_counts(docs).write.parquet(path)
    counts = spark.read.parquet(path)
    terms = kept_terms(spark, counts, min_docs)
    path = scratch_path(spark, "divergence-kept")
    counts.select("lang", "source", "term", "count").join(terms, ["lang", "term"]).write.parquet(path)
    kept = spark.read.parquet(path)
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = _groups(docs).distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left") \
        .selectExpr("lang", "source", "coalesce(v, 0) AS v", "coalesce(n, 0) + coalesce(v, 0) AS total", "coalesce(lang_n, 0) + coalesce(v, 0) AS lang_total")
    ranks = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair = pair_values(kept, groups, block).withColumn("rank", F.row_number().over(ranks))
    term = kept.withColumnRenamed("total", "lang_count").join(groups, ["lang", "source"]) \
        .selectExpr("lang", "source", "term AS item", f"{share('count', 'total')} AS p", f"{share('lang_count', 'lang_total')} AS q")
    term = term.where("p > q").selectExpr("lang", "source", "item", f"{cost('p', 'q')} AS value") \
        .withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair.withColumn("part", F.lit("pair")).select(*columns).union(term.withColumn("part", F.lit("term")).select(*columns))

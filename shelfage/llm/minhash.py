"""Near-duplicates by MinHash with tensored banding, verified on full shingle sets.

Two collections of ``HALVES`` half keys, each of ``HASHES`` minhashes, are computed per document; the
key of table (i, j) combines half key i of the first and j of the second collection. So 2 * 12 * 3 = 72 minhashes
give 144 tables of six minhashes each. A pair of similarity 0.8 shares no table with probability
3.6e-4, one of 0.85 with 1e-5.

Documents with equal shingle sets are collapsed first (by a 128-bit digest), so groups of copies of any size are one
row from there on. Keys travel to hash buckets once a file (equal keys of a file are linked to their
first document there), so no bucket holds more than one entry a file of a key. Links are looked for in rounds, so that
a group is never expanded into its pairs: 1. each document with the smallest first document of its keys; 2. with the first
documents of all its keys, as far as they are not connected yet; 3. the documents that still share a key across components are
searched exactly, without a cap, by the prefixes of their sets (``cross_pairs``). Every link is confirmed by 100 * intersection >= 80 * union of the full sets. Components come from
label propagation with pointer jumping; each round is a written table.

Defined cases: null or wordless texts have an empty set and link with nothing; null doc_ids and rows with equal
doc_id are documents of their own; a component's id is its smallest non-null doc_id (null if it has none); empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfage import session
from shelfage.llm import chunks
from shelfage.llm.common import U64, discard, filesystem, giving_back, mix, space_words, text_buffer, token_bounds, word_hashes

_running = threading.local()   # ``paths``: intermediate tables of the thread's running call


def scratch_path(spark: SparkSession, name: str) -> str:
    _running.paths = [*getattr(_running, "paths", []), session.scratch_path(spark, name)]
    return _running.paths[-1]


HALVES = 12
HASHES = 3
SHINGLE = 5
SIMILARITY = 80           # per cent
BUCKET_KEYS = 1_000_000
SIG_ROWS = 8192
ROWS_AT_ONCE = 512        # whole rows of a chunk file held at once

SIGNATURE = "rid long, doc_id long, n long, digest binary, halves binary"
HIT = "key long, rid long, n long, center long, center_n long"
_SIG_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]


def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all texts, sorted within a document, and the number before each document."""
    data, off = text_buffer(column)
    starts, ends, before = token_bounds(data, off, space_words())
    n = len(starts)
    if not n:
        return np.zeros(0, U64), np.zeros(len(before), np.int64)
    words = word_hashes(data, starts, ends, lower=True)
    count = np.diff(before)
    size = np.minimum(shingle, count)                        # a shorter text is one shingle
    doc = np.repeat(np.arange(len(count)), count)
    last = before[1:][doc] - size[doc]
    at = np.flatnonzero(np.arange(n) <= last)
    h = words[at]
    for k in range(1, shingle):
        more = k < size[doc[at]]
        h = np.where(more, mix(h * U64(0x9E3779B97F4A7C15) + words[np.minimum(at + k, n - 1)]), h)
    d = doc[at]
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(len(count) + 1))


def half_keys(h: np.ndarray, edge: np.ndarray, halves: int, hashes: int) -> np.ndarray:
    """The 2 * halves half keys of every document (rows of zeros for empty sets)."""
    out = np.zeros((len(edge) - 1, 2 * halves), U64)
    some = np.flatnonzero(np.diff(edge))
    if len(some):
        first = edge[some]
        seeds = mix(np.arange(1, 4 * halves * hashes + 1, dtype=U64) * U64(0xD6E8FEB86659FD93))
        for half in range(2 * halves):
            key = np.full(len(some), U64(half + 1))
            for k in range(hashes):
                s = 2 * (half * hashes + k)
                least = np.minimum.reduceat((h * (seeds[s] | U64(1)) + seeds[s + 1]) >> U64(20), first)
                key = mix(key * U64(0x9E3779B97F4A7C15) + least)
            out[some, half] = key
    return out


def _signatures(shingle: int, halves: int, hashes: int):
    names = [x.split()[0] for x in SIGNATURE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, path in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                for _, row, piece in chunks.read_slices(path):
                    h, edge = shingle_sets(piece.column(1), shingle)
                    keys = half_keys(h, edge, halves, hashes)
                    raw = h.tobytes()
                    e = (8 * edge).tolist()
                    n = piece.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip((
                            (np.int64(file) << 32) + row + np.arange(n), piece.column(0).cast(pa.int64()), np.diff(edge),
                            [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(e[:-1], e[1:])],
                            [k.tobytes() for k in keys]), _SIG_TYPES)], names=names)
    return run


# ---------------------------------------------------------------- tables
def _tables(path: str, halves: int, buckets: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of a file of signatures, by batches that depend on the file alone: (key, row id, set size), sorted by key and id; key = bucket and rest."""
    fs, p = filesystem(path)
    with fs.open_input_file(p) as f:
        for batch in pq.ParquetFile(f).iter_batches(batch_size=SIG_ROWS, columns=["rid", "n", "halves"]):
            if not batch.num_rows:
                continue
            rid, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            raw = np.frombuffer(b"".join(batch.column(2).to_pylist()), U64).reshape(len(rid), 2 * halves)
            # the tensor: every half key of one collection with every one of the other
            keys = mix(raw[:, :halves, None] * U64(0x9E3779B97F4A7C15) ^ raw[:, None, halves:]).reshape(-1)
            rid, n = np.repeat(rid, halves * halves), np.repeat(n, halves * halves)
            bucket, rest = chunks.bucketed(keys, buckets)
            key = (bucket << 32) + rest.astype(np.int64)
            order = np.lexsort((rid, key))
            yield key[order], rid[order], n[order]


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place of each run of equal keys, the run of each place, and how long the runs are."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return first, np.cumsum(new) - 1, np.diff(np.concatenate([first, [len(key)]]))


def _hits(key: np.ndarray, rid: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """The rows of keys that several documents have, each with the key's first document."""
    first, run, size = _groups(key)
    at = np.flatnonzero(size[run] > 1)
    lead = first[run[at]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[at], rid[at], n[at], rid[lead], n[lead])],
                                      names=[x.split()[0] for x in HIT.split(", ")])


def _local_hits(halves: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(1).to_pylist():
                for table in _tables(path, halves, buckets):
                    yield _hits(*table)
    return run


def _send_keys(halves: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, path in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                for number, (key, rid, n) in enumerate(_tables(path, halves, buckets)):
                    first = _groups(key)[0]
                    key, rid, n = key[first], rid[first], n[first]
                    yield chunks.messages([
                        (file, None, number, bucket, 0, chunks.pack(key[a:b].astype(np.uint32), True), chunks.pack(n[a:b].astype(np.uint32)), chunks.pack(rid[a:b]))
                        for bucket, a, b in chunks.bucket_ranges(key >> 32)])
    return run


def _bucket_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for batch in batches for r in batch.select(["bucket", "data", "more", "ids"]).to_pylist()]
    key =np.concatenate([chunks.unpack(r["data"], "<u4", True) for r in rows]).astype(np.int64) + (rows[0]["bucket"] << 32)
    n = np.concatenate([chunks.unpack(r["more"], "<u4") for r in rows]).astype(np.int64)
    rid = np.concatenate([chunks.unpack(r["ids"], "<i8") for r in rows])
    del rows
    order = np.lexsort((rid, key))
    yield _hits(key[order], rid[order], n[order])


# ---------------------------------------------------------------- verification
def _wanted_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, rows = _wanted(batches)
        for _, row, piece in chunks.read_slices(path):
            mine = rows[np.searchsorted(rows & 0xFFFFFFFF, row): np.searchsorted(rows & 0xFFFFFFFF, row + piece.num_rows)]
            if len(mine):
                h, edge = shingle_sets(piece.column(1).take(pa.array((mine & 0xFFFFFFFF) - row)), shingle)
                # the sets are runs of one buffer, which a batch takes as it is
                raw = pa.Array.from_buffers(pa.large_binary(), len(mine), [None, pa.py_buffer(8 * edge), pa.py_buffer(h)])
                yield pa.RecordBatch.from_arrays([pa.array(mine), raw.cast(pa.binary())], names=["rid", "set"])
    return run


def _wanted(batches: Iterator[pa.RecordBatch]) -> tuple[str, np.ndarray]:
    """Of one file's group: its path and its sorted row ids."""
    rows, path = [], None
    for batch in batches:
        rows.append(batch.column("rid").to_numpy())
        path = path or batch.column("path")[0].as_py()
    return path, np.sort(np.concatenate(rows))


def _confirm(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= similarity * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def full_sets(spark: SparkSession, store: chunks.Store, rids: DataFrame, shingle: int) -> DataFrame:
    """(rid, set) of some documents, made from their files and written."""
    wanted = rids.withColumn("file", F.shiftright("rid", 32).cast("int")).join(store.files, "file")
    path = scratch_path(spark, "minhash-sets")
    wanted.groupBy("file").applyInArrow(giving_back(_wanted_sets(shingle)), "rid long, set binary").write.option("compression", "none").parquet(path)
    return spark.read.parquet(path)


def confirmed(spark: SparkSession, store: chunks.Store, pairs: DataFrame, shingle: int, similarity: int, sets: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) of row ids whose full sets are similar. Sets are made for the documents of the pairs only."""
    path = scratch_path(spark, "minhash-pairs")
    pairs.select("a", "b").write.parquet(path)
    pairs = spark.read.parquet(path)
    if sets is None:
        sets = full_sets(spark, store, pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct(), shingle)
    both = pairs.join(sets.select(F.col("rid").alias("a"), F.col("set").alias("x")), "a") \
        .join(sets.select(F.col("rid").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(giving_back(_confirm(similarity)), "a long, b long")


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rid, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            token = np.frombuffer(raw.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), rid)), pa.array(token)], names=["rid", "token"])


def cross_pairs(spark: SparkSession, sets: DataFrame, member: DataFrame, similarity: int) -> DataFrame:
    """Pairs of documents of different labels that can be similar, by the prefixes of their sets.

    ``member``: rid, n, label. In one order of all shingles, rarest first, similar sets share a shingle among the first
    n - ceil(n * similarity) + 1 of each, and at the first one they share enough places must be left in both (positions
    are part of the join's condition). Shingles that only one document has keep their positions but are
    no join keys. Of each shingle the documents of its most frequent label meet only those of other labels.
    """
    path = scratch_path(spark, "minhash-prefixes")
    tokens = sets.mapInArrow(_shingles, "rid long, token long")
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = Window.partitionBy("rid")
    place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "token"))
    prefix = tokens.join(common, "token").join(member, "rid").withColumn("place", place) \
        .where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * similarity / 100) + 1)
    prefix.select("rid", "n", "label", "token", "place").write.parquet(path)
    prefix = spark.read.parquet(path)
    most = prefix.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("token") \
        .agg(F.max_by("label", "c").alias("most"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("token", "most")
    prefix = prefix.join(most, "token")
    x, y = (prefix.select("token", "most", *[F.col(c).alias(f"{c}{k}") for c in ("rid", "n", "label", "place")]) for k in (1, 2))
    left = F.lit(1) + F.least(F.col("n1") - F.col("place1"), F.col("n2") - F.col("place2"))
    return x.where("label1 <> most").join(y.drop("most"), "token").where(
        (F.col("label1") != F.col("label2")) & ((F.col("label2") == F.col("most")) | (F.col("label1") < F.col("label2")))
        & (100 * F.least("n1", "n2") >= similarity * F.greatest("n1", "n2"))
        & ((100 + similarity) * left >= similarity * (F.col("n1") + F.col("n2")))) \
        .select(F.least("rid1", "rid2").alias("a"), F.greatest("rid1", "rid2").alias("b")).distinct()


# ---------------------------------------------------------------- components
def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(v, label) with the smallest node that each node of the edges (a, b) reaches: neighbours' labels, then the label's label, until nothing changes."""
    path = scratch_path(spark, "minhash-edges")
    edges.select("a", "b").where("a <> b").distinct().write.parquet(path)
    edges = spark.read.parquet(path)
    links = edges.union(edges.select("b", "a"))
    labels = links.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("label")).withColumn("label", F.least("v", "label"))
    while True:
        path = scratch_path(spark, "minhash-labels")
        jump = labels.select(F.col("v").alias("w"), F.col("label").alias("next"))
        hop = labels.join(jump, F.col("label") == F.col("w"), "left").select("v", F.col("label").alias("old"), F.coalesce("next", "label").alias("label"))
        near = links.join(hop.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        hop.join(near, "v").select("v", "old", F.least("label", "near").alias("label")).write.parquet(path)
        labels = spark.read.parquet(path)
        if labels.where("old <> label").isEmpty():
            return labels.select("v", "label")


def _merged(spark: SparkSession, labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after more links, which are first lifted to the labels they connect."""
    if labels is None:
        return components(spark, links)
    a, b = (labels.select(F.col("v").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    lifted = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    top = components(spark, lifted)
    path = scratch_path(spark, "minhash-labels")
    old = labels.join(top.select(F.col("v").alias("label"), F.col("label").alias("new")), "label", "left").select("v", F.coalesce("new", "label").alias("label"))
    old.union(top.join(labels.select("v"), "v", "left_anti").select("v", "label")).write.parquet(path)
    return spark.read.parquet(path)


def link(spark: SparkSession, store: chunks.Store, shingle: int = SHINGLE, similarity: int = SIMILARITY,
         halves: int = HALVES, hashes: int = HASHES, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, DataFrame]:
    """(signatures, labels): one row per document of the store, and the component of every document that has a link."""
    _running.paths = []
    path = kept = scratch_path(spark, "minhash-signatures")
    store.tasks().mapInArrow(giving_back(_signatures(shingle, halves, hashes)), SIGNATURE).write.parquet(path)
    sig = spark.read.parquet(path)
    # equal sets: one representative each
    some = sig.where("n > 0").select("rid", "digest")
    reps = some.groupBy("digest").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("copies"))
    copies = some.join(reps.where("copies > 1").select(F.col("digest").alias("d"), "rep"), F.col("digest") == F.col("d")) \
        .where("rid <> rep").select(F.col("rep").alias("a"), F.col("rid").alias("b"))
    path = scratch_path(spark, "minhash-representatives")
    sig.join(reps.select(F.col("rep").alias("rid")), "rid", "left_semi").select("rid", "n", "halves").write.parquet(path)
    files, count = chunks.files_of(spark, path)
    buckets = spark.read.parquet(path).count() * halves * halves // bucket_keys + 1
    tasks = files.repartition(max(1, count), "file")
    path = scratch_path(spark, "minhash-hits")
    far = tasks.mapInArrow(giving_back(_send_keys(halves, buckets)), chunks.MESSAGE).groupBy("bucket").applyInArrow(giving_back(_bucket_hits), HIT)
    far.union(tasks.mapInArrow(giving_back(_local_hits(halves, buckets)), HIT)).write.parquet(path)
    hits = spark.read.parquet(path)

    long_enough = 100 * F.least("n", "center_n") >= similarity * F.greatest("n", "center_n")
    stars = hits.where((F.col("rid") != F.col("center")) & long_enough)
    # 1. the smallest first document of all keys
    pairs = stars.groupBy(F.col("rid").alias("b")).agg(F.min("center").alias("a"))
    path = scratch_path(spark, "minhash-links")
    confirmed(spark, store, pairs, shingle, similarity).write.parquet(path)
    labels = _merged(spark, None, spark.read.parquet(path))

    # 2. the other first documents, where not connected
    def apart(df: DataFrame, x: str, y: str) -> DataFrame:
        lx, ly = (labels.select(F.col("v").alias(f"v{c}"), F.col("label").alias(f"l{c}")) for c in (x, y))
        df = df.join(lx, F.col(x) == F.col(f"v{x}"), "left").join(ly, F.col(y) == F.col(f"v{y}"), "left")
        return df.where(F.coalesce(f"l{x}", x) != F.coalesce(f"l{y}", y))

    more = apart(stars.select(F.col("center").alias("a"), F.col("rid").alias("b")).distinct(), "a", "b").select("a", "b") \
        .join(pairs, ["a", "b"], "left_anti")
    path = scratch_path(spark, "minhash-links")
    confirmed(spark, store, more, shingle, similarity).write.parquet(path)
    links = spark.read.parquet(path)
    if not links.isEmpty():
        labels = _merged(spark, labels, links)

    # 3. whatever else shares a key across components
    member = hits.select("key", "rid", "n").join(labels.select(F.col("v").alias("rid"), "label"), "rid", "left") \
        .withColumn("label", F.coalesce("label", "rid"))
    mixed = member.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    path = scratch_path(spark, "minhash-mixed")
    member.join(mixed, "key", "left_semi").select("rid", "n", "label").distinct().write.parquet(path)
    member = spark.read.parquet(path)
    sets = full_sets(spark, store, member.select("rid"), shingle)
    rest = cross_pairs(spark, sets, member, similarity)
    path = scratch_path(spark, "minhash-links")
    confirmed(spark, store, rest, shingle, similarity, sets).write.parquet(path)
    links = spark.read.parquet(path)
    labels = _merged(spark, labels, links.union(copies))
    path = session.scratch_path(spark, "minhash-components")
    labels.write.parquet(path)
    discard([p for p in _running.paths if p != kept])
    _running.paths = []
    return sig, spark.read.parquet(path)


def _labelled(spark: SparkSession, store: chunks.Store, **kw) -> DataFrame:
    sig, labels = link(spark, store, **kw)
    whole = sig.select("rid", "doc_id", "n")
    member = whole.join(labels.select(F.col("v").alias("rid"), "label"), "rid", "left")
    least = member.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"), F.min("rid").alias("first"))
    return member.join(least, "label", "left").select(
        "rid", "doc_id", "n", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
        F.when(F.col("label").isNull(), F.col("rid")).otherwise(F.col("first")).alias("first"))


def near_duplicates(spark: SparkSession, docs: DataFrame, **kw) -> DataFrame:
    """Per document: n_shingles, component_id (smallest doc_id reachable) and whether it is the one kept."""
    return _labelled(spark, chunks.Store(spark, docs), **kw).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _rows(schema: pa.Schema, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, rows = _wanted(batches)
        rows = rows & 0xFFFFFFFF
        fs, p = filesystem(path)
        at = 0
        with fs.open_input_file(p) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=ROWS_AT_ONCE):
                mine = rows[np.searchsorted(rows, at): np.searchsorted(rows, at + batch.num_rows)] - at
                at += batch.num_rows
                if len(mine):
                    yield from pa.Table.from_batches([batch]).select(names).take(pa.array(mine)).cast(schema).to_batches()
    return run


def deduplicated(spark: SparkSession, docs: DataFrame, **kw) -> DataFrame:
    """The documents with the smallest doc_id of each component kept (one of several equal rows); columns unchanged.

    The rows are taken from the chunk files by their numbers, no text is shuffled."""
    from pyspark.sql.pandas.types import to_arrow_schema

    store = chunks.Store(spark, docs, columns=tuple(docs.columns))
    every = _labelled(spark, store, **kw)
    # of the rows with the component's doc_id the first one
    group = F.coalesce("first", "rid")
    keep = every.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(group.alias("g")).agg(F.min("rid").alias("rid"))
    keep = keep.select("rid", F.shiftright("rid", 32).cast("int").alias("file")).join(store.files, "file")
    return keep.groupBy("file").applyInArrow(giving_back(_rows(to_arrow_schema(docs.schema), docs.columns)), docs.schema)

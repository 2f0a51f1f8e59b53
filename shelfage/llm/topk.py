"""Exact top-k inner products by aggregation over sorted lists without random access.

Vectors are packed into blocks of rows; each query block meets each candidate block
once (an equi-join on the query block's number, so the work is spread over pairs of blocks). A
candidate block has one list per dimension sorted by value. The lists are read in steps (``DEPTHS``), from the large end
for a query's positive components and from the small end for its negative ones. What was read gives each candidate a
lower bound (unread places count as the list's other end) and an upper bound (unread places count as the value
read last). A candidate whose upper bound is under the query's k-th best lower bound, or under the k-th score of
the blocks before, cannot qualify. A query stops reading a block when at most ``RESOLVE`` of its candidates
can still qualify; their final scores are resolved, the other queries read
on. A query that reads a list to its end has the scores themselves, so the
result is exact whatever the data, as long as the scores stay below 2**53 (float64 sums of integers).
``reading`` tells how many places each query read and how many scores it resolved.

Defined cases: vectors that are null, or hold null or non-finite components, or (for one
query) have another length take no part; a null vec_id is no query and no candidate; rows with the query's vec_id are
its own; repeated rows of another id are candidates of their own, ties in rank go to the smaller vec_id;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 20
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
DEPTHS = (0.02, 0.1, 0.25, 0.5, 0.625, 0.75, 0.875, 1.0)   # parts of a list read after each step
RESOLVE = 0.05             # a query resolves a block when at most this part of its candidates is left
FAR = 0.8                  # part of the pairs left above which a step is read without looking at the bounds
QUERIES_AT_ONCE = 256      # queries whose bounds are held at a time
BLOCKS_PER_TASK = 4        # candidate blocks that one task reads for a query block

PARTIAL = "query_id long, vec_id long, score long"
READS = "query_id long, places long, read long, resolved long"


def _packer(rows: int):
    """Packs (vec_id, vector) rows into blocks of equal dimension, at most ``rows`` each."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int, some: list) -> pa.RecordBatch:
            ids = np.array([i for i, _ in some], dtype="<i8").tobytes()
            vec = np.concatenate([v for _, v in some]) if dim else np.zeros(0, "<i8")
            # 16-bit components where all fit
            vec = vec.astype("<i2") if len(vec) == 0 or np.abs(vec).max() < 1 << 15 else vec.astype("<i8")
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids], pa.binary()),
                                               pa.array([vec.tobytes()], pa.binary())], names=["dim", "ids", "vecs"])

        for batch in batches:
            for vec_id, vec in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = vec.values.to_numpy(zero_copy_only=False)
                some = held.setdefault(len(v), [])
                some.append((vec_id, v))
                if len(some) >= rows:
                    yield block(len(v), held.pop(len(v)))
        for dim, some in held.items():
            if some:
                yield block(dim, some)
    return pack


def _bounds(q: np.ndarray, x: np.ndarray, lists: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of q @ x.T after ``depth`` places of every list (``lists``: columns of x, ascending)."""
    n = len(x)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    high, low = lists[n - depth], lists[depth - 1]           # last values read from either end
    top = np.where(x >= high, x, lists[0])
    bottom = np.where(x <= low, x, lists[-1])
    lower = plus @ top.T + minus @ bottom.T
    # an unread value lies beyond the last one read
    upper = plus @ np.where(x >= high, x, high).T + minus @ np.where(x <= low, x, low).T
    return lower, upper


def block_topk(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, floor: np.ndarray, k: int,
               start: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of all pairs that can be among a query's k best, and the step each query stopped at.

    ``floor``: known k-th scores; ``start``: the first step whose bounds are looked at.
    """
    lists = np.sort(x, axis=0)
    n = len(x)
    stopped = np.zeros(len(q), np.int64)
    pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at in range(0, len(q), QUERIES_AT_ONCE):
        active = np.arange(at, min(at + QUERIES_AT_ONCE, len(q)))
        step = start
        while len(active):
            depth = max(1, min(n, int(np.ceil(n * DEPTHS[step]))))
            if depth == n:
                # the lists are read to their ends: both bounds are the score
                upper = lower = q[active] @ x.T
            else:
                lower, upper = _bounds(q[active], x, lists, depth)
            own = qid[active][:, None] == xid[None, :]
            least = floor[active]
            if n > k:
                lower = np.where(own, -np.inf, lower)
                least = np.maximum(least, np.partition(lower, n - k, axis=1)[:, n - k])
            left = (upper >= least[:, None]) & ~own
            done = (left.sum(axis=1) <= RESOLVE * n) | (depth == n)
            rows, cols = np.nonzero(left[done])
            pairs.append((active[done][rows], cols))
            stopped[active[done]] = step
            active = active[~done]
            # far from stopping: the bounds are looked at again two steps on
            step = min(step + (2 if left.mean() > FAR else 1), len(DEPTHS) - 1)
    rows, cols = (np.concatenate(p) for p in zip(*pairs))
    score = np.empty(len(rows))
    for at in range(0, len(rows), 1 << 16):  # resolve the final scores of the pairs that are left
        score[at: at + (1 << 16)] = np.einsum("ij,ij->i", q[rows[at: at + (1 << 16)]], x[cols[at: at + (1 << 16)]])
    return rows, cols, score, stopped


def _best(rows: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query row: score descending, id ascending."""
    order = np.lexsort((ids, -score, rows))
    r = rows[order]
    first = np.searchsorted(r, r)
    return order[np.arange(len(r)) - first < k]


def _matrix(raw: bytes, rows: int, dim: int) -> np.ndarray:
    kind = "<i2" if len(raw) == 2 * rows * dim else "<i8"
    return np.frombuffer(raw, kind).reshape(rows, dim).astype(np.float64)


def _search(k: int, report: bool = False):
    """The k best of each query in its cell, or (``report``) what the cell's lists cost it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def result():
            _, qid, _, (rows, ids, score), cost, _ = state
            if report:
                columns, names = [qid, *cost], [x.split()[0] for x in READS.split(", ")]
            else:
                columns, names = [qid[rows], ids, score.astype(np.int64)], ["query_id", "vec_id", "score"]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        for batch in batches:
            for key, dim, qids, qvecs, ids, vecs in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if state is None or state[0] != key:
                    if state is not None:
                        yield result()
                    qid = np.frombuffer(qids, "<i8")
                    q = _matrix(qvecs, len(qid), dim)
                    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                    state = [key, qid, q, none, np.zeros((3, len(qid)), np.int64), 0]
                _, qid, q, (rows, have, score), cost, start = state
                xid = np.frombuffer(ids, "<i8")
                x = _matrix(vecs, len(xid), dim)
                floor = np.full(len(qid), -np.inf)
                count = np.bincount(rows, minlength=len(qid))
                if len(rows):
                    np.minimum.at(low := np.full(len(qid), np.inf), rows, score)
                    floor = np.where(count >= k, low, -np.inf)
                r, c, s, stopped = block_topk(q, qid, x, xid, floor, k, start)
                lists = (q != 0).sum(axis=1)                  # a list whose weight is 0 is not read
                depth = np.minimum(len(xid), np.maximum(1, np.ceil(len(xid) * np.array(DEPTHS)))).astype(np.int64)
                cost += [lists * len(xid), lists * depth[stopped], np.bincount(r, minlength=len(qid))]
                if np.isfinite(floor).all():
                    # the next block will not let a query stop much earlier
                    state[5] = max(0, int(stopped.min()) - 1)
                rows, have, score = np.concatenate([rows, r]), np.concatenate([have, xid[c]]), np.concatenate([score, s])
                best = _best(rows, have, score, k)
                state[3] = (rows[best], have[best], score[best])
        if state is not None:
            yield result()
    return run


def _cells(vectors: DataFrame, is_query, query_block: int, candidate_block: int) -> DataFrame:
    """Grid of (query block, part of the candidates): every pair of blocks meets in one cell."""
    n, n_queries = vectors.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    q_blocks = max(1, -(-n_queries // query_block))
    parts = max(1, -(-n // (BLOCKS_PER_TASK * candidate_block)))
    packed = "dim int, ids binary, vecs binary"
    queries = vectors.where(is_query).repartition(q_blocks, F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks))) \
        .mapInArrow(_packer(query_block), packed) \
        .select(F.pmod(F.xxhash64("ids"), F.lit(q_blocks)).alias("qb"), F.col("dim").alias("qdim"), F.col("ids").alias("qids"),
                F.col("vecs").alias("qvecs"), F.sha1(F.concat("ids", "vecs")).alias("key")) \
        .withColumn("cp", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    blocks = vectors.mapInArrow(_packer(candidate_block), packed) \
        .withColumn("cp", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int")) \
        .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))
    return queries.join(blocks.withColumnsRenamed({"qb": "qb2", "cp": "cp2"}),
                        (F.col("qb") == F.col("qb2")) & (F.col("cp") == F.col("cp2")) & (F.col("qdim") == F.col("dim"))) \
        .sortWithinPartitions("key", "cp").select("key", "dim", "qids", "qvecs", "ids", "vecs")


def top_k(vectors: DataFrame, is_query, k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """Each query's k best among all other rows. ``vectors``: vec_id, vec (array of long, no nulls)."""
    partial = _cells(vectors, is_query, query_block, candidate_block).mapInArrow(_search(k), PARTIAL)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def reading(vectors: DataFrame, is_query, k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """What ``top_k`` costs each query id: places of its lists, places read, final scores resolved."""
    partial = _cells(vectors, is_query, query_block, candidate_block).mapInArrow(_search(k, True), READS)
    return partial.groupBy("query_id").agg(*[F.sum(c).alias(c) for c in ("places", "read", "resolved")])


def scaled(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and the components floor(scale * x) of the vectors without null or non-finite components."""
    vec = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where(ok).select("vec_id", F.transform(vec, lambda x: F.floor(x * scale).cast("long")).alias("vec"))

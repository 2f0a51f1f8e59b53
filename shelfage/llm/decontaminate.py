"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of a partition. Its words become numbers of the benchmark's
vocabulary (0: any other word); as no phrase holds a 0, only runs of benchmark words at least as
long as the shortest phrase can hold one, and only they are indexed, with a 0 between runs.
The index is the Burrows-Wheeler transform of that sequence with a wavelet matrix for ranks and
suffix positions sampled every ``SAMPLE`` places. All phrases are searched backward at once, the
occurrences are located by stepping to the next sampled position, and their spans are merged per
document. Every document is in one shard, so nothing is shuffled and memory is bounded by a shard
and by a block of the benchmark.

The benchmark's distinct rows are dealt into blocks of about ``BLOCK_BYTES``, whatever item they belong to; executors prepare each
block once and write it to the shared folder. A task holds one block at a time; where there are several, each load
serves ``SLICES_PER_LOAD`` shards. Words are compared by a 64-bit hash of their bytes.

Defined cases: null or wordless texts have no words and no hits; a null item_id counts as an item named by the
empty string; rows with equal item_id are one item; an empty benchmark or document table works;
other columns are ignored; repeated documents each get a row.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfage.llm.common import alnum_words, commit_file, filesystem, giving_back, slices, text_buffer, token_bounds, word_hashes
from shelfage.session import scratch_path

WINDOW = 10
SHARD_BYTES = (4 << 20) - 16
BLOCK_BYTES = 8 << 20
SAMPLE = 8
SLICES_PER_LOAD = 8

HITS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and the number of words before each document."""
    starts, ends, before = token_bounds(data, off, alnum_words())
    return word_hashes(data, starts, ends, lower=True), before


# ---------------------------------------------------------------- the benchmark
def prepare(ids: list, texts: pa.Array, window: int) -> dict[str, np.ndarray]:
    """Vocabulary, distinct phrases (rows of word numbers, zeros behind) and the items of each phrase."""
    words, before = _words(*text_buffer(texts))
    vocabulary, number = np.unique(words, return_inverse=True)
    number = number.astype(np.int64) + 1
    rows, owner = [], []
    for i in range(len(ids)):
        w = number[before[i]: before[i + 1]]
        if len(w):
            n = min(window, len(w))
            some = np.zeros((len(w) - n + 1, window), np.int64)
            some[:, :n] = np.lib.stride_tricks.sliding_window_view(w, n)
            rows.append(some)
            owner += [i] * len(some)
    names = sorted({"" if x is None else str(x) for x in ids})
    place = {x: k for k, x in enumerate(names)}
    item = np.array([place["" if x is None else str(x)] for x in ids], np.int64)
    table = np.concatenate(rows) if rows else np.zeros((0, window), np.int64)
    phrases, which = np.unique(table, axis=0, return_inverse=True)
    pair = np.unique(np.stack([which.reshape(-1), item[np.array(owner, np.int64)] if owner else np.zeros(0, np.int64)], axis=1), axis=0) \
        if len(table) else np.zeros((0, 2), np.int64)
    return {"vocabulary": vocabulary, "phrases": phrases, "lengths": (phrases > 0).sum(axis=1),
            "first": np.searchsorted(pair[:, 0], np.arange(len(phrases) + 1)), "items": pair[:, 1],
            "names": np.array(names, dtype=str)}


def _write_block(folder: str, window: int):
    """Prepares one block and writes it under a name of its own attempt, renamed when whole."""
    def run(table: pa.Table) -> pa.Table:
        texts = pa.concat_arrays(table.column("text").chunks).cast(pa.string())
        buffer = io.BytesIO()
        np.savez(buffer, **prepare(table.column("item_id").to_pylist(), texts, window))
        fs, root = filesystem(folder)
        name = f"block-{table.column('block')[0].as_py():08d}.npz"
        attempt = f"{root.rstrip('/')}/_temporary-{uuid.uuid4().hex}"
        with fs.open_output_stream(attempt) as f:
            f.write(buffer.getvalue())
        commit_file(fs, attempt, f"{root.rstrip('/')}/{name}")
        return pa.table({"path": [f"{folder.rstrip('/')}/{name}"]})
    return run


def benchmark_blocks(spark: SparkSession, benchmark: DataFrame, window: int, block_bytes: int) -> list[str]:
    """Prepares the benchmark in blocks on the executors; returns the files' paths in the shared folder (one per ``block_bytes``)."""
    folder = scratch_path(spark, "benchmark")
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    benchmark = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.length("text") > 0)
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // block_bytes + 1
    # the rows of an item may lie in several blocks: its name then comes from each of them
    blocks = benchmark.distinct().withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    return sorted(r["path"] for r in blocks.groupBy("block").applyInArrow(_write_block(folder, window), "path string").collect())


# ---------------------------------------------------------------- the index of a shard
def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the end sorts before everything."""
    n = len(text)
    rank = (np.unique(text, return_inverse=True)[1] + 1).astype(np.int32)
    h = 1
    while True:
        key = rank.astype(np.int64) * (n + 2)
        key[: max(n - h, 0)] += rank[h:]
        order = np.argsort(key, kind="stable").astype(np.int32)
        key = key[order]
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        del key
        rank[order] = np.cumsum(new, dtype=np.int32)
        if rank[order[-1]] == n or h >= n:
            return order
        h *= 2


class FMIndex:
    """Places and counts take 4 bytes each: a text has fewer than 2**31 bytes, so fewer words."""

    def __init__(self, text: np.ndarray, symbols: int):
        """``text``: numbers from 0 to ``symbols``; an end marker is added (as -1, kept apart from the symbols)."""
        n = len(text) + 1
        sa = np.concatenate([np.array([n - 1], np.int32), suffix_array(text)]) if len(text) else np.zeros(1, np.int32)
        bwt = np.concatenate([text, [0]]).astype(np.int32)[sa - 1]
        self.end_row = int(np.flatnonzero(sa == 0)[0])       # its transform is the end marker
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))]) + 1
        marked = sa % SAMPLE == 0
        self.marked = marked
        self.rank = np.cumsum(marked, dtype=np.int32) - 1
        self.kept = sa[marked]
        del sa
        self.bwt, self.n, self.symbols = bwt, n, symbols
        self.levels = max(1, int(symbols).bit_length())
        self.ones, self.zeros = [], []
        seq = np.delete(bwt, self.end_row)
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1 == 1
            ones = np.zeros(n, np.int32)
            np.cumsum(bit, dtype=np.int32, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - 1 - int(ones[-1]))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def occ(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands in the transform before ``row``, through the wavelet matrix."""
        to = row - (row > self.end_row)
        start = np.zeros_like(to)
        for k in range(self.levels):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            one, zeros = self.ones[k], self.zeros[k]
            a, b = one[start], one[to]
            start = np.where(bit == 1, zeros + a, start - a)
            to = np.where(bit == 1, zeros + b, to - b)
        return to - start

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of all phrases, by backward search of all at once."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            at = np.flatnonzero((k < lengths) & (low < high))
            if len(at):
                c = phrases[at, k]
                base = self.before[c]
                low[at], high[at] = base + self.occ(c, low[at]), base + self.occ(c, high[at])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows: steps backward to a sampled suffix."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.marked[rows])
        while len(todo):
            r = rows[todo]
            c = self.bwt[r]
            rows[todo] = self.before[c] + self.occ(c, r)
            steps[todo] += 1
            todo = todo[~self.marked[rows[todo]]]
        return self.kept[self.rank[rows]] + steps


def _runs(number: np.ndarray, before: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of at least ``least`` vocabulary words within a document, a 0 after each, and the word of every place."""
    n = len(number)
    inside = number > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = before[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = end - start >= least
    start, end = start[long], end[long]
    size = end - start + 1
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    tail = np.cumsum(size) - 1
    text = number[np.minimum(place, max(n - 1, 0))] if n else np.zeros(0, np.int64)
    text[tail] = 0
    return text, place


def find(words: np.ndarray, before: np.ndarray, block: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All occurrences in a shard: first word, number of words and phrase of each."""
    vocabulary, phrases, lengths = block["vocabulary"], block["phrases"], block["lengths"]
    none = np.zeros(0, np.int64)
    if not len(phrases) or not len(words):
        return none, none, none
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    number = np.where(vocabulary[at] == words, at + 1, 0)
    text, place = _runs(number, before, int(lengths.min()))
    if not len(text):
        return none, none, none
    index = FMIndex(text, len(vocabulary))
    low, high = index.search(phrases, lengths)
    count = high - low
    which = np.repeat(np.arange(len(phrases)), count)
    rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    return place[index.locate(rows)], lengths[which], which


def _searched(batches: Iterator[pa.RecordBatch], paths: list[str], column: str) -> Iterator[tuple]:
    """For every slice: its rows, the number of words before each document, which words are hit, and the items of each document."""
    loaded: dict[str, dict] = {}

    def block(path: str) -> dict:
        if path not in loaded:
            loaded.clear()
            fs, p = filesystem(path)
            with fs.open_input_stream(p) as f:
                loaded[path] = dict(np.load(io.BytesIO(f.read())))
        return loaded[path]

    def search(pieces: list[pa.RecordBatch]) -> Iterator[tuple]:
        shards = [_words(*text_buffer(piece.column(column))) for piece in pieces]
        edges = [np.zeros(len(words) + 1, np.int64) for words, _ in shards]
        items: list[list[set]] = [[set() for _ in range(piece.num_rows)] for piece in pieces]
        for path in paths:
            b = block(path)
            for (words, before), edge, some in zip(shards, edges, items):
                start, length, which = find(words, before, b)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + length, -1)
                doc = np.searchsorted(before, start, side="right") - 1
                for d, w in np.unique(np.stack([doc, which], axis=1), axis=0).tolist():
                    some[d].update(b["names"][b["items"][b["first"][w]: b["first"][w + 1]]].tolist())
        for piece, (_, before), edge, some in zip(pieces, shards, edges, items):
            yield piece, before, np.cumsum(edge[:-1]) > 0, some

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for piece in slices(batch, column, SHARD_BYTES):
            held.append(piece)
            if len(paths) < 2 or len(held) == SLICES_PER_LOAD:
                yield from search(held)
                held = []
    if held:
        yield from search(held)


def _counts(hit: np.ndarray, before: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[before[1:]] - total[before[:-1]]


def _scan(paths: list[str], keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, before, hit, items in _searched(batches, paths, "_text"):
            n_hit = _counts(hit, before)
            spans = [_spans(hit[before[d]: before[d + 1]]) if n_hit[d] else "" for d in range(piece.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*piece.columns[:keep], pa.array(np.diff(before).astype(np.int64)), pa.array(n_hit.astype(np.int64)),
                 pa.array([len(x) for x in items], pa.int64()),
                 pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()),
                 pa.array(n_hit > 0), pa.array(spans, pa.string())],
                names=[*piece.schema.names[:keep], *[x.split()[0] for x in HITS.split(", ")]])
    return run


def _clean(paths: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, before, hit, _ in _searched(batches, paths, "text"):
            yield piece.filter(pa.array(_counts(hit, before) == 0))
    return run


def _spans(hit: np.ndarray) -> str:
    """Merged spans of hit words, as first:end (end exclusive), comma-joined."""
    e = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return ",".join(f"{a}:{b}" for a, b in zip(e[::2], e[1::2]))


def scan(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
         block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the hits of every document."""
    paths = benchmark_blocks(spark, benchmark, window, block_bytes)
    schema = docs.select(*keep).schema
    for part in HITS.split(", "):
        schema = schema.add(*part.split())
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(giving_back(_scan(paths, len(keep))), schema)


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any benchmark window, columns unchanged. Rows go to Python once and only the kept ones return."""
    paths = benchmark_blocks(spark, benchmark, window, block_bytes)
    return docs.mapInArrow(giving_back(_clean(paths)), docs.schema)

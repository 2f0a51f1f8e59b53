"""Removal of repeated word windows by recompression.

Rounds of recompression name the words of a document: a round first names maximal runs of one
symbol, then pairs of a "left" and a "right" symbol (the side is a bit of the
name). Names are hashes of what they stand for, so they are global: equal
symbols get equal names in every task, without a table of names. Inside equal substrings the
parse is the same but for a few symbols at the ends, which depend on the neighbours. A window of 13 words is
named by the words that may differ at its two ends (popped) and the high-level symbols between, which
only depend on the window. Windows with a shared name are found by exchanging names in hash
buckets (``chunks``). Every match is verified: inside a slice windows of one name are compared word by word
(the words' bytes), between slices by a second, independent fingerprint of their words.

Passes over the chunk store: 1. send every slice's distinct window names (four bytes each);
the buckets answer which occur in several slices. 2. For those send fingerprint and smallest doc_id of
the slice; the buckets answer which have a smaller doc_id elsewhere. 3. Cover the words and digest
what is left. Memory is bounded by a slice and a bucket.

Defined cases: null or empty texts have no words; a null doc_id counts as smaller than any other; rows
with equal doc_id do not remove each other's words; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfage.llm import chunks
from shelfage.llm.common import U64, mix, prefix_hash, range_hash, space_words, text_buffer, token_bounds, word_hashes
from shelfage.session import scratch_path

WINDOW = 13
ROUNDS = 2
COMPARED_AT_ONCE = 32     # leading bytes of words that are compared for many words together

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans string"


class Level:
    """A parse: the names of its symbols, the symbol of the level below at which each starts, and whether it starts a document."""

    def __init__(self, names: np.ndarray, start: np.ndarray, head: np.ndarray):
        self.names, self.start, self.head = names, start, head

    def block_of(self, n: int) -> np.ndarray:
        """The symbol that holds each of the n symbols below; entry n is the number of symbols."""
        first = np.zeros(n + 1, np.int64)
        first[self.start] = 1
        first[n] = 1
        return np.cumsum(first) - 1


def name_runs(names: np.ndarray, head: np.ndarray) -> Level:
    new = head.copy()
    new[1:] |= names[1:] != names[:-1]
    start = np.flatnonzero(new)
    length = np.diff(np.concatenate([start, [len(names)]]))
    return Level(np.where(length > 1, mix(names[start] ^ mix(length.astype(U64))), names[start]), start, head[start])


def left_side(names: np.ndarray, round_: int) -> np.ndarray:
    return (names >> U64(17 + round_)) & U64(1) == 0


def name_pairs(names: np.ndarray, head: np.ndarray, round_: int) -> Level:
    left = left_side(names, round_)
    pair = np.zeros(len(names), bool)
    pair[:-1] = left[:-1] & ~left[1:] & ~head[1:]
    second = np.zeros(len(names), bool)
    second[1:] = pair[:-1]
    start = np.flatnonzero(~second)
    joined = pair[start]
    other = names[np.minimum(start + 1, len(names) - 1)]
    return Level(np.where(joined, mix(names[start] * U64(0x9E3779B97F4A7C15) + other), names[start]), start, head[start])


def window_names(words: np.ndarray, head: np.ndarray, at: np.ndarray, window: int, rounds: int = ROUNDS) -> np.ndarray:
    """A name for the windows of ``window`` words that start at ``at`` (none crosses a document), equal for equal windows.

    ``low`` and ``high`` run over the levels: the first symbol that lies within the window and does not depend
    on what is outside, and the one after the last.
    """
    names, first_word = words, np.arange(len(words) + 1)
    low, high = at, at + window
    for round_ in range(rounds):
        # runs that touch an end of the range may go on beyond it
        runs = name_runs(names, head)
        block = runs.block_of(len(names))
        some = low < high
        low, high = block[low] + 1, np.where(some, block[np.maximum(high - 1, 0)], 0)
        first_word = first_word[np.concatenate([runs.start, [len(names)]])]
        names, head = runs.names, runs.head
        # a right symbol at the lower end, or a left one at the upper, may pair across it
        left = left_side(names, round_)
        some = low < high
        low = low + (some & ~left[np.minimum(low, len(names) - 1)])
        high = high - (some & left[np.maximum(high - 1, 0)])
        pairs = name_pairs(names, head, round_)
        block = pairs.block_of(len(names))
        some = low < high
        low, high = np.where(some, block[np.minimum(low, len(names))], 0), np.where(some, block[np.minimum(np.maximum(high, 0), len(names))], 0)
        first_word = first_word[np.concatenate([pairs.start, [len(names)]])]
        names, head = pairs.names, pairs.head
    some = low < high
    a = np.where(some, first_word[low], at)
    b = np.where(some, first_word[high], at)
    raw, high_level = prefix_hash(words), prefix_hash(names)
    middle = np.where(some, range_hash(high_level, low, np.where(some, high, low)), U64(0))
    key = mix(range_hash(raw, at, a) + U64(0x632BE59BD9B4E019))
    key = mix(key ^ (middle + ((a - at).astype(U64) << U64(32))))
    return mix(key ^ (range_hash(raw, b, at + window) + ((b - at).astype(U64) << U64(40))))


def same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the words ``x`` and ``y`` are equal pair by pair, byte for byte."""
    for at in range(0, len(x), 1 << 18):
        i, j = x[at: at + (1 << 18)], y[at: at + (1 << 18)]
        size = ends[i] - starts[i]
        if not np.array_equal(size, ends[j] - starts[j]):
            return False
        for k in range(COMPARED_AT_ONCE):
            some = size > k
            if not some.any():
                break
            if not np.array_equal(data[starts[i[some]] + k], data[starts[j[some]] + k]):
                return False
        for a, b in zip(i[size > COMPARED_AT_ONCE].tolist(), j[size > COMPARED_AT_ONCE].tolist()):
            if not np.array_equal(data[starts[a]: ends[a]], data[starts[b]: ends[b]]):
                return False
    return True


class Slice:
    """The windows of a slice: their places, documents and names, and the distinct names with the smallest doc_id of each."""

    def __init__(self, piece: pa.RecordBatch, window: int, buckets: int):
        self.ids = chunks.doc_ids(piece)
        self.window = window
        self.data, self.off = text_buffer(piece.column(1))
        self.starts, self.ends, self.before = token_bounds(self.data, self.off, space_words())
        n = len(self.starts)
        last = np.repeat(self.before[1:], np.diff(self.before))
        self.at = np.flatnonzero(np.arange(n) + window <= last)
        if len(self.at):
            self.words = word_hashes(self.data, self.starts, self.ends)
            head = np.zeros(n, bool)
            head[self.before[:-1][np.diff(self.before) > 0]] = True
            names = window_names(self.words, head, self.at, window)
        else:
            self.words, names = np.zeros(0, U64), np.zeros(0, U64)
        order = np.argsort(names, kind="stable")
        sorted_ = names[order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        if not self._alike(order, np.flatnonzero(~new)):
            # different windows share a name: told apart by their words
            rank = self._text_rank()
            order = order[np.lexsort((rank[order], sorted_))]
            new[1:] |= rank[order][1:] != rank[order][:-1]
        self.first = np.flatnonzero(new)
        self.order = order
        self.entry = np.cumsum(new) - 1                       # of the windows in ``order``
        self.doc = self.ids[np.searchsorted(self.before, self.at, side="right") - 1][order]
        self.least = np.minimum.reduceat(self.doc, self.first) if len(order) else np.zeros(0, np.int64)
        self.bucket, self.rest = chunks.bucketed(sorted_[self.first], buckets)

    def _alike(self, order: np.ndarray, again: np.ndarray) -> bool:
        """Whether the windows at the places ``again`` of ``order`` have the same words as the windows before them there."""
        a, b = self.at[order[again]], self.at[order[again - 1]]
        # pairs of neighbours whose first words follow such a pair's need their last word compared only
        first = np.ones(len(a), bool)
        by = np.argsort(a, kind="stable")
        first[by[1:]] = (a[by][1:] != a[by][:-1] + 1) | (b[by][1:] != b[by][:-1] + 1)
        k = np.arange(self.window)
        x = np.concatenate([(a[first][:, None] + k).ravel(), a[~first] + self.window - 1])
        y = np.concatenate([(b[first][:, None] + k).ravel(), b[~first] + self.window - 1])
        return same_words(self.data, self.starts, self.ends, x, y)

    def _text_rank(self) -> np.ndarray:
        """A number for each window, equal for windows of equal words."""
        raw = self.data.tobytes()
        texts = [b" ".join(raw[a:b] for a, b in zip(self.starts[k: k + self.window].tolist(), self.ends[k: k + self.window].tolist()))
                 for k in self.at.tolist()]
        place = {t: i for i, t in enumerate(sorted(set(texts)))}
        return np.array([place[t] for t in texts], np.int64)

    def fingerprints(self, entries: np.ndarray) -> np.ndarray:
        at = self.at[self.order[self.first[entries]]]
        return mix(range_hash(prefix_hash(self.words, 1), at, at + self.window, 1))

    def marked(self, received: list[dict]) -> np.ndarray:
        """Bits of the entries, from the answers of their buckets."""
        out = np.zeros(len(self.first), bool)
        by = {r["bucket"]: r for r in received}
        for bucket, a, b in chunks.bucket_ranges(self.bucket):
            if bucket in by:
                out[a:b] = chunks.bits_of(by[bucket], b - a)
        return out


def _send_names(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, path in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                for number, _, piece in chunks.read_slices(path):
                    s = Slice(piece, window, buckets)
                    yield chunks.messages([(file, path, number, bucket, 0, chunks.pack(s.rest[a:b], True), None, None)
                                           for bucket, a, b in chunks.bucket_ranges(s.bucket)])
    return run


def _send_candidates(window: int, buckets: int):
    """For a file with its answers: fingerprint and smallest doc_id of each repeated name."""
    def run(table: pa.Table) -> pa.Table:
        received: dict[int, list] = {}
        for r in table.to_pylist():
            received.setdefault(r["slice"], []).append(r)
        file, path = table.column("file")[0].as_py(), table.column("path")[0].as_py()
        out = []
        for number, _, piece in chunks.read_slices(path):
            if number in received:
                s = Slice(piece, window, buckets)
                hit = np.flatnonzero(s.marked(received[number]))
                for bucket, a, b in chunks.bucket_ranges(s.bucket[hit]):
                    e = hit[a:b]
                    out.append((file, path, number, bucket, 0, chunks.pack(s.rest[e], True), chunks.pack(s.fingerprints(e)), chunks.pack(s.least[e])))
        return chunks.message_table(out)
    return run


def _smaller_elsewhere(table: pa.Table) -> pa.Table:
    """A bit for each candidate: verified (equal rest and fingerprint) in a slice with a smaller doc_id."""
    rows = table.to_pylist()
    rest = [unpacked for unpacked in (chunks.unpack(r["data"], "<u4", True) for r in rows)]
    print_ = np.concatenate([chunks.unpack(r["more"], "<u8") for r in rows])
    ids = np.concatenate([chunks.unpack(r["ids"], "<i8") for r in rows])
    every = np.concatenate(rest)
    order = np.lexsort((print_, every))
    new = np.ones(len(order), bool)
    new[1:] = (every[order][1:] != every[order][:-1]) | (print_[order][1:] != print_[order][:-1])
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = np.zeros(len(order), bool)
    hit[order] = least < ids[order]
    out, at = [], 0
    for r, part in zip(rows, rest):
        mine = hit[at: at + len(part)]
        at += len(part)
        if mine.any():
            out.append((r["file"], r["path"], r["slice"], r["bucket"], 2, np.packbits(mine).tobytes(), None, None))
    return chunks.message_table(out)


def _kept(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray, before: np.ndarray) -> list[str]:
    """SHA-256 of each document's kept words, joined by one space."""
    s, e = starts[keep], ends[keep]
    size = e - s + 1
    stop = np.cumsum(size)
    src = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - size, size) + np.repeat(s, size)
    out = data[np.minimum(src, max(len(data) - 1, 0))] if len(src) else np.zeros(0, np.uint8)
    out[stop - 1] = 32
    kept = np.concatenate([[0], np.cumsum(keep)])[before]
    edge = np.concatenate([[0], stop])[kept]
    raw = out.tobytes()
    return [hashlib.sha256(raw[a: max(a, b - 1)]).hexdigest() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


def _cover(window: int, buckets: int, with_text: bool = False):
    def run(table: pa.Table) -> pa.Table:
        repeats: dict[int, list] = {}
        smaller: dict[int, dict[int, dict]] = {}
        for r in table.to_pylist():
            if r["kind"] == 1:
                repeats.setdefault(r["slice"], []).append(r)
            elif r["kind"] == 2:
                smaller.setdefault(r["slice"], {})[r["bucket"]] = r
        path = table.column("path")[0].as_py()
        out = []
        for number, _, piece in chunks.read_slices(path):
            s = Slice(piece, window, buckets)
            # a window goes if its document is not the first of the slice that has it, or another slice has a smaller one
            gone = s.doc > s.least[s.entry] if len(s.order) else np.zeros(0, bool)
            if number in smaller:
                flag = np.zeros(len(s.first), bool)
                hit = np.flatnonzero(s.marked(repeats[number]))
                for bucket, a, b in chunks.bucket_ranges(s.bucket[hit]):
                    if bucket in smaller[number]:
                        flag[hit[a:b]] = chunks.bits_of(smaller[number][bucket], b - a)
                gone |= flag[s.entry]
            at = s.at[s.order[gone]]
            n = len(s.starts)
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            removed = np.cumsum(edge[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(removed)])[s.before]
            ids = piece.column(0)
            spans = []
            for d, some in enumerate((np.diff(total) > 0).tolist()):
                cut = np.flatnonzero(np.diff(np.concatenate([[0], removed[s.before[d]: s.before[d + 1]].astype(np.int8), [0]]))) if some else ()
                spans.append(",".join(f"{a}:{b}" for a, b in zip(cut[::2], cut[1::2])))
            out.append(pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(np.diff(s.before).astype(np.int64)), pa.array(np.diff(total).astype(np.int64)),
                 pa.array(_kept(s.data, s.starts, s.ends, ~removed, s.before), pa.string()), pa.array(spans, pa.string())],
                names=[x.split()[0] for x in RESULT.split(", ")]))
        if not out:
            return pa.table({x.split()[0]: pa.array([], pa.int64() if x.split()[1] == "long" else pa.string()) for x in RESULT.split(", ")})
        return pa.Table.from_batches(out)
    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, bucket_bytes: int = chunks.BUCKET_BYTES) -> DataFrame:
    """Per document: words, removed words, the removed spans (word numbers) and the digest of the kept words."""
    store = chunks.Store(spark, docs, bucket_bytes)
    b = store.buckets
    answers = scratch_path(spark, "repeated-names")
    store.tasks().mapInArrow(_send_names(window, b), chunks.MESSAGE).groupBy("bucket").applyInArrow(chunks.repeated, chunks.MESSAGE).write.parquet(answers)
    repeats = spark.read.parquet(answers)
    smaller = repeats.groupBy("file").applyInArrow(_send_candidates(window, b), chunks.MESSAGE) \
        .groupBy("bucket").applyInArrow(_smaller_elsewhere, chunks.MESSAGE)
    none = [F.lit(None).cast(t).alias(n) for n, t in (("slice", "int"), ("bucket", "long"))]
    every = store.files.select("file", "path", *none, F.lit(0).alias("kind"), *[F.lit(None).cast("binary").alias(c) for c in ("data", "more", "ids")])
    return every.unionByName(repeats).unionByName(smaller).groupBy("file").applyInArrow(_cover(window, b), RESULT)

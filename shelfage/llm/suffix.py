"""Removal of repeated byte strings with enhanced suffix arrays and their common-prefix interval trees.

Every string of 50 bytes holds an anchor: the place of the smallest hash among its 16-byte grams (all
places, if several). Equal strings hold equal anchors at equal places, so suffixes only have to be sorted among the
suffixes at anchors, and only among anchors with equal grams, wherever they are:

1. every slice of the chunk store sends its distinct anchor hashes; the hash buckets answer which other slices
   or documents have them too;
2. for those anchors the slices send the text around them (34 bytes before, 50 from the anchor on, within the document), each distinct
   context once with its smallest doc_id. A bucket sorts the suffixes at its anchors (suffix array), takes the
   common prefixes of neighbours (LCP) and scans them with a stack, which yields the tree of common-prefix
   intervals. The bytes before the anchors of an interval are scanned the same way: members that agree on l bytes to the left
   and r to the right, and on no more on either side, are a maximal repeat of l + r bytes with all its occurrences
   (``maximal_groups``). From these groups the bucket answers for each context which of its 35 strings occur in a smaller document;
3. the slices cover the bytes and digest what is left; ``repeat_groups`` puts out the groups with every place instead.

Memory is bounded by a slice and a bucket; equal contexts of a slice travel once, so a passage that a third of
the documents share costs an entry a slice.

Defined cases: null text is empty; a null doc_id counts as smaller than any other; rows with equal doc_id do not
remove each other's bytes; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfage.llm import chunks
from shelfage.llm.common import U64, byte_prefix, mix, range_hash, text_buffer
from shelfage.session import scratch_path

LENGTH = 50
GRAM = 16
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every ``width`` neighbours, by doubling (length len(x) - width + 1)."""
    done = 1
    while done * 2 <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[: len(x) - (width - done)], x[width - done:]) if width > done else x


def anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are the smallest of some string of ``length`` bytes within a document."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    grams = np.arange(n - gram + 1)
    h = mix(range_hash(byte_prefix(data), grams, grams + gram))
    width = length - gram + 1
    least = _sliding(h, width, np.minimum)                    # of the string that starts at each place
    # strings that cross the end of a document do not count
    for end in off[1:-1].tolist():
        least[max(0, end - length + 1): end] = 0
    padded = np.zeros(len(least) + 2 * (width - 1), U64)
    padded[width - 1: width - 1 + len(least)] = least
    most = _sliding(padded, width, np.maximum)                # the largest of these minima over the strings that hold a gram
    at = np.flatnonzero((most == h) & (h > 0))
    # smallest hashes are small: mixed again, they spread over the buckets
    return at, mix(h[at] + U64(0x632BE59BD9B4E019))


class Slice:
    """The anchors of a slice, sorted by hash; ``group`` numbers the distinct hashes."""

    def __init__(self, piece: pa.RecordBatch, length: int, gram: int, buckets: int):
        self.ids = chunks.doc_ids(piece)
        self.data, self.off = text_buffer(piece.column(1))
        at, h = anchors(self.data, self.off, length, gram)
        order = np.argsort(h, kind="stable")
        self.at, h = at[order], h[order]
        self.doc = np.searchsorted(self.off, self.at, side="right") - 1
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        self.first = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.bucket, self.rest = chunks.bucketed(h[self.first], buckets)

    def several(self, within: bool = False) -> np.ndarray:
        """Bit of each distinct hash: more than one doc_id (``within``: place) of this slice has it."""
        if not len(self.at):
            return np.zeros(0, bool)
        if within:
            return np.bincount(self.group) > 1
        ids = self.ids[self.doc]
        return np.minimum.reduceat(ids, self.first) != np.maximum.reduceat(ids, self.first)

    def marked(self, received: list[dict]) -> np.ndarray:
        out = np.zeros(len(self.first), bool)
        by = {r["bucket"]: r for r in received}
        for bucket, a, b in chunks.bucket_ranges(self.bucket):
            if bucket in by:
                out[a:b] = chunks.bits_of(by[bucket], b - a)
        return out

    def contexts(self, marked: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the marked anchors: the anchor, its context number, and for each distinct context its anchor, bytes before and bytes after.

        Contexts are numbered in the order of (hash, context)."""
        pick = np.flatnonzero(marked[self.group]) if len(self.group) else np.zeros(0, np.int64)
        at, doc = self.at[pick], self.doc[pick]
        before = np.minimum(at - self.off[doc], length - gram)
        after = np.minimum(self.off[doc + 1] - at, length)
        k = np.arange(2 * length - gram) - (length - gram)
        # rows of bytes, zeros beyond the document, and the two lengths behind
        table = np.zeros((len(at), len(k) + 2), np.uint8)
        for a in range(0, len(at), 1 << 15):
            p = at[a: a + (1 << 15), None] + k
            inside = (k >= -before[a: a + (1 << 15), None]) & (k < after[a: a + (1 << 15), None])
            table[a: a + (1 << 15), :-2] = np.where(inside, self.data[np.clip(p, 0, max(len(self.data) - 1, 0))], 0)
        table[:, -2], table[:, -1] = before, after
        rows = table.view(f"V{table.shape[1]}").reshape(-1)
        order = np.lexsort((_row_rank(table), self.group[pick]))
        same = np.zeros(len(order), bool)
        same[1:] = (rows[order][1:] == rows[order][:-1]) & (self.group[pick][order][1:] == self.group[pick][order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(~same) - 1
        lead = order[~same]
        return pick, number, pick[lead], table[lead]


def _row_rank(table: np.ndarray) -> np.ndarray:
    """A number that is equal for equal rows, by a hash of the row (rows compare by it, then equality is checked)."""
    wide = np.zeros((len(table), -(-table.shape[1] // 8) * 8), np.uint8)
    wide[:, : table.shape[1]] = table
    words = wide.view("<u8")
    h = np.zeros(len(table), U64)
    for c in range(words.shape[1]):
        h = mix(h + words[:, c] * U64(0x9E3779B97F4A7C15) + U64(c + 1))
    return h


def _send_anchors(length: int, gram: int, buckets: int, within: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, path in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                for number, _, piece in chunks.read_slices(path):
                    s = Slice(piece, length, gram, buckets)
                    several = s.several(within)
                    yield chunks.messages([(file, path, number, bucket, 0, chunks.pack(s.rest[a:b], True), np.packbits(several[a:b]).tobytes(), None)
                                           for bucket, a, b in chunks.bucket_ranges(s.bucket)])
    return run


def _shared(table: pa.Table) -> pa.Table:
    """A bit for each anchor hash that another slice, or several documents of the slice, have."""
    rows = table.to_pylist()
    parts = [chunks.unpack(r["data"], "<u4", True) for r in rows]
    values, count = np.unique(np.concatenate(parts), return_counts=True)
    again = values[count > 1]
    out = []
    for r, part in zip(rows, parts):
        hit = np.unpackbits(np.frombuffer(r["more"], np.uint8), count=len(part)).astype(bool)
        if len(again):
            hit |= again[np.minimum(np.searchsorted(again, part), len(again) - 1)] == part
        if hit.any():
            out.append((r["file"], r["path"], r["slice"], r["bucket"], 1, np.packbits(hit).tobytes(), None, None))
    return chunks.message_table(out)


def _by_slice(table: pa.Table, kind: int) -> dict[int, list[dict]]:
    out: dict[int, list[dict]] = {}
    for r in table.to_pylist():
        if r["kind"] == kind:
            out.setdefault(r["slice"], []).append(r)
    return out


def _send_contexts(length: int, gram: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        received = _by_slice(table, 1)
        file, path = table.column("file")[0].as_py(), table.column("path")[0].as_py()
        out = []
        for number, _, piece in chunks.read_slices(path):
            if number in received:
                s = Slice(piece, length, gram, buckets)
                pick, context, lead, rows = s.contexts(s.marked(received[number]), length, gram)
                least = np.full(len(lead), np.iinfo(np.int64).max)
                np.minimum.at(least, context, s.ids[s.doc[pick]])
                group = s.group[lead]
                for bucket, a, b in chunks.bucket_ranges(s.bucket[group]):
                    out.append((file, path, number, bucket, 0, chunks.pack(s.rest[group[a:b]], True), rows[a:b].tobytes(), chunks.pack(least[a:b])))
        return chunks.message_table(out)
    return run


def interval_tree(lcp: list[int], least: int) -> Iterator[tuple[int, int, int, int]]:
    """(depth, depth of the parent, first, last) of the common-prefix intervals of depth >= ``least``, children before parents.

    ``lcp[i]`` is the common prefix of suffixes i - 1 and i (lcp[0] is 0). One scan with a stack of open intervals.
    """
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        depth = lcp[i] if i < len(lcp) else 0
        left = i - 1
        while stack[-1][0] > depth:
            d, left = stack.pop()
            if d >= least:
                yield d, max(stack[-1][0], depth), left, i - 1
        if stack[-1][0] < depth:
            stack.append((depth, left))


def _common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    lo = 0
    while n - lo > 1:
        mid = (lo + n) // 2
        lo, n = (mid, n) if x[:mid] == y[:mid] else (lo, mid)
    return lo


def maximal_groups(rows: list[tuple[bytes, bytes, int]], length: int, gram: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats of at least ``length`` bytes around one anchor: (bytes before it, bytes from it on, members).

    ``rows``: distinct contexts (bytes from the anchor on, bytes before it reversed, smallest doc_id). Members are all contexts that hold the
    repeat; no byte more is common to all of them on either side, as far as contexts reach.
    """
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])       # the suffix array
    lcp = [0, *(_common(rows[a][0], rows[b][0]) for a, b in zip(order, order[1:]))]
    for depth, _, first, last in interval_tree(lcp, gram):
        need = max(length - depth, 0)
        members = order[first: last + 1]
        if len(members) == 2:
            # a pair: one repeat, as far as both agree
            back = _common(rows[members[0]][1], rows[members[1]][1])
            if back >= need:
                yield back, depth, members
            continue
        # left extensions: the same scan over the sorted bytes before the anchor
        members.sort(key=lambda m: rows[m][1])
        agree = [0, *(_common(rows[i][1], rows[k][1]) for i, k in zip(members, members[1:]))]
        if need == 0 and min(agree[1:]) == 0:
            yield 0, depth, members
        for back, _, a, z in interval_tree(agree, max(need, 1)):
            some = members[a: z + 1]
            # members that agree on a byte more to the right are a group of a deeper interval
            after = {rows[m][0][depth: depth + 1] for m in some}
            if len(after) > 1 or b"" in after:
                yield back, depth, some


def repeat_masks(rows: list[tuple[bytes, bytes, int]], length: int, gram: int) -> list[int]:
    """Of the contexts of one anchor, from their maximal groups.

    Bit j of a context's mask: the string that starts length - gram - j bytes before the anchor also occurs in a
    context with a smaller doc_id.
    """
    masks = [0] * len(rows)
    for back, depth, members in maximal_groups(rows, length, gram):
        # strings of ``length`` bytes within the repeat: gram + j bytes of them lie beyond the anchor
        low, high = max(length - back, gram), min(depth, length)
        if low <= high:
            least = min(rows[m][2] for m in members)
            bits = (1 << (high - gram + 1)) - (1 << (low - gram))
            for m in members:
                if rows[m][2] > least:
                    masks[m] |= bits
    return masks


def _trees(length: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        width = 2 * length - gram + 2
        rest = [chunks.unpack(r["data"], "<u4", True) for r in rows]
        size = [len(x) for x in rest]
        context = np.concatenate([np.frombuffer(r["more"], np.uint8).reshape(-1, width) for r in rows])
        ids = np.concatenate([chunks.unpack(r["ids"], "<i8") for r in rows])
        every = np.concatenate(rest)
        # equal contexts of all slices together
        order = np.lexsort((_row_rank(context), every))
        flat = context.view(f"V{width}").reshape(-1)[order]
        new = np.ones(len(order), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (every[order][1:] != every[order][:-1])
        first = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        least = np.minimum.reduceat(ids[order], first)
        # a context that a smaller document has whole: all its strings
        whole = (1 << (length - gram + 1)) - 1
        distinct = np.zeros(len(first), np.int64)
        anchor = every[order][first]
        lead = context[order][first]
        edge = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if b - a > 1:
                some = []
                for k in range(a, b):
                    raw = lead[k].tobytes()
                    left, right = raw[-2], raw[-1]
                    mid = length - gram
                    some.append((raw[mid: mid + right], raw[mid - left: mid][::-1], int(least[k])))
                distinct[a:b] = repeat_masks(some, length, gram)
        mask = np.zeros(len(order), np.int64)
        mask[order] = np.where(ids[order] > least[number], whole, distinct[number])
        out, at = [], 0
        for r, n in zip(rows, size):
            mine = mask[at: at + n]
            at += n
            if mine.any():
                out.append((r["file"], r["path"], r["slice"], r["bucket"], 2, chunks.pack(mine), None, None))
        return chunks.message_table(out)
    return run


def _context_groups(length: int, gram: int):
    """The maximal groups of a bucket's anchors, sent to every slice that holds a member: context, bytes before and from the anchor on, group."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        width = 2 * length - gram + 2
        mid = length - gram
        size = [len(r["more"]) // width for r in rows]
        context = np.concatenate([np.frombuffer(r["more"], np.uint8).reshape(-1, width) for r in rows])
        ids = np.concatenate([chunks.unpack(r["ids"], "<i8") for r in rows])
        every = np.concatenate([chunks.unpack(r["data"], "<u4", True) for r in rows])
        holders: dict[int, dict[bytes, list[int]]] = {}          # anchor: contexts: places in ``context``
        for k, (h, raw) in enumerate(zip(every.tolist(), context)):
            holders.setdefault(h, {}).setdefault(raw.tobytes(), []).append(k)
        found: dict[int, list[tuple]] = {}
        for some in holders.values():
            keys = list(some)
            sides = [(raw[mid: mid + raw[-1]], raw[mid - raw[-2]: mid][::-1], int(ids[some[raw]].min())) for raw in keys]
            # equal contexts are members together; alone they are a group as wide as the context
            groups = [*maximal_groups(sides, length, gram),
                      *((len(before), len(after), [m]) for m, (after, before, _) in enumerate(sides) if len(before) + len(after) >= length)]
            for back, depth, members in groups:
                after, before, _ = sides[members[0]]
                text = before[:back][::-1] + after[:depth]
                at, _ = anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]), length, gram)
                # a group is complete where its own strings have this anchor
                if back in at:
                    name = hashlib.sha256(text).digest()[:16]
                    open_ = (back == mid) + 2 * (depth == length)
                    for m in members:
                        for k in some[keys[m]]:
                            found.setdefault(k, []).append((back, depth, open_, name))
        out, at = [], 0
        for r, n in zip(rows, size):
            mine = [(k, *g) for k in range(n) for g in found.get(at + k, ())]
            at += n
            if mine:
                numbers = np.array([g[:4] for g in mine], "<i4")
                out.append((r["file"], r["path"], r["slice"], r["bucket"], 2, numbers.tobytes(), b"".join(g[4] for g in mine), None))
        return chunks.message_table(out)
    return run


OCCURRENCE = "group string, n_bytes int, doc_id long, start long, open_left boolean, open_right boolean"


def _occurrences(length: int, gram: int, buckets: int):
    """Every place of every group in the documents of a file, slice by slice."""
    def run(table: pa.Table) -> pa.Table:
        shared, groups = _by_slice(table, 1), _by_slice(table, 2)
        path = table.column("path")[0].as_py()
        out: list[tuple] = []
        for number, _, piece in chunks.read_slices(path):
            if number not in groups:
                continue
            s = Slice(piece, length, gram, buckets)
            pick, context, lead, _ = s.contexts(s.marked(shared[number]), length, gram)
            order = np.argsort(context, kind="stable")
            edge = np.searchsorted(context[order], np.arange(len(lead) + 1))
            begin = {bucket: a for bucket, a, _ in chunks.bucket_ranges(s.bucket[s.group[lead]])}
            for r in groups[number]:
                numbers = np.frombuffer(r["data"], "<i4").reshape(-1, 4)
                for g, (k, back, depth, open_) in enumerate(numbers.tolist()):
                    name = r["more"][16 * g: 16 * g + 16].hex()
                    c = begin[r["bucket"]] + k
                    for i in pick[order[edge[c]: edge[c + 1]]].tolist():
                        doc = s.doc[i]
                        out.append((name, back + depth, piece.column(0)[int(doc)].as_py(), int(s.at[i] - s.off[doc] - back), bool(open_ & 1), bool(open_ & 2)))
        return pa.Table.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(
            (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))], names=[x.split()[0] for x in OCCURRENCE.split(", ")])
    return run


def _cover(length: int, gram: int, buckets: int):
    names = [x.split()[0] for x in RESULT.split(", ")]
    types = [pa.int64() if x.split()[1] == "long" else pa.string() for x in RESULT.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        shared, masks = _by_slice(table, 1), _by_slice(table, 2)
        path = table.column("path")[0].as_py()
        out = []
        for number, _, piece in chunks.read_slices(path):
            n_docs = piece.num_rows
            if number in shared:
                s = Slice(piece, length, gram, buckets)
                data, off = s.data, s.off
                pick, context, lead, rows = s.contexts(s.marked(shared[number]), length, gram)
                mask = np.zeros(len(lead), np.int64)
                by = {r["bucket"]: r for r in masks.get(number, ())}
                for bucket, a, b in chunks.bucket_ranges(s.bucket[s.group[lead]]):
                    if bucket in by:
                        mask[a:b] = chunks.unpack(by[bucket]["data"], "<i8")
                least = np.full(len(lead), np.iinfo(np.int64).max)
                ids = s.ids[s.doc[pick]]
                np.minimum.at(least, context, ids)
                own = np.where(ids > least[context], (1 << (length - gram + 1)) - 1, mask[context])
                gone = np.zeros(len(data) + 1, bool)
                for j in range(length - gram + 1):
                    back = length - gram - j
                    hit = ((own >> j) & 1 == 1) & (rows[context, -2] >= back) & (rows[context, -1] >= length - back)
                    gone[s.at[pick[hit]] - back] = True
                start = np.flatnonzero(gone)
                edge = np.zeros(len(data) + 1, np.int32)
                edge[start] += 1
                edge[start + length] -= 1
                removed = np.cumsum(edge[:-1]) > 0
            else:
                data, off = text_buffer(piece.column(1))
                removed = np.zeros(len(data), bool)
            total = np.concatenate([[0], np.cumsum(removed)])[off]
            rise = removed.copy()
            rise[1:] &= ~removed[:-1]
            head = off[:-1][off[:-1] < off[1:]]
            rise[head] = removed[head]
            spans = np.concatenate([[0], np.cumsum(rise)])[off]
            kept = data[~removed].tobytes()
            cut = (off - total).tolist()
            out.append(pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip((
                    piece.column(0).cast(pa.int64()), np.diff(off), np.diff(total), np.diff(spans),
                    [hashlib.sha256(kept[cut[d]: cut[d + 1]]).hexdigest() for d in range(n_docs)]), types)], names=names))
        return pa.Table.from_batches(out, schema=pa.schema(list(zip(names, types))))
    return run


def _shared_anchors(spark: SparkSession, docs: DataFrame, length: int, gram: int, bucket_bytes: int, within: bool = False) -> tuple[chunks.Store, DataFrame, DataFrame]:
    """The store, the answers which anchors of a slice are shared, and the contexts of those."""
    store = chunks.Store(spark, docs, bucket_bytes)
    args = (length, gram, store.buckets)
    answers = scratch_path(spark, "shared-anchors")
    store.tasks().mapInArrow(_send_anchors(*args, within), chunks.MESSAGE).groupBy("bucket").applyInArrow(_shared, chunks.MESSAGE).write.parquet(answers)
    shared = spark.read.parquet(answers)
    return store, shared, shared.groupBy("file").applyInArrow(_send_contexts(*args), chunks.MESSAGE)


def repeat_groups(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_bytes: int = chunks.BUCKET_BYTES) -> DataFrame:
    """The maximal repeats of at least ``length`` bytes, one row for each place: group, bytes, doc_id, first byte.

    A repeat is seen as far as the context of its anchor; ``open_left`` and ``open_right`` tell that it reaches that end and may go
    on there (the next anchor's group overlaps it). Rows of a group are all places where its bytes occur, in one document or several;
    equal places of rows with equal doc_id are one.
    """
    store, shared, contexts = _shared_anchors(spark, docs, length, gram, bucket_bytes, within=True)
    groups = contexts.groupBy("bucket").applyInArrow(_context_groups(length, gram), chunks.MESSAGE)
    places = shared.unionByName(groups).groupBy("file").applyInArrow(_occurrences(length, gram, store.buckets), OCCURRENCE)
    found = places.groupBy("group", "n_bytes", "doc_id", "start").agg(F.bool_or("open_left").alias("open_left"), F.bool_or("open_right").alias("open_right"))
    # a context that one place alone has is no repeat
    several = found.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("group")
    return found.join(several, "group", "left_semi")


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                   bucket_bytes: int = chunks.BUCKET_BYTES) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs, digest of the kept bytes."""
    store, shared, contexts = _shared_anchors(spark, docs, length, gram, bucket_bytes)
    args = (length, gram, store.buckets)
    masks = contexts.groupBy("bucket").applyInArrow(_trees(length, gram), chunks.MESSAGE)
    none = [F.lit(None).cast(t).alias(n) for n, t in (("slice", "int"), ("bucket", "long"))]
    every = store.files.select("file", "path", *none, F.lit(0).alias("kind"), *[F.lit(None).cast("binary").alias(c) for c in ("data", "more", "ids")])
    return every.unionByName(shared).unionByName(masks).groupBy("file").applyInArrow(_cover(*args), RESULT)

"""A chunk store: a table's texts as files in the shared folder, and bucketed exchange of sorted hashes.

Operators that look at the texts several times write them once, without a shuffle, as
Parquet files below ``spark.checkpoint.dir``. A task then reads a file by its path, cuts it into
slices that depend on the file alone, and finds the same places again in a later pass. Between the
passes only hashes travel: for each slice its distinct hashes, sorted, cut into buckets by their
leading bits and packed as bytes. Each hash is sent once a slice however often it occurs, so a
passage that a third of all documents share is one entry a slice in its bucket. The number of buckets grows with the table,
so that a bucket holds the hashes of about ``BUCKET_BYTES`` of text at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfage.llm.common import U64, filesystem, slices
from shelfage.session import scratch_path

CHUNK_ROWS = 8192
CHUNK_SLICE = (4 << 20) - 16
BUCKET_BYTES = 16 << 20
NULL_ID = -(1 << 63)     # a null doc_id stands before all others


class Store:
    """The files of a chunk store; ``files``: file number, path; ``buckets``: how many hash buckets it asks for."""

    def __init__(self, spark: SparkSession, docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, columns: tuple[str, ...] = ("doc_id", "text")):
        self.spark = spark
        self.folder = scratch_path(spark, "chunks")
        docs.select(*columns).write.option("compression", "zstd").option("maxRecordsPerFile", CHUNK_ROWS).parquet(self.folder)
        self.files, self.count = files_of(spark, self.folder)
        size = spark.read.parquet(self.folder).agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.buckets = size // bucket_bytes + 1

    def tasks(self) -> DataFrame:
        """One row per file, each in a task of its own."""
        return self.files.repartition(max(1, self.count), "file")


def files_of(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """(file number, path) of the Parquet files of a written table, and how many there are."""
    fs, root = filesystem(folder)
    names = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".parquet"))
    return spark.createDataFrame([(i, f"{folder}/{name}") for i, name in enumerate(names)], "file int, path string"), len(names)


def read_slices(path: str) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(slice number, first row, rows) of a file, the same at each reading."""
    fs, p = filesystem(path)
    number, row = 0, 0
    with fs.open_input_file(p) as f:
        for batch in pq.ParquetFile(f).iter_batches(batch_size=4096, columns=["doc_id", "text"]):
            for piece in slices(batch, limit=CHUNK_SLICE):
                yield number, row, piece
                number, row = number + 1, row + piece.num_rows


def doc_ids(piece: pa.RecordBatch) -> np.ndarray:
    return piece.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


# ---------------------------------------------------------------- buckets of sorted hashes
def bucketed(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit rest of hashes; sorted hashes give sorted (bucket, rest)."""
    b = U64(buckets)
    t = (h >> U64(32)) * b + (((h & U64(0xFFFFFFFF)) * b) >> U64(32))
    return (t >> U64(32)).astype(np.int64), (t & U64(0xFFFFFFFF)).astype(np.uint32)


def bucket_ranges(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of a sorted bucket array."""
    if len(bucket):
        edge = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(bucket)]):
            yield int(bucket[a]), a, b


def pack(values: np.ndarray, sorted_values: bool = False) -> bytes:
    """Bytes of an integer array, the bytes of equal weight together (the shuffle's compression then finds the even ones)."""
    if sorted_values and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unpack(raw: bytes, dtype, sorted_values: bool = False) -> np.ndarray:
    dtype = np.dtype(dtype)
    n = len(raw) // dtype.itemsize
    values = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).reshape(n)
    return np.cumsum(values, dtype=dtype) if sorted_values else values


#: What travels to the buckets and back. ``kind`` tells the messages apart where several kinds meet.
MESSAGE = "file int, path string, slice int, bucket long, kind int, data binary, more binary, ids binary"
_TYPES = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
_NAMES = [x.split()[0] for x in MESSAGE.split(", ")]


def messages(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], names=_NAMES)


def message_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([messages(rows)])


def repeated(table: pa.Table) -> pa.Table:
    """For the entries (``data``: sorted rests) of one bucket: a bit for each that another slice has too, sent back to its slice."""
    rows = table.to_pylist()
    parts = [unpack(r["data"], "<u4", True) for r in rows]
    every = np.concatenate(parts)
    values, count = np.unique(every, return_counts=True)
    again = values[count > 1]
    out = []
    for r, part in zip(rows, parts):
        at = np.minimum(np.searchsorted(again, part), max(len(again) - 1, 0))
        hit = again[at] == part if len(again) else np.zeros(len(part), bool)
        if hit.any():
            out.append((r["file"], r["path"], r["slice"], r["bucket"], 1, np.packbits(hit).tobytes(), None, None))
    return message_table(out)


def bits_of(message: dict, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(message["data"], np.uint8), count=n).astype(bool)

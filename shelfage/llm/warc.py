"""Deterministic sharded WARC writer and reader.

``cut_points`` cuts the page_id order into shards of about ``shard_bytes`` payload bytes: exact running sums over
(id, bytes) rows sorted by range, so that the cuts are a function of the table alone, however its ids are spread. The cuts,
one id per shard (8 bytes for ``shard_bytes`` of payload), are written to the shared folder and looked up by the tasks. Every
page goes once through the shuffle, to the task of its shard; the row that names its response (from a slim
aggregate over digests) goes with it and sorts before it, so no payload is joined. A task writes its shard in
page_id order as gzip members, starts a new file when the compressed size
passes ``roll_bytes``, writes to temporary names, renames, and returns manifest rows;
the manifest (written by Spark, with its commit) alone says which files count. A task that runs
again writes equal bytes to equal names; what failed attempts left is removed after the commit. Rows of one page_id
(or of none) are not cut: they share a shard.

Of records with equal payloads of at least ``min_revisit_bytes`` bytes the largest page_id
is the response and the others are revisits of it.

Defined cases: null html is an empty payload; rows with equal page_id and
payload are all responses when their id is the largest of the group; rows with a null page_id are
responses unless a row with an id has the same payload, and sort first; a null url gives the target
urn:page:<id>; an empty table gives an archive without files; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfage.llm.common import commit_file, filesystem, giving_back
from shelfage.session import scratch_path

TASKS = 100_000         # that write or read files; with more shards or files a task takes several
SHARD_BYTES = 64 << 20
ROLL_BYTES = 16 << 20
DATE = "2001-01-01T00:00:00Z"   # a fixed date keeps the archive a function of its input
TEMPORARY = "_temporary"        # folder of files that are being written
NO_ID = -(1 << 63)              # sort position of rows without an id

MANIFEST = "path string, shard long, seq int, records long, bytes long, first_id long, last_id long"
RECORD = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
          "verified boolean, path string, offset long")


def _id():
    return F.coalesce(F.col("page_id"), F.lit(NO_ID))


def cut_points(spark: SparkSession, pages: DataFrame, shard_bytes: int) -> tuple[str, int]:
    """The smallest id of each shard as a table in the shared folder, and the number of shards."""
    size = F.coalesce(F.octet_length("html"), F.lit(0)) + 256
    slim, cuts = scratch_path(spark, "warc-sizes"), scratch_path(spark, "warc-cuts")
    pages.groupBy(_id().alias("id")).agg(F.sum(size).cast("long").alias("bytes")).repartitionByRange("id") \
        .withColumn("part", F.spark_partition_id()).write.parquet(slim)
    ids = spark.read.parquet(slim)
    # one row per range of ids
    ranges = ids.groupBy("part").agg(F.min("id").alias("low"), F.sum("bytes").alias("all"))
    base = (F.sum("all").over(Window.orderBy("low")) - F.col("all")).alias("base")
    before = F.sum("bytes").over(Window.partitionBy("part").orderBy("id")) - F.col("bytes") + F.col("base")
    ids.join(ranges.select("part", base), "part").select("id", F.floor(before / F.lit(shard_bytes)).alias("cut")) \
        .groupBy("cut").agg(F.min("id").alias("first_id")).select("first_id").write.parquet(cuts)
    return cuts, spark.read.parquet(cuts).count()


@lru_cache(maxsize=1)
def _first_ids(cuts: str) -> np.ndarray:
    fs, root = filesystem(cuts)
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet")]
    return np.sort(np.concatenate([np.zeros(0, np.int64)] + [pq.read_table(f, filesystem=fs).column(0).to_numpy() for f in files]))


def _shard_of(cuts: str):
    """Column function: the number of the shard of an id."""
    @F.pandas_udf("long")
    def shard(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(_first_ids(cuts), ids.to_numpy(), side="right") - 1)
    return shard


def responses(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """(page_id, refers_to) of the pages that revisit another one; slim rows, digests pre-aggregated before the shuffle."""
    slim = pages.select("page_id", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("digest"),
                        F.coalesce(F.octet_length("html"), F.lit(0)).alias("size")).where(F.col("size") >= min_revisit_bytes)
    best = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")) \
        .where("n > 1").select(F.col("digest").alias("d"), "refers_to")
    out = slim.join(best, F.col("digest") == F.col("d"))
    return out.where(F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to"))) \
        .select("page_id", "refers_to", "digest")


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record with regenerated headers and digests, as a gzip member."""
    target = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    body = b"" if refers_to is not None else payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"),
            ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{_digest(payload)}"),
            ("WARC-Block-Digest", f"sha1:{_digest(body)}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text.encode() + body + b"\r\n\r\n") + z.flush()


def _writer(folder: str, roll_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        done: list[tuple] = []
        out, shard, seq = None, None, 0

        def close():
            nonlocal out
            if out is not None:
                stream, temporary, records, size, first, last = out
                stream.close()
                final = f"{root}/shard-{shard:08d}-{seq:05d}.warc.gz"
                commit_file(fs, temporary, final)
                done.append((final, shard, seq, records, size, first, last))
            out = None

        answer: tuple[int | None, bytes | None, int | None] = (None, None, None)
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(n)) for n in ("shard", "page_id", "tag", "url", "html", "refers_to", "digest")]
            for i in range(batch.num_rows):
                sh, pid, tag = (c[i].as_py() for c in cols[:3])
                if tag == 0:  # the response of the page that follows
                    answer = (pid, cols[6][i].as_py(), cols[5][i].as_py())
                    continue
                payload = (cols[4][i].as_py() or "").encode()
                refers = answer[2] if answer[0] == pid and answer[2] is not None and \
                    hashlib.sha1(payload).hexdigest() == answer[1] else None
                if sh != shard or out is not None and out[3] >= roll_bytes:
                    close()
                    seq = seq + 1 if sh == shard else 0
                    shard = sh
                if out is None:
                    temporary = f"{root}/{TEMPORARY}/{uuid.uuid4().hex}"
                    out = [fs.open_output_stream(temporary), temporary, 0, 0, pid, pid]
                data = record_bytes(pid, cols[3][i].as_py(), payload, refers)
                out[0].write(data)
                out[2:] = [out[2] + 1, out[3] + len(data), out[4], pid]
        close()
        names = ["path", "shard", "seq", "records", "bytes", "first_id", "last_id"]
        types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(types)], names=names)
    return write


def write_archive(spark: SparkSession, pages: DataFrame, folder: str, min_revisit_bytes: int = 0,
                  shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the pages below ``folder`` and returns the committed manifest."""
    fs, root = filesystem(folder)
    fs.create_dir(f"{root}/{TEMPORARY}", recursive=True)
    pages = pages.select("page_id", "url", "html")
    cuts, n_shards = cut_points(spark, pages, shard_bytes)
    rows = pages.select("page_id", F.lit(1).alias("tag"), "url", "html",
                        F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("digest"))
    # several answers for one page_id (equal ids, different payloads) sort next to their payloads by digest
    answers = responses(pages, min_revisit_bytes).distinct().select(
        "page_id", F.lit(0).alias("tag"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("html"), "refers_to", "digest")
    rows = rows.withColumn("digest", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    tasks = max(1, min(n_shards, TASKS))
    dealt = rows.unionByName(answers).withColumn("shard", _shard_of(cuts)(_id())) \
        .repartitionById(tasks, F.floor(F.col("shard") * tasks / max(1, n_shards)).cast("int")) \
        .sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "tag", "url")
    manifest = f"{folder.rstrip('/')}/manifest"
    dealt.mapInArrow(giving_back(_writer(folder, roll_bytes)), MANIFEST).write.parquet(manifest)
    fs.delete_dir(f"{root}/{TEMPORARY}")
    return spark.read.parquet(manifest)


def _members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the gzip members of a file, read as a stream."""
    z, parts, offset, size, data = zlib.decompressobj(31), io.BytesIO(), 0, 0, b""
    while True:
        data = data or stream.read(chunk)
        if not data:
            if size:
                raise ValueError("the archive ends within a record")
            return
        parts.write(z.decompress(data))
        size += len(data) - len(z.unused_data)
        data = z.unused_data
        if z.eof:
            yield offset, parts.getvalue()
            offset += size
            z, parts, size = zlib.decompressobj(31), io.BytesIO(), 0


def _urn(value: bytes | None) -> int | None:
    text = (value or b"").strip(b"<>").rpartition(b":")[2]
    return None if text in (b"", b"None") else int(text)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, p = filesystem(path)
            rows: list[tuple] = []
            with fs.open_input_stream(p, compression=None) as stream:
                for offset, content in _members(stream):
                    head, _, rest = content.partition(b"\r\n\r\n")
                    h = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
                    body = rest[: int(h[b"Content-Length"])]
                    digest = h[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
                    kind, n = h[b"WARC-Type"].decode(), int(h[b"X-Payload-Length"])
                    ok = h[b"WARC-Block-Digest"].decode() == f"sha1:{_digest(body)}" and \
                        (kind == "revisit" or (digest == _digest(body) and n == len(body)))
                    if not ok:
                        raise ValueError(f"a digest in {path} at {offset} does not hold")
                    rows.append((_urn(h[b"WARC-Record-ID"]), n, digest, kind, _urn(h.get(b"WARC-Refers-To")), ok, path, offset))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def read_archive(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per record of the files that the manifest names; every digest is recomputed and checked."""
    return manifest.select("path").repartitionByRange(max(1, min(manifest.count(), TASKS)), "path").mapInArrow(giving_back(_reader), RECORD)


def roundtrip(spark: SparkSession, pages: DataFrame, **kw) -> DataFrame:
    folder = scratch_path(spark, "warc")
    return read_archive(spark, write_archive(spark, pages, folder, **kw))

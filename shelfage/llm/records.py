"""Token-ID output: length-delimited binary records with masked checksums and a separate offset index.

Documents are range-partitioned and sorted by doc_id; each task encodes its
texts and writes ``part-k.tok`` and ``part-k.idx``. A record is

    length (uint64) | masked crc of the length (uint32) | data | masked crc of the data (uint32)

with data = flags (uint8: 1 if doc_id is null, 2 if ids are 16-bit) | doc_id (int64) | ids. The mask
rotates the CRC-32 and adds a constant, so that a checksum of data holding checksums stays useful. The index
holds (offset uint64, tokens uint64) per record: a shuffled reader seeks by it. Files are written
under temporary names, renamed, and listed in a manifest that Spark commits.

Encoding: each distinct part of the texts in a slice is encoded once; nothing is kept between slices. A cut
at ASCII white space, and between an ASCII letter or digit or a letter U+00C0 to U+00FF and an ASCII sign other
than the apostrophe, never changes the ids: the tokenizer drops white space, its pattern ends
a letter run there and no normal form joins across. Runs of these letters alone are in normal form, so that lower-casing
them is all that the normalizer would do. This holds for the normalizer and pattern of the default tokenizer; a file with
others is detected, and its texts are encoded whole, as are texts with "<|" (which may be special tokens).

Defined cases: null text is empty (only the end id); a null doc_id sorts first; rows with equal doc_id
follow each other in the order of a hash of the text; an empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfage.llm.common import commit_file, filesystem, giving_back, slices, space_words, text_buffer, token_bounds
from shelfage.session import scratch_path

END_ID = 1
READERS = 10_000            # tasks that read files back
MANIFEST = "part int, path string, index_path string, records long, tokens long, first_id long, last_id long"
RECORD = "doc_id long, start long, n_tokens long, ids_crc32 long, path string, offset long"
SLICE_BYTES = 4 << 20       # texts encoded together
STRING_BYTES = 1 << 16      # letter runs handed to the model in one string
_MASK = 0xA282EAD8
_WORD = space_words()

_SIGN = np.zeros(256, dtype=bool)   # ASCII signs that end a run of letters or a digit; not the apostrophe
_SIGN[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), 0x7B, 0x7D, 0x7E]] = True

# The parts of a tokenizer file that the cuts and the lower-casing below rely on.
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_WORD_END = "</w>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _latin_letters(data: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of the letters U+00C0 to U+00FF (lead byte 0xC3)."""
    low = data | 0x20
    letters = (low >= 0x61) & (low <= 0x7A)
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]    # multiplication and division sign
    letters[lead] = letters[lead + 1] = True
    return letters


def _lowered(data: np.ndarray) -> np.ndarray:
    """The same bytes with A-Z and the capital letters U+00C0 to U+00DE as small letters; for bytes of ``_latin_letters`` only."""
    out = np.where(data < 0x80, data | 0x20, data)
    second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] < 0x9F)) + 1
    out[second] += 0x20
    return out


class Encoder:
    """Ids of texts, as arrays of unsigned 32-bit integers.

    With a tokenizer file of the known normalizer and pattern every distinct part of a column is encoded once, and
    all letter runs of ASCII and Latin-1 go to the model in a few long strings; with any other file, texts are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.by_parts = self._known(json.loads(self.tokenizer.to_str()))
        if self.by_parts:
            # letter runs are lower-cased and cut already: white space parts them, the model does the rest
            self.runs = Tokenizer(self.tokenizer.model)
            self.runs.normalizer = normalizers.Sequence([])
            self.runs.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(1 << 20 if self.wide else 1 << 16, dtype=bool)
            self.last[[i for token, i in self.runs.get_vocab().items() if token.endswith(_WORD_END)]] = True

    @staticmethod
    def _known(spec: dict) -> bool:
        model = spec["model"]
        return (spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _PRE_TOKENIZER and model["type"] == "BPE"
                and model["end_of_word_suffix"] == _WORD_END and not model["dropout"] and not model["continuing_subword_prefix"]
                and all(x["content"].startswith("<|") for x in spec["added_tokens"])
                and max(model["vocab"].values()) < 1 << 20
                and all(f"{_byte_char(b)}{_WORD_END}" in model["vocab"] and _byte_char(b) in model["vocab"] for b in range(256)))

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letter_runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case letter runs, one after the other, and how many each has: a run's last token alone ends a word."""
        ends = np.cumsum(pc.binary_length(runs).to_numpy() + 1)
        strings, at = [], 0
        while at < len(runs):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STRING_BYTES, side="right")))
            some = runs.slice(at, to - at)
            strings.append(pc.binary_join(pa.LargeListArray.from_arrays([0, len(some)], some).cast(pa.list_(pa.binary())), b" ")[0].as_py().decode())
            at = to
        ids = np.concatenate([np.zeros(0, "<u4")] + [np.array(e.ids, dtype="<u4") for s in strings
                                                     for e in self.runs.encode_batch_fast([s], add_special_tokens=False)])
        stops = np.flatnonzero(self.last[ids]) + 1
        if len(stops) != len(runs) or (len(stops) and stops[-1] != len(ids)):
            raise ValueError("the tokenizer's model does not end each run of letters once")
        return ids, np.diff(stops, prepend=0)

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a column. Every distinct part of the column is encoded once; the ids are then gathered as arrays."""
        if not self.by_parts:
            return self._whole(pc.fill_null(column, "").to_pylist())
        data, off = text_buffer(column)
        starts, ends, _ = token_bounds(data, off, _WORD)
        letters = _latin_letters(data)
        digit = (data >= 0x30) & (data <= 0x39)
        cut = np.flatnonzero(_SIGN[data[1:]] & (letters | digit)[:-1]) + 1
        cut = cut[~np.isin(cut, off, assume_unique=False)] if len(off) > 2 else cut
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        before = np.searchsorted(starts, off)
        edge = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=edge[1:])
        word = _WORD[data]
        data, letters = data[word], letters[word]
        run = np.add.reduceat(letters, edge[:-1], dtype=np.int64) == ends - starts if len(starts) else np.zeros(0, bool)
        data = np.where(np.repeat(run, ends - starts), _lowered(data), data)
        parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edge), pa.py_buffer(data)]).dictionary_encode()
        every, which = parts.dictionary, parts.indices.to_numpy()
        is_run = np.zeros(len(every), dtype=bool)
        is_run[which] = run
        flat, length = self._letter_runs(every.filter(pa.array(is_run)))
        other = self._whole([x.decode() for x in every.filter(pa.array(~is_run)).to_pylist()])
        n_ids = np.zeros(len(every), np.int64)
        n_ids[is_run], n_ids[~is_run] = length, [len(x) for x in other]
        first = np.zeros(len(every), np.int64)
        first[is_run] = np.cumsum(length) - length
        first[~is_run] = len(flat) + np.cumsum(n_ids[~is_run]) - n_ids[~is_run]
        flat = np.concatenate([flat, *other])
        n = n_ids[which]
        total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        ids = flat[np.arange(total[-1]) + np.repeat(first[which] - total[:-1], n)]
        place = total[before]
        out = [ids[x:y] for x, y in zip(place[:-1], place[1:])]
        for i in np.flatnonzero(pc.fill_null(pc.match_substring(column, "<|"), False).to_numpy(zero_copy_only=False)):
            out[i] = self._whole([column[int(i)].as_py()])[0]
        return out


def _byte_char(byte: int) -> str:
    """The character that stands for a byte in a byte-level vocabulary: itself where printable, else 256 and up in order."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return chr(byte) if byte in kept else chr(256 + byte - sum(k < byte for k in kept))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder; one tokenizer at a time."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return b"".join((length, struct.pack("<I", masked_crc(length)), data, struct.pack("<I", masked_crc(data))))


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, root = filesystem(folder)
        enc = encoder(tokenizer)
        temporary = f"{root}/_temporary-{uuid.uuid4().hex}"
        data, index, offset, records, tokens, first, last = None, [], 0, 0, 0, None, None
        width = "<u4" if enc.wide else "<u2"
        end = np.array([end_id], width).tobytes()
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                ids = piece.column(0).to_pylist()
                if data is None:
                    data, first = fs.open_output_stream(temporary), ids[0]
                out = []
                for doc_id, some in zip(ids, enc.encode(piece.column(1))):
                    rec = frame(struct.pack("<Bq", (doc_id is None) + 2 * (not enc.wide), doc_id or 0) + some.astype(width).tobytes() + end)
                    index.append((offset, len(some) + 1))
                    offset += len(rec)
                    tokens += len(some) + 1
                    out.append(rec)
                data.write(b"".join(out))
                records, last = records + len(ids), ids[-1]
        rows = []
        if data is not None:
            data.close()
            with fs.open_output_stream(f"{temporary}-idx") as f:
                f.write(np.asarray(index, dtype="<u8").tobytes())
            path = f"{root}/part-{part:06d}"
            commit_file(fs, f"{temporary}-idx", f"{path}.idx")
            commit_file(fs, temporary, f"{path}.tok")
            rows = [(part, f"{path}.tok", f"{path}.idx", records, tokens, first, last)]
        types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)
    return write


def write_records(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the encoded documents below ``folder``; returns the committed manifest, one row per file."""
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")) \
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    manifest = f"{folder.rstrip('/')}/manifest"
    ordered.mapInArrow(giving_back(_writer(folder, tokenizer or default_tokenizer(), end_id)), MANIFEST).write.parquet(manifest)
    return spark.read.parquet(manifest)


def read_ids(path: str, offset: int, stream=None) -> tuple[int | None, np.ndarray]:
    """The record at an offset (a shuffled read); both checksums are checked."""
    if stream is None:
        fs, p = filesystem(path)
        with fs.open_input_file(p) as f:
            f.seek(offset)
            return read_ids(path, offset, f)
    head = stream.read(12)
    length = struct.unpack("<Q", head[:8])[0]
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked_crc(head[:8]):
        raise ValueError(f"the length at {offset} of {path} is damaged")
    body = stream.read(length + 4)
    if len(body) < length + 4 or struct.unpack("<I", body[length:])[0] != masked_crc(body[:length]):
        raise ValueError(f"the record at {offset} of {path} is damaged")
    flags, doc_id = struct.unpack_from("<Bq", body)
    ids = np.frombuffer(body, "<u2" if flags & 2 else "<u4", offset=9, count=(length - 9) // (2 if flags & 2 else 4))
    return (None if flags & 1 else doc_id), ids.astype("<u4")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names =[x.split()[0] for x in RECORD.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        for path, index_path, base in zip(*(batch.column(k).to_pylist() for k in range(3))):
            fs, p = filesystem(index_path)
            with fs.open_input_stream(p) as f:
                index = np.frombuffer(f.read(), dtype="<u8").reshape(-1, 2)
            fs, p = filesystem(path)
            rows, start = [], base
            with fs.open_input_stream(p, buffer_size=1 << 20) as f:
                for offset, n in index.tolist():
                    doc_id, ids = read_ids(path, offset, f)
                    if len(ids) != n:
                        raise ValueError(f"the index of {path} does not fit its data")
                    rows.append((doc_id, start, n, zlib.crc32(ids.tobytes()), path, offset))
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per record: doc_id, start (ids before it in the whole order), number and CRC-32 of its ids, place.

    The running sum is over the manifest, one row per file. As many tasks as files read, up to ``READERS``; a manifest of a
    few rows would otherwise become one task.
    """
    base = F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")
    files = manifest.select("path", "index_path", base.alias("base"))
    return files.repartitionByRange(max(1, min(manifest.count(), READERS)), "path").mapInArrow(giving_back(_reader), RECORD)


def roundtrip(spark: SparkSession, docs: DataFrame, **kw) -> DataFrame:
    return read_records(spark, write_records(spark, docs, scratch_path(spark, "records"), **kw))

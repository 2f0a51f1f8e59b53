"""Language identification with bit-sliced Bloom filters of character n-grams.

One table serves all languages: slot -> bit mask of languages (64 to a word). Adding an
n-gram of a language sets its bit in ``HASHES`` slots; the AND of an n-gram's slots is the
set of languages that contain it, by one lookup for all of them. A text's n-grams are looked
up together; the hits of each language are counted, corrected for the language's
false-positive rate (its filter's fill to the power of ``HASHES``) and the largest
corrected share decides, ties going to the smaller language name.

Training reads at most about ``sample_docs`` documents of each language (those with the smallest
hashed ids; a documented bound) and keeps the n-grams that at least ``min_docs`` of them contain and whose
document frequency is not clearly higher in another language (``ratio``), so that
passages quoted from another language do not enter a filter. The slot masks are OR-ed
in Spark; the model is bounded by ``SLOTS`` words a 64 languages, whatever the corpus.

Defined cases: null text, or a text without a letter, is ``und`` with score 0; with no labelled row
every text is ``und``; a null doc_id is not held out and not learned from; empty tables
give empty results; other columns are ignored; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfage.llm.common import U64, giving_back, mix, slices, text_buffer

N = 5                   # bytes of an n-gram
HASHES = 3
SLOTS = 1 << 20
SAMPLE_DOCS = 4000
MIN_DOCS = 3
RATIO = 4
UNKNOWN = "und"
SLICE_BYTES = 1 << 19     # texts looked up together: their n-grams take some hundred bytes a byte

# ASCII signs, digits and controls count as spaces
_TABLE = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _normal(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, a space before and after each, and their offsets."""
    texts = [b" " + (t or "").lower().encode().translate(_TABLE) + b" " for t in column.to_pylist()]
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return np.frombuffer(b"".join(texts), np.uint8), off


def _grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams without two spaces in a row, and the document of each."""
    n = len(data) - N + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    x = np.zeros(n, U64)
    for k in range(N):
        x |= data[k: k + n].astype(U64) << U64(8 * k)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    ok = off[doc + 1] >= np.arange(n) + N
    space = data == 32
    double = space[:-1] & space[1:]
    for k in range(N - 1):
        ok &= ~double[k: k + n]
    return mix(x[ok]), doc[ok]


def _slots(h: np.ndarray, k: int) -> np.ndarray:
    return ((h >> U64(20 * k)) & U64(SLOTS - 1)).astype(np.int64)


def _sample_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, docs): document counts within a slice."""
    for batch in batches:
        for piece in slices(batch, limit=SLICE_BYTES):
            langs = np.asarray(piece.column(1).to_pylist(), dtype=object)
            h, doc = _grams(*_normal(piece.column(0)))
            for lang in sorted(set(langs)):
                mine = np.flatnonzero(langs == lang)
                at = np.isin(doc, mine)
                # one of each (document, gram)
                order = np.lexsort((h[at], doc[at]))
                hs, ds = h[at][order], doc[at][order]
                first = np.ones(len(hs), bool)
                first[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
                grams, count = np.unique(hs[first], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(count.astype(np.int64))],
                    names=["lang", "gram", "docs"])


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, sample_docs: int = SAMPLE_DOCS, min_docs: int = MIN_DOCS,
          ratio: int = RATIO) -> dict:
    """The filters learned from the labelled rows that are not held out: languages, slot masks, false-positive rates."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    words = (len(langs) + 63) // 64
    masks = np.zeros((words, SLOTS), U64)
    if langs:
        # a document is in the sample if its hashed id is among the smallest share of its language
        share = F.create_map(*[x for g in langs for x in (F.lit(g), F.lit(min(1.0, sample_docs / counts[g])))])
        pick = (F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20)) / F.lit(1 << 20)) < F.element_at(share, F.col("lang"))
        grams = (labelled.where(pick).select("text", "lang")
                 .mapInArrow(giving_back(_sample_grams), "lang string, gram long, docs long")
                 .groupBy("gram", "lang").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs))
        size = F.element_at(F.create_map(*[x for g in langs for x in (F.lit(g), F.lit(float(min(counts[g], sample_docs))))]), F.col("lang"))
        grams = grams.withColumn("rate", F.col("docs") / size)
        grams = grams.withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") * ratio >= F.col("top"))
        bit = F.element_at(F.create_map(*[x for i, g in enumerate(langs) for x in (F.lit(g), F.lit(i))]), F.col("lang"))
        slot = F.explode(F.array(*[F.shiftrightunsigned("gram", 20 * k).bitwiseAND(F.lit(SLOTS - 1)) for k in range(HASHES)]))
        rows = (grams.select(F.floor(bit / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("m"), slot.alias("slot"))
                .groupBy("word", "slot").agg(F.bit_or("m").alias("m")))
        table = rows.toArrow()  # at most SLOTS rows for 64 languages
        word, slot, m = (table.column(k).to_numpy() for k in range(3))
        masks[word, slot] = m.view(U64)
    false = np.array([np.count_nonzero(masks[i // 64] & U64(1 << (i % 64))) / SLOTS for i in range(len(langs))]) ** HASHES
    return {"langs": langs, "masks": masks, "false": false}


def scores(model: dict, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Best language (index, -1 for none) and its corrected share of n-grams for each text."""
    data, off = _normal(column)
    h, doc = _grams(data, off)
    n, langs = len(off) - 1, model["langs"]
    total = np.bincount(doc, minlength=n).astype(float)
    share = np.zeros((max(1, len(langs)), n))
    at = [_slots(h, k) for k in range(HASHES)]
    for w, table in enumerate(model["masks"]):
        hit = table[at[0]]
        for a in at[1:]:
            hit &= table[a]
        some = hit != 0
        hit, of = hit[some], doc[some]
        for i in range(64 * w, min(len(langs), 64 * w + 64)):
            raw = np.bincount(of[(hit >> U64(i - 64 * w)) & U64(1) != 0], minlength=n)
            f = model["false"][i]
            share[i] = np.clip((raw - total * f) / (1 - f) / np.maximum(total, 1), 0, 1) if f < 1 else 0
    best = share.argmax(axis=0)
    return best, share[best, np.arange(n)]


def _decided(model: dict, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of each text's language (that of the languages: unknown) and its score."""
    best, score = scores(model, texts)
    letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], dtype=bool)
    known = letters & bool(model["langs"])
    return np.where(known, best, len(model["langs"])), np.where(known, score, 0.0)


def predict(spark: SparkSession, docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """``keep`` columns, lang_pred and score of every document, from its text alone."""
    cast = spark.sparkContext.broadcast(model)  # bounded: SLOTS words a 64 languages
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array([*cast.value["langs"], UNKNOWN], dtype=object)
        for batch in batches:
            for piece in slices(batch, "_text", SLICE_BYTES):
                best, score = _decided(cast.value, piece.column(piece.schema.get_field_index("_text")))
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(keep)], pa.array(langs[best], pa.string()), pa.array(score)], names=names)

    # the text goes to Python under a name of its own beside the columns to keep
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(giving_back(run), schema)


def identify(spark: SparkSession, docs: DataFrame, **kw) -> DataFrame:
    model = train(spark, docs, **kw)
    flat = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(spark, flat, model, ["doc_id", "held_out"])


def filtered(spark: SparkSession, docs: DataFrame, least: float = 0.1, **kw) -> DataFrame:
    """The documents with a language: those without a letter, or with under ``least`` of their n-grams in any, go."""
    cast = spark.sparkContext.broadcast(train(spark, docs, **kw))  # bounded: SLOTS words a 64 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unknown = len(cast.value["langs"])
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                best, score = _decided(cast.value, piece.column("text"))
                yield piece.filter(pa.array((best != unknown) & (score >= least)))

    # rows go to Python once and only the kept ones return
    return docs.mapInArrow(giving_back(run), docs.schema)

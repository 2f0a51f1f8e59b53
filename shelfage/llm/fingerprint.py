"""Document fingerprints: threshold-scaled sketches of word shingles.

DataFrame functions only. A text's shingles are its runs of ``SHINGLE`` words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; a text
of fewer words is one shingle). Each is hashed by the first 64 bits of its MD5, and every hash below ``FRACTION`` of the
hash range is retained, sorted. As the threshold is the same for all documents, a shingle is retained everywhere or
nowhere: the sketch of a union is the union of the sketches (``merged``), and the share of the smaller sketch found in the other
(``containment``) estimates how much of the smaller document the other one holds, however unequal their lengths are. A
sketch grows with its document, about one hash per ``1 / FRACTION`` words.

``edit_report`` compares each document with its edited text (the second half replaced by the beginning of the next
document, in descending order of doc_id) and with the next document. The order is found on (digest, length) rows alone: they are range-sorted
and written with their positions, so the neighbour of a row is the row one position before, and only the first row of each range looks up the
last row of the range before it. The texts travel once by a digest of the row, and once more as the heads that their
neighbours need. Nothing is gathered in one task but one row per range.

Defined cases: null text is empty; a text without words has an empty sketch; two empty sketches are alike (1), an empty one
and another are not (0); null doc_ids stand last; rows with equal doc_id stand in the order of their digest; rows with
equal doc_id and text are one document, so they have the same next one, and each of them gives a row; a single document is its own
next one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfage.session import scratch_path

SHINGLE = 5
FRACTION = 1 / 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), r"[\x20\x09-\x0D]+"), "")


def retained(words: Column, shingle: int = SHINGLE, fraction: float = FRACTION) -> Column:
    """The sorted distinct hashes below the fraction (at most a half, so that they are positive) of an array of words."""
    if not 0 < fraction <= 0.5:
        raise ValueError("the fraction of retained hashes lies above 0 and is 0.5 at most")
    below = f"{int(fraction * (1 << 64)):016x}"

    def hashes(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.lit(1)))
        digests = F.transform(places, lambda i: F.md5(F.concat_ws(" ", F.slice(w, i, shingle))))
        low = F.transform(F.filter(digests, lambda h: h < below), lambda h: F.conv(F.substring(h, 1, 16), 16, 10).cast("bigint"))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct(low)))

    # a variable of an outer function: the words are cut once, not once a shingle
    return F.get(F.transform(F.array(words), hashes), F.lit(0))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two documents together (sketches of one fraction and shingle)."""
    return F.array_sort(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """The share of the smaller sketch that the other one has, 0 to 1."""
    small = F.least(F.size(a), F.size(b))
    return F.when(F.greatest(F.size(a), F.size(b)) == 0, 1.0).when(small == 0, 0.0) \
        .otherwise(F.size(F.array_intersect(a, b)) / small)


def digits(hashes: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash, comma-joined."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), ",")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Per row: doc_id, n_chars and its hashes."""
    cut = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")) \
        .select("doc_id", F.char_length("text").cast("long").alias("n_chars"), words(F.col("text")).alias("words"))
    return cut.select("doc_id", "n_chars", retained(F.col("words"), shingle, fraction).alias("hashes"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(k, doc_id, text): k is a digest of the row, so equal rows share it."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))).alias("k"),
                       "doc_id", text.alias("text"))


def followers(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Which different document follows which in descending order of doc_id, the first one after the last: one row per
    document as the following one, with the digest and length of the document it follows, and how many equal rows it has."""
    path = scratch_path(spark, "fingerprint-order")
    rows = _keyed(docs).select("k", "doc_id", F.char_length("text").cast("long").alias("n"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("k")]
    rows.groupBy("k", "doc_id", "n").agg(F.count(F.lit(1)).alias("copies")) \
        .repartitionByRange(*order).sortWithinPartitions(*order) \
        .select("k", "n", "copies", F.monotonically_increasing_id().alias("pos")).write.parquet(path)
    placed = spark.read.parquet(path)
    # one row per range: its first place and the last place of the range before it (the last of all for the first)
    ranges = placed.groupBy(F.shiftright("pos", 33).alias("part")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    all_ranges = Window.orderBy("part")
    ends = ranges.select(F.col("first"), F.coalesce(
        F.lag("last").over(all_ranges),
        F.last("last").over(all_ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("end"))
    before = placed.join(ends, F.col("pos") == F.col("first"), "left").select("k", "copies", F.coalesce("end", F.col("pos") - 1).alias("before"))
    return before.join(placed.select(F.col("pos").alias("before"), F.col("k").alias("prev_k"), F.col("n").alias("prev_n")), "before") \
        .select("k", "copies", "prev_k", "prev_n")


def edit_report(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Per row: its sketch, the digest and sketch of its edited text, and its likeness to that text and to the next document."""
    link = followers(spark, docs)
    cut = _keyed(docs).withColumn("words", words(F.col("text")))
    rows = cut.select("k", "doc_id", "text", retained(F.col("words"), shingle, fraction).alias("hashes"))
    # equal rows are one from here on: a digest that a third of all rows share is one row a task before the shuffle
    rows = rows.groupBy("k").agg(*[F.first(c).alias(c) for c in ("doc_id", "text", "hashes")]).join(link, "k")
    following = rows.select(F.col("prev_k").alias("k"), F.left("text", (F.col("prev_n") / 2).cast("int")).alias("head"),
                            F.col("hashes").alias("next_hashes"), F.col("doc_id").alias("next_doc_id"))
    both = rows.select("k", "doc_id", "text", "hashes", "copies").join(following, "k")
    n = F.char_length("text")
    both = both.select("*", n.cast("long").alias("n_chars"), F.concat(F.left("text", n - (n / 2).cast("int")), F.col("head")).alias("edited"))
    both = both.withColumn("edited_words", words(F.col("edited")))
    both = both.select("doc_id", "n_chars", "hashes", "next_hashes", "next_doc_id", "copies", F.sha2("edited", 256).alias("edited_sha256"),
                       retained(F.col("edited_words"), shingle, fraction).alias("edited_hashes"))
    out = both.select(
        "doc_id", "n_chars", "edited_sha256", digits(F.col("hashes")).alias("fingerprint"), digits(F.col("edited_hashes")).alias("edited_fingerprint"),
        containment(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        containment(F.col("hashes"), F.col("next_hashes")).alias("near_next"), "next_doc_id",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy")

"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame operations only).

The tokens of the mix are dealt out as equal blocks of ``block`` words.
``apportion`` gives the integer number of blocks of each party (first the sources,
then the groups of shards of each source, then the shards of each group) by highest quotients value / (2 * seats + 1).
A shard then takes its quota in seeded order: its documents, ordered by a
seeded hash, are one cyclic stream of words, and ``quota * block`` words are
read from its start, so a document is read once per full turn and the last turn
stops in the middle of the stream.

Scale: the word counts are computed once and written as a slim table; only
(document, source, size) rows are shuffled. A source of any size is split into
shards of about ``shard_words`` words, so no window holds more than one shard.
Global windows run over one row per source (or five quotients per source) only; a source's seats are dealt to groups
of ``group_shards`` shards first, so that no window grows with the number of its shards.

Defined cases: null text has size 0 and is never taken; a null source is a source
of its own, last in order; repeated rows are documents of their own; an empty table
gives an empty result; other columns are ignored, also clashing ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfage.session import scratch_path

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 20
GROUP_SHARDS = 1 << 12
SEED = 20

_SPACE = r"[\x20\x09-\x0D]"


def word_count(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text: split pieces less the empty ones at both ends."""
    pieces = F.size(F.split(text, f"{_SPACE}+"))
    ends = F.when(text.rlike(rf"\A{_SPACE}"), 1).otherwise(0) + F.when(text.rlike(rf"{_SPACE}\z"), 1).otherwise(0)
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(pieces - ends).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source with its target: the whole shared by weight, capped at ``repeat`` times the source.

    Water filling in closed form: sorted by size / weight, the capped sources are a
    prefix; a source is capped when sharing the rest (the total less the caps before it) by
    weight over it and those after it gives it more than its cap.
    """
    total = Window.partitionBy()
    by_code = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    src = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
           .withColumn("source_rank", F.row_number().over(by_code) - 1)
           .withColumn("weight", F.element_at(w, (F.col("source_rank") % len(weights) + 1).cast("int")))
           .withColumn("cap", F.col("source_size") * F.lit(repeat)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    src = src.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") > F.col("cap"))
    rest = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("source_rank"), F.col("level")))).over(total)
    return src.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double"))
                          .otherwise(rest["level"] * F.col("weight"))) \
        .select("source", "source_rank", "source_size", "weight", F.col("target").cast("double").alias("target"))


def apportion(parties: DataFrame, group: list[str], party: str, value: str, seats: str) -> DataFrame:
    """Sainte-Laguë: adds ``quota``, the seats each party gets by the highest quotients value / (2k + 1).

    Within a group with S parties and B seats the party's exact share is x = value * B / sum.
    The threshold quotient lies within a factor 1 +- S / (2B) of sum / (2B), so every seat
    below x - 0.5 - (x * S / 2B + 1) is certain and none above x + 0.5 + (x * S / 2B + 1) is possible.
    Only the quotients between (about five per party) are listed and ranked.
    """
    w = Window.partitionBy(*group)
    x = F.col(value) * F.col(seats) / F.sum(value).over(w)
    df = (parties.withColumn("_x", F.coalesce(F.when(F.sum(value).over(w) > 0, x), F.lit(0.0)))
          .withColumn("_slack", F.ceil(F.col("_x") * F.count(F.lit(1)).over(w) / (2 * F.greatest(F.col(seats), F.lit(1)))) + 1)
          .withColumn("_sure", F.greatest(F.lit(0), F.floor(F.col("_x") - 0.5) - F.col("_slack")).cast("long"))
          .withColumn("_most", (F.ceil(F.col("_x") + 0.5) + F.col("_slack")).cast("long"))
          .withColumn("_open", (F.col(seats) - F.sum("_sure").over(w)).cast("long")))
    cand = df.withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.col("_most"))))
    order = Window.partitionBy(*group).orderBy(F.desc(F.col(value) / (2 * F.col("_k") + 1)), F.col(party), "_k")
    keep = [c for c in parties.columns]
    return (cand.withColumn("_won", ((F.row_number().over(order) <= F.col("_open")) & (F.col(value) > 0)).cast("long"))
            .groupBy(*keep).agg((F.first("_sure") + F.sum("_won")).alias("quota")))


def mix(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, repeat: int = MAX_REPEAT, block: int = BLOCK_WORDS,
        shard_words: int = SHARD_WORDS, seed: int = SEED, group_shards: int = GROUP_SHARDS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (of its source) and taken (words the mix reads from it)."""
    slim_path = scratch_path(spark, "mix-sizes")
    docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size")).write.parquet(slim_path)
    sizes = spark.read.parquet(slim_path)

    src = targets(sizes, weights, repeat)
    total = Window.partitionBy()
    quotas = apportion(src.withColumn("_seats", F.round(F.sum("source_size").over(total) / block).cast("long")),
                       [], "source_rank", "target", "_seats").withColumnRenamed("quota", "source_quota").drop("_seats")
    quota_path = scratch_path(spark, "mix-quotas")
    quotas.withColumn("shards", F.ceil(F.col("source_size") / F.lit(shard_words)).cast("long")).write.parquet(quota_path)
    quotas = spark.read.parquet(quota_path)

    # a document's shard and place depend on its id, size and the seed only
    dealt = (sizes.join(quotas, sizes["source"].eqNullSafe(quotas["source"])).drop(quotas["source"])
             .withColumn("_h", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size")))
             .withColumn("shard", F.pmod(F.col("_h"), F.greatest(F.col("shards"), F.lit(1)))))
    shards = dealt.groupBy("source_rank", "shard", "source_quota").agg(F.sum("size").alias("shard_size"))
    # in two levels: the source's seats go to groups of shards, a group's seats to its shards; no window holds more rows than
    # a source has groups, or a group shards (times the quotients listed)
    shards = shards.withColumn("_group", F.floor(F.col("shard") / F.lit(group_shards)).cast("long"))
    groups = shards.groupBy("source_rank", "_group", "source_quota").agg(F.sum("shard_size").alias("group_size"))
    groups = apportion(groups, ["source_rank"], "_group", "group_size", "source_quota").select(
        F.col("source_rank").alias("_gr"), F.col("_group").alias("_gg"), F.col("quota").alias("group_quota"))
    shards = shards.join(groups, (F.col("source_rank") == F.col("_gr")) & (F.col("_group") == F.col("_gg"))).drop("_gr", "_gg")
    shards = apportion(shards, ["source_rank", "_group"], "shard", "shard_size", "group_quota") \
        .withColumn("_words", F.least(F.col("quota") * block, F.col("shard_size") * repeat)) \
        .select(F.col("source_rank").alias("_r"), F.col("shard").alias("_s"), "shard_size", "_words")
    place = Window.partitionBy("source_rank", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "_h"), "_h", "doc_id", "size")
    begin = F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    turns = F.when(F.col("shard_size") > 0, F.floor(F.col("_words") / F.col("shard_size"))).otherwise(0).cast("long")
    last = F.col("_words") - F.col("turns") * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), last - F.col("_begin")))
    return (dealt.withColumn("_begin", begin)
            .join(shards, (F.col("source_rank") == F.col("_r")) & (F.col("shard") == F.col("_s")))
            .withColumn("turns", turns)
            .select("doc_id", "source", F.col("size").cast("long").alias("size"), "source_size", "target",
                    (F.col("turns") * F.col("size") + part).cast("long").alias("taken")))


def mixed_documents(spark: SparkSession, docs: DataFrame, repeat: int = MAX_REPEAT, **kw) -> DataFrame:
    """The mix as documents: a document appears as often as the mix reads it, the part of a last turn rounded to
    a whole copy from half its words on; documents that are not read, or have no word, go. Columns as in ``docs``."""
    key, turns = ["_id", "_source", "_size"], range(1, repeat + 1)
    hashed = F.xxhash64(*key)
    # rows with equal id, source and size are numbered; one shuffle of the texts, by a hash of the three
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_doc"), F.col("doc_id").alias("_id"),
                        F.col("source").alias("_source"), word_count(F.col("text")).alias("_size")) \
        .withColumn("_key", hashed).where(F.col("_size") > 0).repartition("_key")
    whole = whole.withColumn("_k", F.row_number().over(Window.partitionBy("_key", *key).orderBy(F.xxhash64("_doc.text"))))
    copies = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    # how many of the rows with equal id, source and size are read once, twice, ... at least: one row for all of them
    read = mix(spark, docs, repeat=repeat, **kw).where(F.col("size") > 0).select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), copies.alias("_copies"))
    read = read.groupBy(*key).agg(*[F.count(F.when(F.col("_copies") >= c, 1)).alias(f"_n{c}") for c in turns]) \
        .where(F.col("_n1") > 0).withColumn("_key", hashed).withColumnsRenamed({c: f"{c}2" for c in ("_key", *key)})
    # the texts stay where the hash of the three put them, so the three are compared beside the join key, not as join keys
    same = F.col("_key") == F.col("_key2")
    for c in key:
        same = same & F.coalesce(F.col(c) == F.col(f"{c}2"), F.col(c).isNull() & F.col(f"{c}2").isNull())
    copies = sum(((F.col("_k") <= F.col(f"_n{c}")).cast("int") for c in turns), F.lit(0))
    return whole.join(read, same).withColumn("_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))).select("_doc.*")

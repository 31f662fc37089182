"""References to records that do not exist.

Keys and references are told apart by two independent hashes. The first spreads both over segments, as many as keep a
filter of one segment under its bound; a blocked Bloom filter of each segment's keys travels as one binary value to the
references. A reference whose bits are not all set is an orphan for certain and never shuffled. The others are reduced
to their distinct keys and verified by an exact anti join on the keys themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.time import month
from corpusloom.operators.skew import skew_join
from corpusloom.session import MAX_BROADCAST_ROWS, durable

#: Words of 64 bits in a block, which is one row of the filter, blocks that are broadcast at once (64 MB), bits a key gets.
BLOCK_WORDS, MAX_BLOCKS, BITS_PER_KEY = 1 << 10, 1 << 13, 12
#: Bits set for a key, all in one word.
PROBES = 4


def _marked(df: DataFrame, key: str, blocks: int) -> DataFrame:
    """``df`` with the block, the word in it and the bits of ``key``, all from one hash of it."""
    at = F.xxhash64(F.col(key), F.lit(7))
    bits = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_at, {6 * i}) & 63 as int))") for i in range(PROBES)]
    place = F.xxhash64(F.col(key), F.lit(11))
    return df.withColumns({"_at": at, "_place": place}).withColumns(
        {"_block": F.pmod(F.col("_place"), F.lit(blocks)), "_word": F.pmod(F.shiftrightunsigned("_place", 40), F.lit(BLOCK_WORDS)).cast("int"), "_mask": reduce(Column.bitwiseOR, bits)}
    ).drop("_at", "_place")


def bloom_filter(keys: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """(``_block``, ``_words``): the filter as rows of BLOCK_WORDS words each, and the number of blocks.

    As many blocks as give each key BITS_PER_KEY bits, however many keys there are: the filter never gets too full.
    Words are combined on the map side, so that what is shuffled is the filter and not the keys.
    """
    blocks = max(1, -(-n_keys * BITS_PER_KEY // (64 * BLOCK_WORDS)))
    empty = keys.sparkSession.range(blocks * BLOCK_WORDS).select(F.expr(f"id div {BLOCK_WORDS}").alias("_block"), F.pmod("id", F.lit(BLOCK_WORDS)).cast("int").alias("_word"), F.lit(0).cast("long").alias("_mask"))
    filled = _marked(keys.select(key).filter(F.col(key).isNotNull()), key, blocks).select("_block", "_word", "_mask").unionByName(empty)
    words = filled.groupBy("_block", "_word").agg(F.bit_or("_mask").alias("_bits"))
    rows = words.groupBy("_block").agg(F.array_sort(F.collect_list(F.struct("_word", "_bits"))).alias("_w"))
    return durable(rows.select("_block", F.col("_w")["_bits"].alias("_words")), "bloom"), blocks


def _sifted(refs: DataFrame, bloom: DataFrame, blocks: int, most: int) -> DataFrame:
    """``refs`` (with ``_block``, ``_word``, ``_mask``) and ``_maybe``, whether the filter has all their bits.

    Filters of up to ``most`` blocks are broadcast whole. Larger ones are broadcast in segments of ``most`` blocks, each to
    the references that fall into it, in stages of their own, so that no executor holds more than one segment.
    """
    def sift(some: DataFrame, part: DataFrame) -> DataFrame:
        held = F.get("_words", F.col("_word"))
        met = some.join(F.broadcast(part), "_block", "left")
        return met.withColumn("_maybe", F.coalesce(held.bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))).drop("_words")

    if blocks <= most:
        return sift(refs, bloom)
    # written once in order of blocks, so that each segment reads its own pages of it
    refs = durable(refs.sortWithinPartitions("_block"), "refs")
    parts = []
    for low in range(0, blocks, most):
        inside = (F.col("_block") >= low) & (F.col("_block") < low + most)
        parts.append(durable(sift(refs.filter(inside), bloom.filter(inside)), f"sifted{low}"))
    return reduce(DataFrame.unionByName, parts)


def orphan_references(refs: DataFrame, parents: DataFrame, ref: str, key: str, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The rows of ``refs`` whose ``ref`` names no ``key`` of ``parents``, with all their columns.

    Both columns hold normalised values. NULL and empty references name nothing and are never orphans; NULL and empty
    parent keys name no record. Repeated rows of ``refs`` are each reported, repeated parents count once. With an empty
    ``parents`` every reference is an orphan; an empty ``refs`` gives an empty result. Other columns of ``refs``,
    whatever their names, pass through; only names that begin with ``_`` are used inside.

    References that pass the filter are verified by their keys, not by hashes of them, so the result is exact.
    """
    named = refs.filter(F.col(ref).isNotNull() & (F.col(ref) != ""))
    keys = parents.select(F.col(key).alias("_key")).filter(F.col("_key").isNotNull() & (F.col("_key") != ""))
    bloom, blocks = bloom_filter(keys, "_key", parents.count())
    seen = _sifted(_marked(named.withColumn("_key", F.col(ref)), "_key", blocks), bloom, blocks, max_blocks).drop("_block", "_word", "_mask")
    absent = durable(seen.filter("_maybe").select("_key").distinct().join(keys, "_key", "left_anti"), "absent")
    n = absent.count()
    if n <= MAX_BROADCAST_ROWS:
        lost = seen.join(F.broadcast(absent.withColumn("_lost", F.lit(True))), "_key", "left").filter("NOT _maybe OR _lost").drop("_lost")
    else:
        lost = seen.filter("NOT _maybe").unionByName(skew_join(seen.filter("_maybe"), absent, ["_key"], "left_semi"))
    return lost.drop("_key", "_maybe")


def orphan_report(refs: DataFrame, orphans: DataFrame, source: str, ref: str, created: str) -> DataFrame:
    """Per month of ``created``: references, dangling ones and their share. Months of NULL, NaN and absurd times are 'unknown'."""
    named = refs.filter(F.col(ref).isNotNull() & (F.col(ref) != "")).groupBy(month(F.col(created)).alias("period")).agg(F.count("*").alias("n_references"))
    lost = orphans.groupBy(month(F.col(created)).alias("period")).agg(F.count("*").alias("n_orphans"))
    return named.join(lost, "period", "left").select(
        F.lit(source).alias("source_table"),
        "period",
        "n_references",
        F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"),
        (F.coalesce("n_orphans", F.lit(0)) / F.col("n_references")).alias("orphan_rate"),
    )

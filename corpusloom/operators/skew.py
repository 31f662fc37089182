"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import MAX_BROADCAST_ROWS, durable

#: A key is hot from this many rows on, and from this share of all rows.
HOT_ROWS, HOT_SHARE = 200_000, 0.002


def hot_keys(left: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """The keys of ``left`` that hold at least HOT_ROWS rows and HOT_SHARE of all: at most 1 / HOT_SHARE keys.

    Counting combines on the map side, so that the hot keys themselves do not gather anywhere.
    """
    n = left.count() if rows is None else rows
    return left.groupBy(*keys).count().filter(F.col("count") >= max(HOT_ROWS, int(HOT_SHARE * n))).select(*keys)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", rows: int | None = None, hot: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, whose keys are unique; the rows of hot keys never meet in one task.

    The right rows of hot keys (a bounded number, see hot_keys) are broadcast, all other rows join by shuffle. ``how``
    is inner, left, left_semi or left_anti. NULL keys match nothing. Without ``rows``, the size of ``left``, it is written
    once, as it is read several times. ``hot`` are the hot_keys, written, where many joins share them.
    """
    left = durable(left, "left") if rows is None else left
    n = left.count() if rows is None else rows
    if n < HOT_ROWS:
        return left.join(right, keys, how)
    if hot is None:
        hot = durable(hot_keys(left.dropna(subset=keys), keys, n), "hot")
    if hot.isEmpty():
        return left.join(right, keys, how)
    marked = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    few = right.join(F.broadcast(hot), keys, "left_semi")
    at_hot = marked.filter("_hot").drop("_hot").join(F.broadcast(few), keys, how)
    rest = marked.filter("_hot IS NULL").drop("_hot").join(right, keys, how)
    return at_hot.unionByName(rest)


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, right_rows: int, left_rows: int | None = None) -> DataFrame:
    """skew_join, or a broadcast of ``right`` where it has at most MAX_BROADCAST_ROWS rows by count."""
    if right_rows <= MAX_BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, how)
    return skew_join(left, right, keys, how, left_rows)


def digest(c: Column, prefix: str) -> list[Column]:
    """Two columns, 96 bits in all, that stand for a string key: among 10^11 keys a collision has a chance of 10^-7."""
    return [F.xxhash64(c).alias(f"{prefix}1"), F.hash(c).alias(f"{prefix}2")]

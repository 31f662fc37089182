"""Global ranks and running sums without a window that spans all rows.

Rows are range-partitioned and sorted, numbered within their partition, and shifted by what lies before it. The order
includes a key, so that equal values spread over partitions however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.skew import lookup_join
from corpusloom.session import durable

_LOCAL = (1 << 33) - 1


def _placed(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """``df`` in global order with ``_part`` (ordered ranges) and ``_at`` (position within); written, so that both stay."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return durable(ranged, "ranks").withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit(_LOCAL))).drop("_id")


def with_rank(df: DataFrame, order: list[Column | str], name: str = "rank", total: str | None = None) -> DataFrame:
    """``df`` with the 1-based ``name`` of each row in ``order``, and the number of rows as ``total``.

    One range shuffle; the counts of the partitions (as many as there are) are broadcast. Ties take the order given, so
    it should end with a key.
    """
    rows = _placed(df, order)
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = parts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy(F.lit(0))).alias("_all"))
    out = rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1)
    if total:
        out = out.withColumn(total, F.col("_all"))
    return out.drop("_part", "_at", "_before", "_all")


def with_running(df: DataFrame, order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """``df`` with the running sum of column ``c`` as ``name`` for each name, c in ``sums``, up to and with each row."""
    rows = _placed(df, order)
    parts = rows.groupBy("_part").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    upto = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = parts.select("_part", *[F.coalesce(F.sum(f"_s_{n}").over(upto), F.lit(0)).alias(f"_b_{n}") for n in sums])
    own = W.partitionBy("_part").orderBy("_at")
    out = rows.join(F.broadcast(before), "_part")
    for n, c in sums.items():
        out = out.withColumn(n, F.sum(c).over(own) + F.col(f"_b_{n}"))
    return out.drop("_part", "_at", *[f"_b_{n}" for n in sums])


def rank_within(df: DataFrame, group: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """``df`` with the 1-based ``name`` of each row in ``order`` among the rows of its ``group``.

    Takes the place of a window over the group: a group of any size spreads over partitions. Rows with a NULL in
    ``group`` are dropped.
    """
    ranked = with_rank(df.dropna(subset=group), [*group, *order], "_r")
    first = ranked.groupBy(*group).agg(F.min("_r").alias("_first"))
    placed = lookup_join(ranked, first, group, "inner", first.count())
    return placed.withColumn(name, F.col("_r") - F.col("_first") + 1).drop("_r", "_first")


def percentiles_within(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(``group``, a column for each of ``shares``): exact percentiles, interpolated between the two neighbouring ranks.

    The position of share p is p (n - 1) among the n values, as M4 and the averaging median (M5) have it. Values are
    ranked over ranges of the whole table and two of a group are kept for each share, so that a few groups with most of
    the rows need no large task. NULL and NaN values do not count; a group without others has no row. NULL group keys form
    a group of their own.
    """
    held = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(F.struct(*group).alias("_g"), F.col(value).cast("double").alias("_v"))
    ranked = with_rank(held, ["_g", "_v"], "_r")
    ends = ranked.groupBy("_g").agg(F.min("_r").alias("_first"), F.count("*").alias("_n"))
    placed = lookup_join(ranked, ends, ["_g"], "inner", ends.count())
    off = {name: F.abs(F.col("_r") - F.col("_first") - F.lit(p) * (F.col("_n") - 1)) for name, p in shares.items()}
    near = placed.select("_g", "_v", *[d.alias(f"_d_{name}") for name, d in off.items()]).filter(" OR ".join(f"`_d_{name}` < 1" for name in shares))
    found = near.groupBy("_g").agg(*[F.sum(F.when(F.col(f"_d_{name}") < 1, F.col("_v") * (1 - F.col(f"_d_{name}")))).alias(name) for name in shares])
    return found.select(*[F.col("_g")[g].alias(g) for g in group], *shares)

"""Upserts, progress and state of resumable ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: a failed run is resumed for this long.
RESUME_HOURS = 48


def merged_engagement(stored: DataFrame, fresh: DataFrame, key: str, counts: list[str]) -> DataFrame:
    """Stored rows with newer counts (NULL keeps the old one) and unknown ones added; texts are never replaced."""
    new = fresh.select(key, *[F.col(c).alias(f"_{c}") for c in counts])
    updated = stored.join(new, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in counts else F.col(c) for c in stored.columns])
    added = fresh.join(stored.select(key), key, "left_anti").select(*[F.col(c) if c in fresh.columns else F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in stored.columns])
    return updated.unionByName(added)


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What no earlier run has finished."""
    return work.join(done.select(key), key, "left_anti")


def resume_cursor(log: DataFrame, account: str, now: float) -> DataFrame:
    """The cursor to go on from: of an account whose newest run failed under RESUME_HOURS ago."""
    last = log.groupBy(account).agg(F.max_by(F.struct("status", "cursor", "at"), "at").alias("l"))
    fresh = (F.col("l.status") == "failed") & (F.col("l.at") > now - RESUME_HOURS * 3600)
    return last.select(account, F.when(fresh, F.col("l.cursor")).alias("cursor"))


def upserted(stored: DataFrame, fresh: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key of both."""
    both = stored.unionByName(fresh)
    keep = [c for c in stored.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*keep), order).alias("_l"))
    return last.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in keep]).select(*stored.columns)


def earlier_starts(accounts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Account starts, moved earlier where ``wanted`` says so and never later."""
    return accounts.join(wanted, "z_pk", "left").select("z_pk", F.least("zstartat", "start").alias("start"))


def next_state(status, outcome):
    """The state of a reply tree after a fetch: 'ok' completes, 'partial' goes on, 'gone' freezes, 'retry' stays."""
    return F.when(status == "complete", F.lit("complete")).when(outcome == "ok", F.lit("complete")).when(outcome == "partial", F.lit("inProgress")).when(outcome == "gone", F.lit("complete")).otherwise(status)


def reconciled(presets: DataFrame, stored: DataFrame, retired: list[str]) -> DataFrame:
    """Stored configurations without retired ones, with missing presets added and their texts refreshed; own rows stay.

    Exactly one is the default: the one that was, else the least name. Both are small, curated tables.
    """
    kept = stored.filter(~F.col("name").isin(retired)) if retired else stored
    text = kept.join(presets.select("name", F.col("template").alias("_t")), "name", "left").select("name", F.coalesce("_t", "template").alias("template"), "is_default")
    added = presets.join(stored.select("name"), "name", "left_anti").select("name", "template", F.lit(False).alias("is_default"))
    every = text.unionByName(added)
    top = every.agg(F.coalesce(F.min(F.when(F.col("is_default"), F.col("name"))), F.min("name")).alias("top")).withColumn("_k", F.lit(0))
    return every.withColumn("_k", F.lit(0)).join(F.broadcast(top), "_k").select("name", "template", (F.col("name") == F.col("top")).alias("is_default"))

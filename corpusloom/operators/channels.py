"""Message channels: coverage, gaps, forwards, candidates and states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ranks import rank_within
from corpusloom.operators.skew import lookup_join

#: Which states of a channel may follow which (I13), and when a forward source is a candidate.
TRANSITIONS = {"seed_candidate": {"seed_approved", "rejected"}, "snowball_candidate": {"snowball_approved", "rejected"}, "seed_approved": {"dead", "paused"}, "snowball_approved": {"dead", "paused"}, "paused": {"seed_approved", "snowball_approved", "dead"}}
LEAST_CHANNELS, LEAST_FORWARDS = 3, 20


def day(c):
    """The day at the start of an ISO text."""
    return F.substring(c, 1, 10)


def day_coverage(m: DataFrame) -> DataFrame:
    """Of each channel and day the messages, first and last id, and how many ids are missing between them.

    ``m`` has one row for each message, so the gaps follow from three partial aggregates.
    """
    rows = m.filter("sent_at IS NOT NULL").select("channel", day("sent_at").alias("day"), "msg_id")
    sums = rows.groupBy("channel", "day").agg(F.count("*").alias("n_messages"), F.min("msg_id").alias("first_id"), F.max("msg_id").alias("last_id"))
    return sums.withColumn("n_missing", F.col("last_id") - F.col("first_id") + 1 - F.col("n_messages"))


def blocks(ids: DataFrame, group: list[str], number: str) -> tuple[DataFrame, DataFrame]:
    """First and last numbers of the unbroken blocks of each group: those without a predecessor, and without a successor."""
    starts = ids.join(ids.withColumn(number, F.col(number) + 1), [*group, number], "left_anti")
    ends = ids.join(ids.withColumn(number, F.col(number) - 1), [*group, number], "left_anti")
    return starts, ends


def gap_ranges(m: DataFrame) -> DataFrame:
    """The ranges of ids that are missing within a channel and day: from the end of a block to the next start."""
    ids = m.filter("sent_at IS NOT NULL").select("channel", day("sent_at").alias("day"), "msg_id").distinct()
    starts, ends = blocks(ids, ["channel", "day"], "msg_id")
    nth = lambda x, name: rank_within(x, ["channel", "day"], ["msg_id"], "_nth").withColumnRenamed("msg_id", name)
    met = nth(ends, "_end").join(nth(starts, "_start").withColumn("_nth", F.col("_nth") - 1), ["channel", "day", "_nth"])
    return met.select("channel", "day", (F.col("_end") + 1).alias("first_missing"), (F.col("_start") - 1).alias("last_missing"))


def contiguous_top(m: DataFrame) -> DataFrame:
    """The last id of each channel's unbroken block from its least id: the least id without a successor."""
    _, ends = blocks(m.select("channel", "msg_id").distinct(), ["channel"], "msg_id")
    return ends.groupBy("channel").agg(F.min("msg_id").alias("contiguous_top"))


def forward_evidence(m: DataFrame, channels: DataFrame) -> DataFrame:
    """Forwards by source that is no channel of ours: messages and forwarding channels."""
    named = m.filter("fwd_from_channel IS NOT NULL AND fwd_from_channel <> ''")
    return named.join(channels.select(F.col("username").alias("fwd_from_channel")), "fwd_from_channel", "left_anti").groupBy("fwd_from_channel").agg(F.count("*").alias("n_forwards"), F.countDistinct("channel").alias("n_channels"))


def candidates(evidence: DataFrame, least_channels: int = LEAST_CHANNELS, least_forwards: int = LEAST_FORWARDS) -> DataFrame:
    """Sources that enough channels forward, or that are forwarded often enough."""
    return evidence.filter((F.col("n_channels") >= least_channels) | (F.col("n_forwards") >= least_forwards))


def forwarded_share(m: DataFrame) -> DataFrame:
    """Messages of each channel and the share that is forwarded."""
    return m.groupBy("channel").agg(F.count("*").alias("n_messages"), F.avg((F.coalesce("fwd_from_channel", F.lit("")) != "").cast("double")).alias("forwarded_share"))


def may_become(now: str, new: str) -> bool:
    """Whether a channel may change from one state to another."""
    return new in TRANSITIONS.get(now, set())


def new_messages(page: DataFrame, stored: DataFrame) -> DataFrame:
    """The messages of a page that are not stored yet, each once."""
    return page.dropDuplicates(["channel", "msg_id"]).join(stored.select("channel", "msg_id"), ["channel", "msg_id"], "left_anti")


def trailing_streak(runs: DataFrame, order: str, skipped: str, key: str) -> DataFrame:
    """Of each key the newest runs in a row that were skipped, up to the first that was not."""
    clear = runs.groupBy(key).agg(F.max(F.when(~F.col(skipped), F.col(order))).alias("_clear"))
    tail = lookup_join(runs, clear, [key], "inner", clear.count())
    newer = F.col("_clear").isNull() | (F.col(order) > F.col("_clear"))
    return tail.groupBy(key).agg(F.count_if(newer).alias("streak")).withColumn("alarm", F.col("streak") >= 3)


def freshness(m: DataFrame, now: str, hours: int = 36) -> DataFrame:
    """Of each channel the seconds since its newest message, and whether they are too many."""
    sent = F.try_to_timestamp("sent_at")
    last = m.groupBy("channel").agg(F.max(sent).alias("last"))
    age = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds("last")
    return last.select("channel", age.alias("age_s"), (age > hours * 3600).alias("stale"))

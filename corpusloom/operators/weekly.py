"""Weekly series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.stats import share
from corpusloom.functions.time import in_range, iso_week, to_timestamp, week_start
from corpusloom.operators.authors import per_week
from corpusloom.operators.model import replies, roots, with_root
from corpusloom.operators.ranks import percentiles_within, with_rank
from corpusloom.session import durable

#: Fixed value: a reply is uncivil above this score in the analyses (F16), from it on in the comparisons.
UNCIVIL = 0.5


def weekly_scores(p: DataFrame, latest: DataFrame) -> DataFrame:
    """By outlet and ISO week (UTC): replies, scored ones, coverage, mean, median, p90 and share above UNCIVIL.

    Unscored replies count as replies and never as zeros.
    """
    rows = with_root(replies(p).filter(in_range(F.col("created"))), p).join(latest.select(F.col("uri").alias("zuri"), "score"), "zuri", "left")
    week = iso_week(to_timestamp(F.col("created")))
    n, scored = F.count("*"), F.count("score")
    rows = durable(rows.select("outlet", week.alias("week"), "score"), "weekly")
    sums = rows.groupBy("outlet", "week").agg(
        n.alias("n_total"), scored.alias("n_scored"), (scored / n).alias("coverage"), F.avg("score").alias("mean_score"), share(F.count_if(F.col("score") > UNCIVIL).cast("double"), scored).alias("share_uncivil"),
    )
    ends = percentiles_within(rows, ["outlet", "week"], "score", {"p50": 0.5, "p90": 0.9}).select(F.col("outlet").alias("_o"), F.col("week").alias("_w"), "p50", "p90")
    met = sums.join(ends, F.col("outlet").eqNullSafe(F.col("_o")) & F.col("week").eqNullSafe(F.col("_w")), "left")
    return met.select("outlet", "week", "n_total", "n_scored", "coverage", "mean_score", "p50", "p90", "share_uncivil")


def weekly_activity(p: DataFrame) -> DataFrame:
    """Roots and replies of each week, 0 where a week has only one kind."""
    a, b = per_week(roots(p)).withColumnRenamed("n_posts", "n_roots"), per_week(replies(p)).withColumnRenamed("n_posts", "n_replies")
    both = a.join(b, "week", "full")
    return both.select("week", F.coalesce("n_roots", F.lit(0)).alias("n_roots"), F.coalesce("n_replies", F.lit(0)).alias("n_replies"))


def weekly_classes(n: DataFrame) -> DataFrame:
    """Annotations of each week by class, with ratios that are 0 in a week without any."""
    rows = n.filter(in_range(F.col("created")) & F.col("class").isin("hate", "counter", "neutral"))
    counts = rows.groupBy(week_start(to_timestamp(F.col("created"))).alias("week")).agg(F.count("*").alias("n"), F.count_if(F.col("class") == "hate").alias("n_hate"), F.count_if(F.col("class") == "counter").alias("n_counter"))
    return counts.select("*", (F.col("n_hate") / F.col("n")).alias("hate_ratio"), (F.col("n_counter") / F.col("n")).alias("counter_ratio"))


def trend(weeks: DataFrame, value: str) -> DataFrame:
    """Change against the week before as a share of it; 0 for the first week and after a 0.

    The window runs over weeks, of which there are few.
    """
    before = F.lag(value).over(W.orderBy("week"))
    return weeks.select("week", value, F.when(before > 0, (F.col(value) - before) / before).otherwise(F.lit(0.0)).alias("change"))


def last_buckets(weeks: DataFrame, n: int = 12) -> DataFrame:
    """The newest ``n`` weeks that exist."""
    return weeks.orderBy(F.desc("week")).limit(n)


def decimated(points: DataFrame, order: list[str], cap: int) -> DataFrame:
    """At most ``cap`` points with both ends kept, evenly by rank (positions rounded half away from zero)."""
    ranked = with_rank(points, order, "_i", "_n").withColumn("_i", F.col("_i") - 1)
    if cap < 2:
        return ranked.filter(F.col("_i") < cap).drop("_i", "_n")
    inner = cap - 2
    step = (F.col("_n") - 2) / F.lit(float(inner + 1))
    picks = F.transform(F.sequence(F.lit(1), F.lit(inner)), lambda i: F.greatest(F.lit(1), F.least(F.col("_n") - 2, F.round(i * step).cast("long")))) if inner else F.array().cast("array<bigint>")
    kept = (F.col("_n") <= cap) | (F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1) | F.array_contains(picks, F.col("_i").cast("long"))
    return ranked.filter(kept).drop("_i", "_n")


def rolling_week(ts: Column) -> Column:
    """A seven-day tumbling window that starts on Mondays, as streaming queries use it."""
    return F.window(ts, "7 days", "7 days", "4 days")

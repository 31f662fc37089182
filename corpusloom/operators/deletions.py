"""Replies that an archive holds and the live store lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.time import to_timestamp
from corpusloom.operators.model import replies, roots


def deleted(archive: DataFrame, live: DataFrame) -> DataFrame:
    """Archived replies missing from ``live``, below roots that the live store has walked again.

    A root counts as walked when its tree is complete or in progress; ``complete`` tells which. Replies below roots that
    nobody looked at again are not known to be deleted.
    """
    state = F.lower(F.trim("zreplytreestatus"))
    walked = roots(live).filter(state.isin("complete", "inprogress")).select(F.col("zuri").alias("zrooturi"), (state == "complete").alias("complete"), F.col("zaccount").alias("outlet"))
    gone = replies(archive).join(live.select("zuri"), "zuri", "left_anti")
    return gone.join(walked, "zrooturi")


def deletion_summary(found: DataFrame) -> DataFrame:
    """Deleted replies by outlet ('unknown' for none) and depth: number, without text, below complete roots, and days."""
    at = F.date_format(to_timestamp(F.col("created")), "yyyy-MM-dd")
    return found.groupBy(F.coalesce(F.col("outlet").cast("string"), F.lit("unknown")).alias("outlet"), F.coalesce("zdepth", F.lit(0)).alias("depth")).agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(F.length(F.trim("ztext")), F.lit(0)) == 0).alias("n_empty"), F.count_if("complete").alias("n_complete"), F.min(at).alias("first_day"), F.max(at).alias("last_day")
    )

"""Concentration of incivility over authors, its escalation in threads, and what moderation sees of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.stats import depth_bucket, share, wilson
from corpusloom.operators.model import replies, with_root
from corpusloom.operators.ranks import percentiles_within, with_rank
from corpusloom.operators.weekly import UNCIVIL
from corpusloom.session import durable

#: Authors are ranked by mean from this many scored replies on; cells below SMALL are marked.
ELIGIBLE, SMALL = 10, 100


def scored_replies(p: DataFrame, latest: DataFrame) -> DataFrame:
    """Replies with their outlet ('unknown' without root) and their score (NULL without)."""
    r = with_root(replies(p), p, "left").join(latest.select(F.col("uri").alias("zuri"), "score"), "zuri", "left")
    return r.withColumn("outlet_name", F.coalesce(F.col("outlet").cast("string"), F.lit("unknown")))


def author_scores(rows: DataFrame) -> DataFrame:
    """Each author's replies, scored ones, mean, greatest, number above UNCIVIL and mass, the sum of all scores; NULL
    mean and greatest and a mass of 0 without scores. NULL is an author like others."""
    return rows.groupBy("zauthordid").agg(
        F.count("*").alias("reply_count"), F.count("score").alias("n_scored"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"),
        F.count_if(F.col("score") > UNCIVIL).alias("n_above"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("mass"),
    )


def gini(values: DataFrame, x: str, key: str) -> DataFrame:
    """M8: the Gini coefficient of ``x``; 0 without rows and for all zeros. ``key`` identifies the rows."""
    ranked = with_rank(values.select(x, key), [x, key], "_rank")
    sums = ranked.agg(F.sum(F.col(x) * F.col("_rank")).alias("s"), F.sum(x).alias("t"), F.count("*").alias("n"))
    return sums.select(F.when(F.col("t") > 0, 2 * F.col("s") / (F.col("n") * F.col("t")) - (F.col("n") + 1) / F.col("n")).otherwise(F.lit(0.0)).alias("gini"))


def top_share(ranked: DataFrame, x: str, rank: str, f: float) -> float | None:
    """M9: the share of the total of ``x`` over the rows with a ``rank`` that the first max(1, round(n f)) ranks hold.

    The round is half to even; NULL (None) without ranked rows and for a total of 0. Rows of NULL rank do not count.
    """
    n = ranked.filter(F.col(rank).isNotNull()).count()
    first = max(1, round(n * f))
    sums = ranked.filter(F.col(rank).isNotNull()).agg(F.sum(F.when(F.col(rank) <= first, F.col(x))).alias("a"), F.sum(x).alias("b")).first()
    return sums["a"] / sums["b"] if n and sums["b"] else None


def ranked_authors(per: DataFrame, least: int = ELIGIBLE) -> DataFrame:
    """``per`` (author_scores) with volume_rank, and mean_rank among those with ``least`` scored replies (else NULL).

    All authors are ranked, over ranges of the whole table; ties go by the author.
    """
    by_volume = with_rank(per, [F.desc("reply_count"), "zauthordid"], "volume_rank")
    eligible = F.col("n_scored") >= least
    return with_rank(by_volume, [F.when(eligible, F.col("mean_score")).desc_nulls_last(), "zauthordid"], "_r").withColumn("mean_rank", F.when(eligible, F.col("_r"))).drop("_r")


def concentration(per: DataFrame, least: int = ELIGIBLE) -> DataFrame:
    """One row that sums up who holds the incivility.

    Authors and replies, those without any score, the Gini coefficient of the mass over scored authors, and the share of
    the mass that the first 1 % and 10 % hold, of all authors by volume and of the eligible ones by mean score.
    """
    ranked = durable(ranked_authors(per, least), "ranked")
    held = gini(ranked.filter("n_scored > 0").select("zauthordid", "mass"), "mass", "zauthordid").first()[0]
    shares = {f"top{round(100 * f)}pct_share_by_{name}": top_share(ranked, "mass", rank, f) for name, rank in (("volume", "volume_rank"), ("mean_score", "mean_rank")) for f in (0.01, 0.1)}
    counts = ranked.agg(
        F.count("*").alias("n_authors"), F.coalesce(F.sum("reply_count"), F.lit(0)).alias("n_replies"), F.count_if(F.col("n_scored") == 0).alias("n_authors_no_score"),
        F.coalesce(F.sum(F.col("reply_count") - F.col("n_scored")), F.lit(0)).alias("n_replies_no_score"), F.count("mean_rank").alias("n_eligible_for_mean_rank"),
    )
    return counts.withColumns({"gini": F.lit(held)} | {k: F.lit(v).cast("double") for k, v in shares.items()})


def escalation(rows: DataFrame, latest: DataFrame) -> DataFrame:
    """By outlet and depth ('ALL' for all) the scored replies, how many are uncivil, and how many are
    after an uncivil and after a civil parent, each with its share and Wilson interval.

    The child has to be a scored reply, the parent any scored post (``latest``); a parent without a score is neither.
    """
    child = rows.filter("score IS NOT NULL").select("outlet_name", depth_bucket(F.coalesce("zdepth", F.lit(0))).alias("depth_bucket"), "zparenturi", (F.col("score") > UNCIVIL).alias("bad"))
    above = latest.select(F.col("uri").alias("zparenturi"), (F.col("score") > UNCIVIL).alias("above"))
    met = child.join(above, "zparenturi", "left")
    cells = met.cube("outlet_name", "depth_bucket").agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), F.count_if("bad").alias("n_base_uncivil"), F.count_if("above").alias("n_after_bad"), F.count_if(~F.col("above")).alias("n_after_good"),
        F.count_if(F.col("above") & F.col("bad")).alias("bad_after_bad"), F.count_if(~F.col("above") & F.col("bad")).alias("bad_after_good"),
    )
    out = cells.select(
        F.when(F.col("level").isin(2, 3), F.lit("ALL")).otherwise(F.col("outlet_name")).alias("outlet_name"), F.when(F.col("level").isin(1, 3), F.lit("ALL")).otherwise(F.col("depth_bucket")).alias("depth_bucket"),
        "n", "n_base_uncivil", "n_after_bad", "bad_after_bad", "n_after_good", "bad_after_good", (F.col("n") < SMALL).alias("small_n"),
    )
    for name, k, n in (("base", "n_base_uncivil", "n"), ("after_bad", "bad_after_bad", "n_after_bad"), ("after_good", "bad_after_good", "n_after_good")):
        low, high = wilson(F.col(k), F.col(n))
        out = out.withColumns({f"p_{name}": share(F.col(k), F.col(n)), f"{name}_low": low, f"{name}_high": high})
    return out


def deciles(scores: DataFrame, score: str = "score", key: str = "uri") -> DataFrame:
    """Decile 1-10 of each row by its 0-based rank i among n: min(9, 10 i div n) + 1; ties go by ``key``."""
    ranked = with_rank(scores, [score, key], "_rank", "_n")
    return ranked.withColumn("decile", F.expr("least(9, (10 * (_rank - 1)) div _n) + 1").cast("long")).drop("_rank", "_n")


def moderation_by_decile(latest: DataFrame, active: DataFrame, created: DataFrame) -> DataFrame:
    """Of each score decile the posts with any, hate and counter labels, Wilson ends, and the
    averaging median of days from post to label (negative ones count)."""
    per = active.groupBy("uri").agg(F.collect_set("val").alias("vals"), F.collect_list("cts").alias("times"))
    rows = deciles(latest.select("uri", "score")).join(per, "uri", "left").join(created.select(F.col("zuri").alias("uri"), "created"), "uri", "left")
    waits = rows.select("decile", F.explode("times").alias("cts"), "created").select("decile", ((F.col("cts") - F.col("created")) / 86400).alias("days"))
    wait = percentiles_within(waits, ["decile"], "days", {"median_days": 0.5})
    n, k = F.col("n"), F.col("n_labelled")
    low, high = wilson(k, n)
    counts = rows.groupBy("decile").agg(F.count("*").alias("n"), F.count("vals").alias("n_labelled"), F.count_if(F.array_contains("vals", "hate")).alias("n_hate"), F.count_if(F.array_contains("vals", "counter")).alias("n_counter"))
    return counts.join(wait, "decile", "left").select("decile", "n", "n_labelled", "n_hate", "n_counter", low.alias("low"), high.alias("high"), "median_days")

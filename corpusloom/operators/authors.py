"""Authors of replies: counts, lists, details, weeks and the population as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.time import in_range, to_timestamp, week_start
from corpusloom.operators.model import replies, roots, with_root
from corpusloom.operators.ranks import with_rank

#: The bins of the reply histogram, as (label, least, most).
BINS = [("1", 1, 1), ("2-9", 2, 9), ("10-99", 10, 99), ("100-999", 100, 999), ("1000+", 1000, None)]
MONTH = 30 * 86400.0


def bounded(c: Column, least: int | None, most: int | None) -> Column:
    """Inclusive bounds; a bound of None is none."""
    test = F.lit(True)
    if least is not None:
        test = test & (c >= least)
    if most is not None:
        test = test & (c <= most)
    return test


def valid_bounds(least: int | None, most: int | None) -> tuple[int, int | None]:
    """a blank minimum is 1, a blank maximum none; a minimum above the maximum is an error."""
    low = 1 if least is None else least
    if low < 0 or (most is not None and most < low):
        raise ValueError(f"no author can have at least {low} and at most {most} replies")
    return low, most


def author_count(p: DataFrame) -> DataFrame:
    """A1: distinct authors of replies."""
    return replies(p).agg(F.countDistinct("zauthordid").alias("n_authors"))


def authors_in_range(p: DataFrame, least: int | None, most: int | None, outlet: int | None = None) -> DataFrame:
    """A2: authors by their number of replies. Without an outlet no join is made and orphans count; with one they do not."""
    r = replies(p) if outlet is None else with_root(replies(p), p).filter(F.col("outlet") == outlet)
    return r.groupBy("zauthordid").count().filter(bounded(F.col("count"), least, most)).agg(F.count("*").alias("n_authors"))


def newest_handle(r: DataFrame) -> DataFrame:
    """Each author's handle of the newest reply that has one."""
    return r.filter("zauthorhandle IS NOT NULL").groupBy("zauthordid").agg(F.max_by("zauthorhandle", F.struct(F.coalesce("created", F.lit(float("-inf"))), "zuri")).alias("reply_handle"))


def authors(p: DataFrame, probed: DataFrame, least: int | None = None, most: int | None = None, outlet: int | None = None) -> DataFrame:
    """A3: each author's replies, first and last time, number of outlets and handle (F12: as probed, else the newest).

    One aggregation serves all: the outlet is joined once and counted with the replies. With ``outlet`` only replies to
    that outlet count; without, orphans count as replies of no outlet.
    """
    r = with_root(replies(p), p, "inner" if outlet is not None else "left")
    if outlet is not None:
        r = r.filter(F.col("outlet") == outlet)
    order = F.when(F.col("zauthorhandle").isNotNull(), F.struct(F.coalesce("created", F.lit(float("-inf"))), "zuri"))
    seen = r.groupBy("zauthordid").agg(
        F.count("*").alias("reply_count"), F.min("created").alias("first_seen"), F.max("created").alias("last_seen"), F.countDistinct("outlet").alias("n_outlets"), F.max_by("zauthorhandle", order).alias("reply_handle")
    )
    known = probed.select(F.col("zdid").alias("zauthordid"), F.col("zcurrenthandle").alias("probed_handle"))
    page = seen.filter(bounded(F.col("reply_count"), least, most))
    return page.join(known, "zauthordid", "left").select("zauthordid", "reply_count", "first_seen", "last_seen", "n_outlets", F.coalesce("probed_handle", "reply_handle").alias("handle"))


def sorted_authors(found: DataFrame, by: str, limit: int | None = None) -> DataFrame:
    """O1, O2: the list in order (replies, first, last, span, did), cut after the whole population is ranked."""
    span = F.col("last_seen") - F.col("first_seen")
    order = {"replies": F.desc("reply_count"), "first": F.asc_nulls_last("first_seen"), "last": F.desc_nulls_last("last_seen"), "span": span.desc_nulls_last(), "did": F.asc("zauthordid")}[by]
    out = found.orderBy(order, "zauthordid")
    return out if limit is None else out.limit(limit)


def span_days(first: Column, last: Column) -> Column:
    """Whole days between two times, at least 0."""
    return F.greatest(F.lit(0), F.floor((last - first) / 86400)).cast("long")


def outlet_counts(p: DataFrame, page: DataFrame) -> DataFrame:
    """A4: the number of outlets of exactly the authors in ``page``; 0 for authors of orphans only."""
    mine = replies(p).join(page.select("zauthordid"), "zauthordid", "left_semi")
    counted = with_root(mine, p).groupBy("zauthordid").agg(F.countDistinct("outlet").alias("n_outlets"))
    return page.select("zauthordid").join(counted, "zauthordid", "left").select("zauthordid", F.coalesce("n_outlets", F.lit(0)).alias("n_outlets"))


def author_detail(p: DataFrame, tops: DataFrame, probed: DataFrame, did: str) -> DataFrame:
    """A5: one author over replies with a root; no row for authors of orphans only; the handle is the probed one alone.

    ``p`` holds at least the author's posts, ``tops`` at least all roots.
    """
    mine = with_root(replies(p).filter(F.col("zauthordid") == did), tops)
    seen = mine.groupBy("zauthordid").agg(F.count("*").alias("reply_count"), F.min("created").alias("first_seen"), F.max("created").alias("last_seen"), F.countDistinct("outlet").alias("n_outlets"))
    known = probed.filter(F.col("zdid") == did).select(F.col("zdid").alias("zauthordid"), F.col("zcurrenthandle").alias("handle"), F.col("zcurrentstatus").alias("status"))
    return seen.join(known, "zauthordid", "left")


def outlet_breakdown(p: DataFrame, tops: DataFrame, accounts: DataFrame, did: str) -> DataFrame:
    """An author's replies by outlet; ``p`` holds at least the author's posts, ``tops`` at least all roots."""
    mine = with_root(replies(p).filter(F.col("zauthordid") == did), tops)
    named = accounts.select(F.col("z_pk").alias("outlet"), F.col("zhandle").alias("outlet_handle"))
    return mine.groupBy("outlet").agg(F.count("*").alias("n_replies")).join(F.broadcast(named), "outlet")


def replies_per_author(p: DataFrame) -> DataFrame:
    """The population fold that M1-M3 and A8 derive from."""
    return replies(p).groupBy("zauthordid").agg(F.count("*").alias("c"), F.max("created").alias("last_seen"))


def upper_median(counts: DataFrame, c: str, key: str) -> DataFrame:
    """M1: the value at 0-based rank n div 2, so of 1, 2, 3, 4 the 3; 0 without rows."""
    ranked = with_rank(counts.select(c, key), [c, key], "_rank", "_n")
    return ranked.filter(F.expr("_rank = _n div 2 + 1")).agg(F.coalesce(F.max(c), F.lit(0)).alias("median_replies"))


def histogram(counts: DataFrame, c: str) -> DataFrame:
    """M2: how many values fall in each of BINS; empty bins are listed."""
    tests = [F.count_if(bounded(F.col(c), low, high)).alias(name) for name, low, high in BINS]
    one = counts.agg(*tests)
    stacked = ", ".join(f"'{name}', `{name}`" for name, _, _ in BINS)
    return one.select(F.expr(f"stack({len(BINS)}, {stacked}) AS (bin, n_authors)"))


def population(p: DataFrame, probed: DataFrame, now: float) -> DataFrame:
    """Authors, replies, upper-middle median of replies, and authors active in the 30 days up to ``now``."""
    per = replies_per_author(p)
    totals = per.agg(F.count("*").alias("n_authors"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_replies"), F.count_if(F.col("last_seen").between(now - MONTH, now)).alias("n_active"))
    return totals.withColumn("_k", F.lit(0)).join(F.broadcast(upper_median(per, "c", "zauthordid").withColumn("_k", F.lit(0))), "_k").drop("_k")


def outlet_authors(p: DataFrame) -> DataFrame:
    """Distinct authors and replies of each outlet."""
    return with_root(replies(p), p).groupBy("outlet").agg(F.countDistinct("zauthordid").alias("n_authors"), F.count("*").alias("n_replies"))


def status_counts(probed: DataFrame) -> DataFrame:
    """Authors by probed status ('unknown' for NULL), and how many of them were probed."""
    return probed.groupBy(F.coalesce("zcurrentstatus", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n_authors"), F.count("zlastprobedat").alias("n_probed"))


def seen_ranges(p: DataFrame) -> DataFrame:
    """First and last reply of each author."""
    return replies(p).groupBy("zauthordid").agg(F.min("created").alias("first_seen"), F.max("created").alias("last_seen"))


def new_authors_per_week(p: DataFrame) -> DataFrame:
    """Authors by the week of their first reply."""
    first = replies(p).filter(in_range(F.col("created"))).groupBy("zauthordid").agg(F.min("created").alias("first_seen"))
    return first.groupBy(week_start(to_timestamp(F.col("first_seen"))).alias("week")).agg(F.count("*").alias("n_authors"))


def per_week(rows: DataFrame) -> DataFrame:
    """Rows by the Monday of their week; rows without a time in range have none."""
    return rows.filter(in_range(F.col("created"))).groupBy(week_start(to_timestamp(F.col("created"))).alias("week")).agg(F.count("*").alias("n_posts"))


def replies_of_author(p: DataFrame, did: str, limit: int = 100) -> DataFrame:
    """An author's newest replies."""
    return replies(p).filter(F.col("zauthordid") == did).orderBy(F.desc_nulls_last("created"), "zuri").limit(limit).select("zuri", "created", "ztext")


def replies_to_accounts(p: DataFrame, accounts: list[int]) -> DataFrame:
    """Replies below the roots of ``accounts``; an empty list gives an empty result without a scan."""
    if not accounts:
        return replies(p).limit(0)
    mine = roots(p).filter(F.col("zaccount").isin(accounts)).select(F.col("zuri").alias("zrooturi"))
    return replies(p).join(mine, "zrooturi", "left_semi")


def handles(p: DataFrame, did: str) -> DataFrame:
    """the different handles of an author, sorted."""
    return replies(p).filter((F.col("zauthordid") == did) & F.col("zauthorhandle").isNotNull()).select(F.col("zauthorhandle").alias("handle")).distinct().orderBy("handle")


def merged_ranges(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """I8: stored author ranges widened by seen ones; ``created_row`` tells new authors from updated ones."""
    old = stored.select(F.col("zdid").alias("zauthordid"), F.col("zfirstseenat").alias("old_first"), F.col("zlastseenat").alias("old_last"))
    both = old.join(seen, "zauthordid", "full")
    return both.select("zauthordid", F.least("old_first", "first_seen").alias("first_seen"), F.greatest("old_last", "last_seen").alias("last_seen"), F.col("old_first").isNull().alias("created_row"))

"""Root posts, their threads, the labelling pool and its context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import contains_text
from corpusloom.operators.authors import bounded
from corpusloom.operators.model import replies, roots

#: Terms of a curated list at most.
MAX_TERMS = 10_000

#: F19, the presets of the reply-count filter.
PRESETS: dict[str, tuple[int | None, int | None]] = {"any": (None, None), "1+": (1, None), "10+": (10, None), "50-99": (50, 99), "50+": (50, None), "100+": (100, None), "200+": (200, None)}


def preset_bounds(name: str, least: int | None = None, most: int | None = None) -> tuple[int | None, int | None]:
    """the bounds of a preset; 'custom' takes the given ones."""
    return (least, most) if name == "custom" else PRESETS[name]


def thread_sizes(p: DataFrame) -> DataFrame:
    """Replies of each stored root: one partial count a root and task."""
    return replies(p).filter("zrooturi IS NOT NULL").groupBy(F.col("zrooturi").alias("zuri")).agg(F.count("zuri").alias("n_replies"))


def root_posts(p: DataFrame, account: int | None = None, least: int | None = None, most: int | None = None, search: str | None = None) -> DataFrame:
    """Roots with their number of replies, those without replies too, filtered before and after counting.

    Counting first and joining the counts gives what a left join and a count would, with less to shuffle.
    """
    r = roots(p)
    if account is not None:
        r = r.filter(F.col("zaccount") == account)
    if search:
        r = r.filter(contains_text(F.col("ztext"), search) | contains_text(F.col("zauthorhandle"), search))
    counted = r.join(thread_sizes(p), "zuri", "left").withColumn("n_replies", F.coalesce("n_replies", F.lit(0)))
    return counted.filter(bounded(F.col("n_replies"), least, most)).select("zuri", "zaccount", "created", "n_replies")


def pool(p: DataFrame, since: float | None = None, until: float | None = None, outlet: int | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    """The replies a labelling frame draws from.

    The dates bound the reply itself; the size is that of the whole thread, whatever the dates.
    """
    out = replies(p).filter(F.length(F.trim("ztext")) > 0)
    if since is not None:
        out = out.filter(F.col("created") >= since)
    if until is not None:
        out = out.filter(F.col("created") <= until)
    if outlet is not None:
        mine = roots(p).filter(F.col("zaccount") == outlet).select(F.col("zuri").alias("zrooturi"))
        out = out.join(mine, "zrooturi", "left_semi")
    if least is not None or most is not None:
        sized = thread_sizes(p).filter(bounded(F.col("n_replies"), least, most)).select(F.col("zuri").alias("zrooturi"))
        out = out.join(sized, "zrooturi", "left_semi")
    return out


def labelling_context(p: DataFrame, uris: DataFrame) -> DataFrame:
    """What annotators see of the posts ``uris``: text, root and parent, and no score, label or model.

    The root has to exist (inner), the parent need not (left) and is hidden where it is the root itself.
    """
    mine = replies(p).join(uris.select("zuri"), "zuri", "left_semi").select("zuri", "ztext", "zrooturi", "zparenturi")
    top = roots(p).select(F.col("zuri").alias("zrooturi"), F.col("ztext").alias("root_text"))
    above = p.select(F.col("zuri").alias("zparenturi"), F.col("ztext").alias("_parent_text"))
    met = mine.join(top, "zrooturi").join(above, "zparenturi", "left")
    own = F.col("zparenturi").isNotNull() & (F.col("zparenturi") != F.col("zrooturi"))
    return met.select("zuri", "ztext", "zrooturi", "root_text", F.when(own, F.col("zparenturi")).alias("parent_uri"), F.when(own, F.col("_parent_text")).alias("parent_text"))


def search_terms(p: DataFrame, terms: DataFrame, text: str = "ztext") -> DataFrame:
    """for each curated substring the first post (by URI) that holds it, each post once, for its first term.

    terms: (term, rank), a curated list of at most MAX_TERMS; more are refused with an error. The terms travel as one
    array, so that each post is read once and no pairs are formed.
    """
    known = [r["term"] for r in terms.filter("term <> ''").orderBy("rank").limit(MAX_TERMS + 1).collect()]
    if len(known) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    if not known:
        return p.limit(0).select("zuri", F.lit("").alias("term"))
    at = F.filter(F.array(*[F.lit(t) for t in known]), lambda t: F.contains(F.lower(F.col(text)), F.lower(t)))
    hits = p.select("zuri", F.explode(at).alias("term")).groupBy("term").agg(F.min("zuri").alias("zuri"))
    rank = F.array_position(F.array(*[F.lit(t) for t in known]), F.col("term"))
    return hits.groupBy("zuri").agg(F.min_by("term", rank).alias("term"))


def rescrape_due(p: DataFrame, days: int = 14) -> DataFrame:
    """I4: the roots to fetch again: those not complete, never checked, or checked at most ``days`` after they were written."""
    state = F.lower(F.trim("zreplytreestatus"))
    checked = F.when(~F.isnan("zreplytreelastchecked"), F.col("zreplytreelastchecked"))
    due = F.coalesce(state != "complete", F.lit(True)) | checked.isNull() | (checked <= F.col("created") + days * 86400.0)
    return roots(p).select("zuri", F.coalesce(due, F.lit(False)).alias("due"))


def account_totals(p: DataFrame) -> DataFrame:
    """Likes, replies, reposts and quotes over the roots of each account."""
    sums = [F.coalesce(F.sum(f"z{x}count"), F.lit(0)).alias(f"total_{x}s") for x in ("like", "reply", "repost", "quote")]
    return roots(p).filter("zaccount IS NOT NULL").groupBy("zaccount").agg(F.count("*").alias("n_posts"), *sums)


def rotated(n: int, at: int) -> Column:
    """A position in a queue of ``n`` that starts at ``at`` (negative ones too)."""
    return F.pmod(F.col("position") - F.lit(at), F.lit(n))

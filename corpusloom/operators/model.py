"""The tables as the other operators see them: one row for each URI, plain classes, scores and labels as logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.uri import normal_uuid, strip


def number(c: Column) -> Column:
    """A stored double, NULL where it is NaN."""
    return F.when(~F.isnan(c), c)


def unique_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row by ``order`` of each key; what is delivered again is ignored.

    Each column is taken by its own aggregate, so that unused columns are pruned and rows combine before the shuffle.
    Rows with a NULL key are dropped.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    first = df.dropna(subset=keys).groupBy(*keys).agg(F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in rest])
    return first.select(*df.columns)


def posts(zpost: DataFrame) -> DataFrame:
    """zpost with one row for each zuri and ``created``, the time without NaN."""
    return unique_rows(zpost.withColumn("created", number(F.col("zcreatedat"))), ["zuri"], "z_pk")


def posts_where(zpost: DataFrame, condition: Column) -> DataFrame:
    """posts(zpost).filter(condition), for conditions that few rows meet.

    A filter cannot pass the choice of the first row of a URI. So the URIs with any row that meets ``condition`` are
    found first, by a filter the scan takes over, and only their rows are compared; the whole table is not shuffled.
    """
    some = zpost.withColumn("created", number(F.col("zcreatedat")))
    near = some.filter(condition).select("zuri").distinct()
    return unique_rows(some.join(near, "zuri", "left_semi"), ["zuri"], "z_pk").filter(condition)


def replies(p: DataFrame) -> DataFrame:
    """the posts that are no roots."""
    return p.filter("zisrootpost = 0")


def roots(p: DataFrame) -> DataFrame:
    """the root posts."""
    return p.filter("zisrootpost = 1")


def with_root(r: DataFrame, p: DataFrame, how: str = "inner", extra: list[str] = []) -> DataFrame:
    """Replies with the ``outlet`` of their stored root; 'inner' drops those whose root is missing."""
    top = roots(p).select(F.col("zuri").alias("zrooturi"), F.col("zaccount").alias("outlet"), *[F.col(c).alias(f"root_{c}") for c in extra])
    return r.join(top, "zrooturi", how)


def notes(zannotation: DataFrame) -> DataFrame:
    """Annotations with stage, class and annotator in lower case without outer blanks, and batches as plain UUIDs."""
    clean = lambda c: F.lower(strip(F.col(c)))
    return zannotation.select(
        "z_pk", clean("zstage").alias("stage"), clean("zspeechclass").alias("class"), clean("zseverity").alias("severity"), number(F.col("zconfidence")).alias("confidence"),
        F.col("zmodelname").alias("model"), clean("zannotatorid").alias("annotator"), normal_uuid(F.col("zbatchid")).alias("batch"), F.col("zpassnumber").alias("pass"),
        F.col("zpost").alias("post"), number(F.col("zcreatedat")).alias("created"),
    )


#: The classes of speech.
CLASSES = ["hate", "counter", "neutral"]


def score_log(n: DataFrame, p: DataFrame) -> DataFrame:
    """Model judgements as a score log: (uri, head, model, score of hate, scored_at, seq)."""
    rows = n.filter((F.col("stage") == "llm") & F.col("class").isin(CLASSES) & F.col("confidence").isNotNull())
    score = F.when(F.col("class") == "hate", F.col("confidence")).otherwise(1 - F.col("confidence"))
    return rows.join(p.select(F.col("z_pk").alias("post"), F.col("zuri").alias("uri")), "post").select(
        "uri", F.lit("hate").alias("head"), "model", score.alias("score"), F.col("created").alias("scored_at"), F.col("z_pk").alias("seq")
    )


def label_log(n: DataFrame, p: DataFrame) -> DataFrame:
    """Human labels as a moderation-label log: (uri, val, cts, neg, seq); the second pass retracts."""
    rows = n.filter((F.col("stage") == "human") & F.col("class").isin(CLASSES))
    return rows.join(p.select(F.col("z_pk").alias("post"), F.col("zuri").alias("uri")), "post").select(
        "uri", F.col("class").alias("val"), F.col("created").alias("cts"), F.coalesce(F.col("pass") == 2, F.lit(False)).alias("neg"), F.col("z_pk").alias("seq")
    )


def messages(m: DataFrame) -> DataFrame:
    """The first fetch of each (channel, msg_id)."""
    return unique_rows(m, ["channel", "msg_id"], "fetched_at")

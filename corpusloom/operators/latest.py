"""Logs of which the last entry counts, and the labels and annotations kept in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.stats import share, wilson


def last_by(rows: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Of each key the row that is last by ``order`` (NULLs first); ``order`` has to end with a key of the row.

    An aggregate and not a window: rows combine before the shuffle, and a key with many rows is no burden.
    """
    last = F.max_by(F.struct(*keep), F.struct(*[F.col(c) for c in order]))
    return rows.groupBy(*keys).agg(last.alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in keep])


def latest_scores(log: DataFrame, head: str = "hate") -> DataFrame:
    """The last score of each URI in log order."""
    return last_by(log.filter(F.col("head") == head), ["uri"], ["seq"], ["score", "model", "scored_at"])


def latest_scores_by_time(log: DataFrame, head: str = "hate") -> DataFrame:
    """The score of each URI that was made last; of equal times the one seen last."""
    return last_by(log.filter(F.col("head") == head), ["uri"], ["scored_at", "seq"], ["score", "model", "scored_at"])


def active_then_latest(log: DataFrame) -> DataFrame:
    """labels that retract nothing, then the last of each (URI, value)."""
    return last_by(log.filter(~F.col("neg")), ["uri", "val"], ["cts", "seq"], ["cts"])


def latest_then_active(log: DataFrame) -> DataFrame:
    """The last label of each (URI, value), then without those that are retracted."""
    return last_by(log, ["uri", "val"], ["cts", "seq"], ["cts", "neg"]).filter(~F.col("neg")).drop("neg")


def label_values(active: DataFrame) -> DataFrame:
    """The different label values of each URI, sorted and joined by commas."""
    return active.groupBy("uri").agg(F.array_join(F.array_sort(F.collect_set("val")), ",").alias("labels"))


def sweep_counts(log: DataFrame) -> DataFrame:
    """Labels by value, active and retracted ones apart."""
    return log.groupBy("val").agg(F.count_if(~F.col("neg")).alias("n_active"), F.count_if(F.col("neg")).alias("n_negated"))


def sweep_subjects(log: DataFrame) -> DataFrame:
    """Subjects with an active label, and those with retracted ones only."""
    per = log.groupBy("uri").agg(F.bool_or(~F.col("neg")).alias("active"))
    return per.agg(F.count_if("active").alias("n_active_subjects"), F.count_if(~F.col("active")).alias("n_negated_subjects"))


def newest_by_stage(n: DataFrame) -> DataFrame:
    """The newest annotation of each (post, stage)."""
    return last_by(n.filter("post IS NOT NULL"), ["post", "stage"], ["created", "z_pk"], ["z_pk", "class"])


def deduplicated(n: DataFrame) -> DataFrame:
    """Annotations without older model ones of the same post and model; other stages and rows without post stay."""
    ours = (F.col("stage") == "llm") & F.col("post").isNotNull()
    kept = last_by(n.filter(ours), ["post", "model"], ["created", "z_pk"], ["z_pk"]).select("z_pk")
    return kept.unionByName(n.filter(~F.coalesce(ours, F.lit(False))).select("z_pk"))


def latest_predictions(n: DataFrame) -> DataFrame:
    """The newest model prediction of each (post, model) with confidence above 0."""
    ours = n.filter((F.col("stage") == "llm") & F.col("post").isNotNull() & (F.col("confidence") > 0))
    return last_by(ours, ["post", "model"], ["created", "z_pk"], ["class", "confidence"])


def shared_by_models(predictions: DataFrame, models: int) -> DataFrame:
    """Posts that at least ``models`` models judged."""
    return predictions.groupBy("post").agg(F.countDistinct("model").alias("n_models")).filter(F.col("n_models") >= models)


def preferred(core: DataFrame, hard: DataFrame, key: str) -> DataFrame:
    """The union of two tagged lists; a key in both is 'hard', whatever the order."""
    both = core.select(key).withColumn("tag", F.lit("core")).unionByName(hard.select(key).withColumn("tag", F.lit("hard")))
    return both.groupBy(key).agg(F.max("tag").alias("tag"))


def hard_first(entries: DataFrame, key: str, tag: str = "tag") -> DataFrame:
    """Entries with the tag 'hard' before all others, each part by ``key``."""
    return entries.orderBy(F.coalesce(F.col(tag) != "hard", F.lit(True)), key)


def merged_entries(fresh: DataFrame, existing: DataFrame, key: str, curated: list[str]) -> DataFrame:
    """Fresh entries with the curated fields of existing ones kept."""
    kept = existing.select(key, *[F.col(c).alias(f"_{c}") for c in curated])
    met = fresh.join(kept, key, "left")
    return met.select(*[F.coalesce(f"_{c}", c).alias(c) if c in curated else F.col(c) for c in fresh.columns])


def batch_outcomes(n: DataFrame, batches: DataFrame) -> DataFrame:
    """Each human annotation with the reason why it counts or not, never dropped.

    batches: (batch, kind, pass), one row for each batch. A batch that is no UUID, unknown, not drawn at random, or of
    another pass excludes the label; so does no class.
    """
    human = n.filter(F.col("stage") == "human")
    met = human.join(batches.select("batch", F.col("kind"), F.col("pass").alias("batch_pass")), "batch", "left")
    reason = (
        F.when(F.col("batch").isNull(), "no_batch").when(F.col("batch_pass").isNull() & F.col("kind").isNull(), "unknown_batch").when(F.col("kind").isNull(), "bad_frame")
        .when(F.col("kind") != "uniformRandom", "not_random").when(F.col("batch_pass") != 1, "second_pass").when(~F.coalesce(F.col("class").isin("hate", "counter", "neutral"), F.lit(False)), "no_class").otherwise("counted")
    )
    return met.select("z_pk", "class", "post", reason.alias("reason"))


def base_rate_counts(outcomes: DataFrame) -> DataFrame:
    """Annotations by reason and class."""
    return outcomes.groupBy("reason", F.coalesce("class", F.lit("none")).alias("class")).agg(F.count("*").alias("n"))


def base_rate(outcomes: DataFrame) -> DataFrame:
    """Hateful share of the counted labels with Wilson ends; 'no_data' and NULL, never 0, without any."""
    sums = outcomes.agg(F.count_if(F.col("reason") == "counted").alias("n"), F.count_if((F.col("reason") == "counted") & (F.col("class") == "hate")).alias("n_hate"))
    low, high = wilson(F.col("n_hate"), F.col("n"))
    some = F.col("n") > 0
    return sums.select("n", "n_hate", share(F.col("n_hate"), F.col("n")).alias("rate"), F.when(some, low).alias("low"), F.when(some, high).alias("high"), F.when(some, F.lit("ok")).otherwise(F.lit("no_data")).alias("status"))


def subject_class(labels: Column, positive: list[str], negative: list[str]) -> Column:
    """C19: 'positive' before 'hard_negative', NULL for neither, by overlap with a label array."""
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    return F.when(F.arrays_overlap(labels, lits(positive)), "positive").when(F.arrays_overlap(labels, lits(negative)), "hard_negative")


def pending(n: DataFrame, p: DataFrame, model: str, newest: int = 1000, batch: int = 100) -> DataFrame:
    """Of the ``newest`` posts those that ``model`` has not judged, at most ``batch`` of them.

    The first limit comes before the anti join: posts further back are not looked at.
    """
    recent = p.orderBy(F.desc_nulls_last("created"), "zuri").limit(newest)
    judged = n.filter((F.col("stage") == "llm") & (F.col("model") == model) & F.col("post").isNotNull()).select(F.col("post").alias("z_pk")).distinct()
    return recent.join(judged, "z_pk", "left_anti").orderBy(F.desc_nulls_last("created"), "zuri").limit(batch).select("zuri")


def coverage(n: DataFrame, p: DataFrame) -> DataFrame:
    """Posts newer than the newest annotated one ('forward') and others not annotated yet ('backlog')."""
    done = n.filter((F.col("stage") == "llm") & F.col("post").isNotNull()).select(F.col("post").alias("z_pk")).distinct()
    marked = p.select("z_pk", "created").join(done.withColumn("done", F.lit(True)), "z_pk", "left")
    mark = marked.filter("done").agg(F.max("created").alias("mark")).withColumn("_k", F.lit(0))
    open_ = marked.filter("done IS NULL AND created IS NOT NULL").withColumn("_k", F.lit(0)).join(F.broadcast(mark), "_k")
    return open_.groupBy(F.when(F.col("created") > F.col("mark"), "forward").otherwise("backlog").alias("part")).agg(F.count("*").alias("n_posts"))


def queue_counts(n: DataFrame, p: DataFrame, model: str) -> DataFrame:
    """Posts, judged ones, and the rest, at least 0."""
    total = p.agg(F.count("*").alias("n_posts")).withColumn("_k", F.lit(0))
    done = n.filter((F.col("stage") == "llm") & (F.col("model") == model)).agg(F.countDistinct("post").alias("n_judged")).withColumn("_k", F.lit(0))
    return total.join(F.broadcast(done), "_k").select("n_posts", "n_judged", F.greatest(F.lit(0), F.col("n_posts") - F.col("n_judged")).alias("n_pending"))


def class_counts(n: DataFrame, p: DataFrame) -> DataFrame:
    """Of each account's roots: posts, those last judged hate, counter and neutral, pending ones, and ratios of the judged."""
    newest = last_by(n.filter("stage = 'llm' AND post IS NOT NULL"), ["post"], ["created", "z_pk"], ["class"]).select(F.col("post").alias("z_pk"), "class")
    rows = p.filter("zisrootpost = 1 AND zaccount IS NOT NULL").select("z_pk", "zaccount").join(newest, "z_pk", "left")
    c = lambda k: F.count_if(F.col("class") == k)
    out = rows.groupBy("zaccount").agg(F.count("*").alias("n"), c("hate").alias("n_hate"), c("counter").alias("n_counter"), c("neutral").alias("n_neutral"))
    judged = F.col("n_hate") + F.col("n_counter") + F.col("n_neutral")
    return out.select("*", (F.col("n") - judged).alias("n_pending"), F.when(judged > 0, F.col("n_hate") / judged).otherwise(F.lit(0.0)).alias("hate_ratio"))


def thread_counts(n: DataFrame, p: DataFrame) -> DataFrame:
    """Of each thread (stored root) the posts judged hate and counter, and those pending."""
    newest = last_by(n.filter("stage = 'llm' AND post IS NOT NULL"), ["post"], ["created", "z_pk"], ["class"]).select(F.col("post").alias("z_pk"), "class")
    rows = p.filter("zrooturi IS NOT NULL").select("z_pk", "zrooturi").join(newest, "z_pk", "left")
    return rows.groupBy("zrooturi").agg(F.count_if(F.col("class") == "hate").alias("n_hate"), F.count_if(F.col("class") == "counter").alias("n_counter"), F.count_if(F.col("class").isNull()).alias("n_pending"))


def lineages(n: DataFrame) -> DataFrame:
    """U8: the different (stage, model) pairs."""
    return n.select("stage", "model").distinct()


def material_changes(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Observations that differ from the one before of the same key; the first always stays."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(*order)
    now = F.struct(*values)
    return rows.withColumn("_before", F.lag(now).over(w)).filter(F.col("_before").isNull() | ~now.eqNullSafe(F.col("_before"))).drop("_before")

"""Whole reports made of the operators beside: sealed predictions against labels, evaluation sets, detector and model tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.stats import share, wilson
from corpusloom.functions.text import has_text
from corpusloom.operators import latest, metrics, model, sampling
from corpusloom.operators.roots import search_terms
from corpusloom.session import durable

#: Fixed value: sealed predictions are compared with at least this many labels.
LEAST_LABELS = 30
#: The classes of an evaluation set.
POSITIVE, HARD, EASY = "positive", "hard_negative", "easy_negative"


def comparison(predictions: DataFrame, labels: DataFrame, a: str, b: str, least: int = LEAST_LABELS) -> DataFrame:
    """Two models' sealed predictions against human labels, one row a model.

    predictions: (uri, model, score), one row for each pair; labels: (uri, hate), one row for each labelled post. Each
    model is compared on all labelled posts; those without a score count as n_null and in nothing else. Every row also
    has the hateful share of the labels with its Wilson interval, and how the two models agree over all posts both
    scored. Fewer than ``least`` labels are refused with a ValueError.
    """
    labels = durable(labels.select("uri", "hate"), "labels")
    low, high = wilson(F.col("n_hate"), F.col("n_labels"))
    base = labels.agg(F.count("*").alias("n_labels"), F.count_if("hate").alias("n_hate")).select("*", share(F.col("n_hate"), F.col("n_labels")).alias("prevalence"), low.alias("low"), high.alias("high")).first()
    if base["n_labels"] < least:
        raise ValueError(f"{base['n_labels']} labels, at least {least} are needed")
    ours = durable(predictions.filter(F.col("model").isin(a, b)).select("uri", "model", "score"), "predictions")
    rows = labels.select("uri", "hate", F.explode(F.array(F.lit(a), F.lit(b))).alias("model")).join(ours, ["uri", "model"], "left")
    pair = ours.groupBy("uri").agg(*[F.max(F.when(F.col("model") == m, F.col("score"))).alias(c) for m, c in ((a, "a"), (b, "b"))])
    both = metrics.spearman(pair, "a", "b", "uri").first()
    auc = metrics.roc_auc(rows, "score", "hate", ["model"]).select("model", "auc")
    at = metrics.at_threshold(rows, "score", "hate", ["model"]).withColumnRenamed("n", "n_compared")
    return at.join(auc, "model", "left").withColumns(
        {c: F.lit(base[c]) for c in ("n_labels", "n_hate", "prevalence", "low", "high")} | {"n_both": F.lit(both["n"]), "spearman": F.lit(both["spearman"]).cast("double"), "agreement": F.lit(both["agreement"]).cast("double")}
    )


def evaluation_set(labels: DataFrame, p: DataFrame, positive: list[str], negative: list[str], ratio: float, seed: int) -> DataFrame:
    """(zuri, text, class, labels): labelled posts as positives and hard negatives, and unlabelled replies as easy ones.

    labels: (uri, labels array), one row for each labelled post. Posts without text are left out before counting; of easy
    negatives round(ratio n) are drawn for n positives, from the replies with text that bear no label at all.
    """
    texts = p.filter(has_text(F.col("ztext"))).select(F.col("zuri").alias("uri"), F.col("ztext").alias("text"))
    kinds = labels.select("uri", latest.subject_class(F.col("labels"), positive, negative).alias("class"), "labels")
    judged = durable(kinds.filter(F.col("class").isNotNull()).join(texts, "uri"), "judged")
    pool = model.replies(p).filter(has_text(F.col("ztext"))).select("zuri")
    easy = sampling.control_sample(pool, "zuri", labels.select(F.col("uri").alias("zuri")), ratio, judged.filter(F.col("class") == POSITIVE).count(), seed)
    drawn = easy.select(F.col("zuri").alias("uri"), F.lit(EASY).alias("class"), F.array().cast("array<string>").alias("labels")).join(texts, "uri")
    return judged.unionByName(drawn).select(F.col("uri").alias("zuri"), "text", "class", "labels")


def detector_report(rows: DataFrame) -> DataFrame:
    """For each detector the ROC and PR area and the best F1 of positives against easy and against hard negatives.

    rows: (detector, class, score). Best against hard negatives first, without such an area last (O7).
    """
    parts = []
    for name, negative in (("hard", HARD), ("easy", EASY)):
        some = durable(rows.filter(F.col("class").isin(POSITIVE, negative) & F.col("score").isNotNull()).select("detector", "score", (F.col("class") == POSITIVE).alias("y")), f"{name}s")
        auc = metrics.roc_auc(some, "score", "y", ["detector"]).select("detector", F.col("n_pos").alias("n_positive"), F.col("n_neg").alias(f"n_{name}"), F.col("auc").alias(f"auc_{name}"))
        t = durable(metrics.thresholds(some, "score", "y", ["detector"]), f"{name}_thresholds")
        ap = metrics.average_precision_of(t, ["detector"]).withColumnRenamed("average_precision", f"pr_auc_{name}")
        f1 = metrics.best_f1_of(t, ["detector"]).select("detector", F.col("f1").alias(f"best_f1_{name}"))
        parts.append(reduce(lambda x, y: x.join(y, "detector", "left"), [auc.drop("n_positive") if parts else auc, ap, f1]))
    return parts[0].join(parts[1], "detector", "full").orderBy(F.desc_nulls_last("auc_hard"), "detector")


def benchmark(gold: DataFrame, predictions: DataFrame, classes: list[str] = model.CLASSES) -> DataFrame:
    """Each model against gold labels: posts, accuracy, F1 of each class and their mean over all ``classes``.

    gold: (post, truth); predictions: (post, model, class), one row for each pair. A class without any gold or predicted
    post has an F1 of 0, and the mean counts it.
    """
    met = predictions.select("post", "model", "class").join(gold.select("post", "truth"), "post")
    c = F.col
    def f1(k: str) -> Column:
        tp, both = F.count_if((c("class") == k) & (c("truth") == k)), F.count_if(c("class") == k) + F.count_if(c("truth") == k)
        return F.when(both > 0, 2 * tp / both).otherwise(F.lit(0.0))
    sums = met.groupBy("model").agg(F.count("*").alias("n"), (F.count_if(c("class") == c("truth")) / F.count("*")).alias("accuracy"), *[f1(k).alias(f"f1_{k}") for k in classes])
    return sums.withColumn("macro_f1", sum((c(f"f1_{k}") for k in classes), F.lit(0.0)) / len(classes))


def disagreements(gold: DataFrame, predictions: DataFrame, tags: DataFrame) -> DataFrame:
    """Posts with gold label and tag whose predictions do not all agree with it (or that have none), hard cases first."""
    wrong = predictions.join(gold, "post").groupBy("post").agg(F.count("*").alias("n"), F.count_if(F.col("class") == F.col("truth")).alias("n_right"))
    met = tags.join(gold, "post").join(wrong, "post", "left").filter("n IS NULL OR n_right < n")
    return latest.hard_first(met.select("post", "tag", "truth", F.coalesce("n", F.lit(0)).alias("n_models"), F.coalesce("n_right", F.lit(0)).alias("n_right")), "post")


def benchmark_set(predictions: DataFrame, p: DataFrame, models: list[str], terms: DataFrame, existing: DataFrame, curated: list[str]) -> DataFrame:
    """(zuri, text, tag, ``curated``): posts that all ``models`` judged and posts found by curated terms.

    A post that is both is 'hard'. What people entered before (``existing``: zuri and the curated columns) is kept.
    """
    judged = latest.shared_by_models(predictions.filter(F.col("model").isin(models)), len(models)).select("post")
    core = p.join(judged.withColumnRenamed("post", "z_pk"), "z_pk", "left_semi").select("zuri")
    both = latest.preferred(core, search_terms(p, terms).select("zuri"), "zuri")
    fresh = both.join(p.select("zuri", F.coalesce("ztext", F.lit("")).alias("text")), "zuri").select("zuri", "text", "tag", *[F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in curated])
    return latest.merged_entries(fresh, existing, "zuri", curated)

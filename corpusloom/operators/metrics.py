"""How well detectors, models and people agree with labels and with each other."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.stats import share
from corpusloom.operators.ranks import with_rank, with_running
from corpusloom.session import durable

#: Fixed value: a language is reported, but its AUC suppressed, with fewer rows of either class.
LEAST_PER_CLASS = 20
#: Queries of a similarity search that are sent to the vectors at once.
QUERY_BLOCK = 4096


def roc_auc(rows: DataFrame, score: str, label: str, by: list[str] = []) -> DataFrame:
    """Area under the ROC curve, ties count half; NULL where a class is empty.

    Rows are counted by score first. Ranks run over distinct scores, ``by`` first, so no task ranks all rows.
    """
    y = F.col(label).cast("int")
    per = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.sum(y).alias("pos"), F.count("*").alias("k"))
    run = with_running(per, [*by, score], {"upto": "k"})
    first = run.groupBy(*by).agg(F.min(F.col("upto") - F.col("k")).alias("skip"))
    met = run.join(F.broadcast(first), by) if by else run.withColumn("skip", F.lit(0))
    rank = F.col("upto") - F.col("skip") - (F.col("k") - 1) / 2
    sums = met.groupBy(*by).agg(F.sum(rank * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("k").alias("n"))
    neg = F.col("n") - F.col("p")
    return sums.select(*by, F.col("p").alias("n_pos"), neg.alias("n_neg"), F.when((F.col("p") > 0) & (neg > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg)).alias("auc"))


def thresholds(rows: DataFrame, score: str, label: str, by: list[str] = []) -> DataFrame:
    """(``by``, threshold, pos, k, tp, flagged): true and false positives at each distinct score, from the highest down."""
    y = F.col(label).cast("int")
    per = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.sum(y).alias("pos"), F.count("*").alias("k"))
    run = with_running(per, [*by, F.desc(score)], {"tp": "pos", "flagged": "k"})
    if by:
        first = run.groupBy(*by).agg(F.min(F.col("tp") - F.col("pos")).alias("_t"), F.min(F.col("flagged") - F.col("k")).alias("_f"))
        run = run.join(F.broadcast(first), by).withColumns({"tp": F.col("tp") - F.col("_t"), "flagged": F.col("flagged") - F.col("_f")})
    return run.select(*by, F.col(score).alias("threshold"), "pos", "k", "tp", "flagged")


def average_precision_of(t: DataFrame, by: list[str] = []) -> DataFrame:
    """M20 from thresholds()."""
    return t.groupBy(*by).agg(F.sum(F.col("pos") * F.col("tp") / F.col("flagged")).alias("a"), F.sum("pos").alias("p")).select(*by, share(F.col("a"), F.col("p")).alias("average_precision"))


def average_precision(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the precision-recall curve as a step sum over distinct thresholds; NULL without positives."""
    return average_precision_of(thresholds(rows, score, label))


def best_f1_of(t: DataFrame, by: list[str] = []) -> DataFrame:
    """M21 from thresholds()."""
    all_ = t.withColumn("_k", F.lit(0)).groupBy(*by, "_k").agg(F.sum("pos").alias("p"))
    scored = t.withColumn("_k", F.lit(0)).join(F.broadcast(all_), [*by, "_k"]).withColumn("f1", F.when(F.col("flagged") + F.col("p") > 0, 2 * F.col("tp") / (F.col("flagged") + F.col("p"))))
    best = scored.groupBy(*by).agg(F.max(F.struct("f1", (-F.col("threshold")).alias("below"))).alias("best"))
    return best.select(*by, F.col("best.f1").alias("f1"), (-F.col("best.below")).alias("threshold"))


def best_f1(rows: DataFrame, score: str, label: str) -> DataFrame:
    """The best F1 and its threshold, the lowest of equals."""
    return best_f1_of(thresholds(rows, score, label))


def auc_by_language(rows: DataFrame, score: str, label: str, lang: str) -> DataFrame:
    """AUC of each language; listed with NULL where either class has fewer than LEAST_PER_CLASS rows."""
    enough = (F.col("n_pos") >= LEAST_PER_CLASS) & (F.col("n_neg") >= LEAST_PER_CLASS)
    return roc_auc(rows, score, label, [lang]).withColumn("auc", F.when(enough, F.col("auc")))


def at_threshold(rows: DataFrame, score: str, label: str, by: list[str], t: float = 0.5) -> DataFrame:
    """Accuracy, precision and recall at ``t`` (inclusive), 0 where nothing is flagged or positive."""
    flag, y = F.col(score) >= t, F.col(label).cast("boolean")
    sums = rows.groupBy(*by).agg(
        F.count(score).alias("n"), F.count_if(F.col(score).isNull()).alias("n_null"), F.count_if(flag & y).alias("tp"), F.count_if(flag & ~y).alias("fp"), F.count_if(~flag & y).alias("fn"), F.count_if(~flag & ~y).alias("tn"),
    )
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    c = F.col
    return sums.select(*by, "n", "n_null", zero(c("tp") + c("tn"), c("n")).alias("accuracy"), zero(c("tp"), c("tp") + c("fp")).alias("precision"), zero(c("tp"), c("tp") + c("fn")).alias("recall"))


def class_report(rows: DataFrame, truth: str, given: str) -> DataFrame:
    """Precision, recall and F1 of each class that occurs in either column."""
    cells = rows.groupBy(truth, given).agg(F.count("*").alias("k"))
    both = cells.select(F.col(truth).alias("class"), F.when(F.col(truth) == F.col(given), F.col("k")).otherwise(F.lit(0)).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col(truth) != F.col(given), F.col("k")).otherwise(F.lit(0)).alias("fn")).unionByName(
        cells.filter(F.col(truth) != F.col(given)).select(F.col(given).alias("class"), F.lit(0).cast("long").alias("tp"), F.col("k").alias("fp"), F.lit(0).cast("long").alias("fn"))
    )
    sums = both.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    c = F.col
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return sums.select("class", "tp", "fp", "fn", zero(c("tp"), c("tp") + c("fp")).alias("precision"), zero(c("tp"), c("tp") + c("fn")).alias("recall"), zero(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"))


def macro(report: DataFrame, rows: DataFrame, truth: str, given: str) -> DataFrame:
    """Accuracy and the mean F1 of the classes."""
    hits = rows.agg(F.count("*").alias("n"), F.count_if(F.col(truth) == F.col(given)).alias("k")).withColumn("_k", F.lit(0))
    mean = report.agg(F.avg("f1").alias("macro_f1")).withColumn("_k", F.lit(0))
    return hits.join(F.broadcast(mean), "_k").select("n", share(F.col("k"), F.col("n")).alias("accuracy"), "macro_f1")


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Percent agreement and Cohen's kappa; NULL without pairs, 1 for one class on both sides, 0 where undefined."""
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("k"))
    rows = cells.select(F.col(a).alias("class"), F.col("k").alias("x"), F.lit(0).cast("long").alias("y")).unionByName(cells.select(F.col(b).alias("class"), F.lit(0).cast("long").alias("x"), F.col("k").alias("y")))
    chance = rows.groupBy("class").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).agg(F.sum(F.col("x") * F.col("y")).alias("pe")).withColumn("_k", F.lit(0))
    total = cells.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("k")).otherwise(F.lit(0))).alias("same")).withColumn("_k", F.lit(0))
    met = total.join(F.broadcast(chance), "_k")
    n = F.col("n").cast("double")
    po, pe = F.col("same") / n, F.col("pe") / (n * n)
    return met.select("n", F.when(n > 0, po).alias("agreement"), F.when(n > 0, F.when(pe < 1, (po - pe) / (1 - pe)).when(po == 1, F.lit(1.0)).otherwise(F.lit(0.0))).alias("kappa"))


def model_agreement(predictions: DataFrame, item: str, model: str, label: str) -> DataFrame:
    """For each pair of models the share of common items with equal labels.

    Items have one row a model; models are few, so an item makes few pairs.
    """
    left = predictions.select(item, F.col(model).alias("model_a"), F.col(label).alias("_a"))
    right = predictions.select(item, F.col(model).alias("model_b"), F.col(label).alias("_b"))
    pairs = left.join(right, item).filter(F.col("model_a") < F.col("model_b"))
    return pairs.groupBy("model_a", "model_b").agg(F.count("*").alias("n_shared"), F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("agreement"))


def spearman(rows: DataFrame, a: str, b: str, key: str, t: float = 0.5) -> DataFrame:
    """Rank correlation (mean ranks for ties) and agreement at ``t``; NULL for under two rows or a constant side."""
    pairs = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(key, a, b)
    for c in (a, b):
        ranked = with_rank(pairs, [c, key], "_r")
        means = ranked.groupBy(c).agg(F.avg("_r").alias(f"_{c}"))
        pairs = ranked.drop("_r").join(means, c)
    x, y = F.col(f"_{a}"), F.col(f"_{b}")
    out = pairs.agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"), F.avg(((F.col(a) >= t) == (F.col(b) >= t)).cast("double")).alias("agreement"))
    fine = (F.col("n") > 1) & (F.col("sx") > 0) & (F.col("sy") > 0)
    return out.select("n", F.when(fine, F.col("c") / (F.col("sx") * F.col("sy"))).alias("spearman"), F.when(F.col("n") > 0, F.col("agreement")).alias("agreement"))


def folds_summary(folds: DataFrame, value: str, train: str) -> DataFrame:
    """Mean and sample deviation over folds, and how much better training scores are."""
    return folds.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.avg(F.col(train) - F.col(value)).alias("overfit_gap"))


def nearest(vectors: DataFrame, key: str, vector: str, queries: DataFrame, n: int, block: int = QUERY_BLOCK) -> DataFrame:
    """For each of the ``queries`` (a stated set) its ``n`` most similar vectors by cosine; ties go by key.

    Queries travel to the vectors in blocks of at most ``block``, each in a pass of its own; every task keeps its own best
    n, and those are ranked. A query is no match of itself; a vector of zeros has a cosine of 0 with all.
    """
    ranked = with_rank(queries.select(key, vector).filter(F.col(key).isNotNull() & F.col(vector).isNotNull()), [key], "_q")
    total = ranked.count()
    parts = [durable(_nearest(vectors, key, vector, ranked.filter((F.col("_q") > low) & (F.col("_q") <= low + block)).drop("_q").orderBy(key).toPandas(), n), "nearest") for low in range(0, total, block)]
    if not parts:
        return vectors.select(F.col(key).alias("query"), F.col(key).alias("match"), F.lit(0.0).alias("cosine")).limit(0)
    return reduce(DataFrame.unionByName, parts)


def _nearest(vectors: DataFrame, key: str, vector: str, own: pd.DataFrame, n: int) -> DataFrame:
    q = np.array(own[vector].tolist(), dtype=np.float64)
    norms = np.linalg.norm(q, axis=1, keepdims=True)
    q = np.divide(q, norms, out=np.zeros_like(q), where=norms > 0)
    held = vectors.sparkSession.sparkContext.broadcast((own[key].to_numpy(), q))

    def best(batches):
        ids, q = held.value
        top_s, top_i = np.full((len(ids), n), -2.0), np.zeros((len(ids), n), dtype=np.int64)
        for pdf in batches:
            pdf = pdf[pdf[vector].notna() & pdf[key].notna()]
            if not len(pdf):
                continue
            v = np.array(pdf[vector].tolist(), dtype=np.float64)
            lengths = np.linalg.norm(v, axis=1, keepdims=True)
            s = q @ np.divide(v, lengths, out=np.zeros_like(v), where=lengths > 0).T
            mine = pdf[key].to_numpy(np.int64)
            s[ids[:, None] == mine[None, :]] = -2.0
            both, who = np.hstack([top_s, s]), np.hstack([top_i, np.broadcast_to(mine, s.shape)])
            order = np.lexsort((who, -both), axis=1)[:, :n]
            top_s, top_i = np.take_along_axis(both, order, 1), np.take_along_axis(who, order, 1)
        keep = top_s > -2
        yield pd.DataFrame({"query": ids[np.nonzero(keep)[0]], "match": top_i[keep], "cosine": top_s[keep]})

    found = vectors.select(key, vector).mapInPandas(best, "query long, match long, cosine double")
    w = W.partitionBy("query").orderBy(F.desc("cosine"), "match")
    return found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")

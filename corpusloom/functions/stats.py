"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of the intervals.
Z = 1.96


def share(part: Column, whole: Column) -> Column:
    """part / whole, NULL where whole is 0."""
    return F.when(whole != 0, part / whole)


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """M6: lower and upper end of the Wilson interval, clipped to [0, 1]; (0, 0) for n = 0."""
    p = successes / n
    base = 1 + Z * Z / n
    mid = (p + Z * Z / (2 * n)) / base
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / base
    low = F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(F.lit(0.0))
    high = F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(F.lit(0.0))
    return low, high


def false_per_true(p: Column) -> Column:
    """M7: expected false alarms for each true one at base rate ``p``, with 0.05 false and 0.88 true positives."""
    return F.when(p > 0, 0.05 * (1 - p) / (0.88 * p))


def depth_bucket(depth: Column) -> Column:
    """M11: '1', '2', '3', '4+'; 'unknown' for all else."""
    return F.when(depth.between(1, 3), depth.cast("string")).when(depth >= 4, F.lit("4+")).otherwise(F.lit("unknown"))


def language_bucket(lang: Column) -> Column:
    """En, de or other, by the first two letters in any case."""
    two = F.lower(F.substring(F.trim(lang), 1, 2))
    return F.when(two.isin("en", "de"), two).otherwise(F.lit("other"))


def signed_score(kind: Column, confidence: Column) -> Column:
    """Positive counts up, negative down, all else 0."""
    return F.when(kind == "positive", confidence).when(kind == "negative", -confidence).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 where one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def time_left(elapsed: Column, processed: Column, total: Column) -> Column:
    """Seconds to go at the running average of those processed; NULL before the first and after the last."""
    return F.when((processed > 0) & (processed < total), elapsed / processed * (total - processed))

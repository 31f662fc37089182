"""Consensus of annotators who disagree, by spectral reliability.

The agreement matrix over annotators holds, for each pair, how much more often the two gave the same class than chance
would have it, summed over the posts they share. Its leading eigenvector, corrected for how many posts each pair shares,
gives each annotator's reliability: t is sought with C[a, b] close to m[a, b] t[a] t[b] for all pairs, where m counts the
shared posts. Each step of the power iteration divides C t by the sum of m[a, b] t[b]^2, so that every pair counts by its
own overlap; with equal overlaps this is the plain power iteration.

The matrix is never formed: a product with it is a pass of sparse joins, from annotator weights to sums per post and back,
so that a post with many votes costs its votes and not their pairs. A last product, not summed over classes, tells what
a vote of each annotator for each class says about the consensus of the others; those profiles weight the votes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.uri import strip
from corpusloom.operators.skew import HOT_ROWS, hot_keys, lookup_join, skew_join
from corpusloom.session import durable

#: The classes that count as votes.
CLASSES = ["hate", "counter", "neutral"]
#: Mean change of the reliabilities at which the power iteration ends, and rounds after which it ends without.
TOLERANCE, ROUNDS = 1e-4, 100
#: Weight of the scalar reliability in a profile, in shared votes, least chance of a class, annotators a consensus needs.
PRIOR, FLOOR, LEAST_ANNOTATORS = 1.0, 0.005, 3
#: Votes of all annotators together that are added to an annotator's own before the shares of the classes are taken, as
#: a few votes alone would make agreement with their like seem to be chance.
SMOOTHING = 3.0
#: How often one who shares no item with others is taken to be right.
UNKNOWN = 0.6


def latest_votes(notes: DataFrame) -> DataFrame:
    """(item, annotator, label): the votes that count.

    A vote is a human row with a post, an annotator and one of CLASSES, ignoring case and outer blanks. Of several by one
    annotator for one post that of the latest zcreatedat counts, then of the highest z_pk; NULL and NaN times come first.
    """
    plain = notes.select(
        F.col("zpost").alias("item"),
        F.lower(strip(F.col("zannotatorid"))).alias("annotator"),
        F.lower(strip(F.col("zspeechclass"))).alias("label"),
        F.struct(F.when(~F.isnan("zcreatedat"), F.col("zcreatedat")).alias("at"), F.col("z_pk")).alias("order"),
        F.lower(strip(F.col("zstage"))).alias("stage"),
    ).filter((F.col("stage") == "human") & F.col("item").isNotNull() & (F.col("annotator") != "") & F.col("label").isin(CLASSES))
    return plain.groupBy("item", "annotator").agg(F.max_by("label", "order").alias("label"))


class _Votes:
    """Votes written once with their classes as numbers, and what every pass over them needs."""

    def __init__(self, votes: DataFrame, classes: list[str]):
        self.classes, self.k = classes, len(classes)
        number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
        self.rows = durable(votes.filter(F.col("label").isin(classes)).select("item", "annotator", number.cast("int").alias("l")), "votes")
        self.n = self.rows.count()
        self.hot = durable(hot_keys(self.rows, ["item"], self.n), "hot") if self.n >= HOT_ROWS else None
        counts = self.rows.groupBy("annotator").agg(F.count("*").alias("n_votes"), *[F.count_if(F.col("l") == c).alias(f"n{c}") for c in range(self.k)])
        counts = durable(counts, "people")
        totals = counts.agg(F.count("*").alias("n"), *[F.sum(f"n{c}").alias(f"s{c}") for c in range(self.k)]).first()
        shares = [(totals[f"s{c}"] or 0) / (self.n or 1) for c in range(self.k)]
        self.people = counts.select("annotator", "n_votes", *[((F.col(f"n{c}") + SMOOTHING * shares[c]) / (F.col("n_votes") + SMOOTHING)).alias(f"p{c}") for c in range(self.k)])
        self.n_people, self.chance = totals["n"], sum(x * x for x in shares)

    def with_people(self, people: DataFrame) -> DataFrame:
        return lookup_join(self.rows, people, ["annotator"], "inner", self.n_people, self.n)

    def with_items(self, voted: DataFrame, items: DataFrame) -> DataFrame:
        return skew_join(voted, items, ["item"], "inner", self.n, self.hot)

    def by_class(self, of_class: Column | list[Column]) -> list[Column]:
        """A column for each class: the value where the vote is for it, 0 elsewhere."""
        return [F.when(F.col("l") == c, x).otherwise(F.lit(0.0)) for c, x in enumerate(of_class if isinstance(of_class, list) else [of_class] * self.k)]


def _product(v: _Votes, weights: DataFrame) -> DataFrame:
    """(annotator, n_votes, p..., w, num, den) from (annotator, n_votes, p..., w).

    num is the product of the chance-centred agreement matrix with w, den the sum over the same pairs of w squared. How
    often two would agree by chance follows from the shares in which each gives the classes, so that one who gives a
    single class to all agrees with nobody more than by chance.
    """
    w, shares = F.col("w"), [F.col(f"p{c}") for c in range(v.k)]
    voted = v.with_people(weights)
    items = voted.groupBy("item").agg(
        *[F.sum(x).alias(f"s{c}") for c, x in enumerate(v.by_class(w))], *[F.sum(w * p).alias(f"e{c}") for c, p in enumerate(shares)], F.sum(w * w).alias("q"),
    )
    back = v.with_items(voted, items)
    agreed = sum(v.by_class([F.col(f"s{c}") - w for c in range(v.k)]), F.lit(0.0))
    expected = sum((p * (F.col(f"e{c}") - w * p) for c, p in enumerate(shares)), F.lit(0.0))
    return back.groupBy("annotator").agg(F.first("n_votes").alias("n_votes"), *[F.first(f"p{c}").alias(f"p{c}") for c in range(v.k)], F.first("w").alias("w"), F.sum(agreed - expected).alias("num"), F.sum(F.col("q") - w * w).alias("den"))


def _reliabilities(v: _Votes, rounds: int) -> tuple[DataFrame, bool]:
    """(annotator, n_votes, p..., agreement, reliability, residual), see reliabilities, and whether there is agreement."""
    scale = math.sqrt(1 - v.chance) if v.chance < 1 else 1.0
    weights = v.people.withColumn("w", F.lit(1.0))
    first, y, held, residual = None, None, False, 0.0
    for i in range(rounds):
        y = durable(_product(v, weights), f"power{i}")
        first = first if i else y
        u, w = F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(F.lit(0.0)), F.col("w")
        s = y.select(u.alias("u"), w, (w * F.col("num")).alias("a"), (w * w * F.col("den")).alias("b")).agg(
            F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("u").alias("sign"), F.sum(F.col("u") * F.col("u")).alias("uu"), F.sum(F.col("u") * w).alias("uw"), F.sum(w * w).alias("ww"), F.count("*").alias("n"),
        ).first()
        held = bool(s["n"] and s["b"] and s["a"])
        if not held:
            residual = 0.0
            break
        # w stands for t = c w; the next t is u / c, of the sign of the majority
        c = math.sqrt(abs(s["a"]) / s["b"])
        sign = 1.0 if s["sign"] >= 0 else -1.0
        residual = math.sqrt(max(0.0, s["uu"] / c**2 - 2 * sign * s["uw"] + c**2 * s["ww"]) / s["n"])
        fit = u * F.lit(sign / c)
        weights, held = y.withColumn("w", fit).drop("num", "den"), s["a"] > 0
        if residual < TOLERANCE:
            break
    if not held:  # nobody agrees more than by chance
        weights = y.withColumn("w", F.lit(0.0))
    agreement = first.select("annotator", F.when(F.col("den") > 0, F.col("num") / F.col("den")).alias("agreement"))
    shares = [f"p{c}" for c in range(v.k)]
    return weights.join(agreement, "annotator").select("annotator", "n_votes", *shares, "agreement", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("w") / F.lit(scale))).alias("reliability"), F.lit(residual).alias("residual")), held


def reliabilities(votes: DataFrame, rounds: int = ROUNDS, classes: list[str] = CLASSES) -> DataFrame:
    """(annotator, n_votes, agreement, reliability, residual): the leading eigenvector, scaled to chance 0 and perfection 1.

    votes: (item, annotator, label), one row for each item and annotator. An annotator whose votes agree with the others
    no more than by chance gets about 0, one who contradicts them less than 0. The sign is that of the majority.
    agreement is the mean agreement with others above chance. Annotators who share no item with others have agreement NULL
    and reliability 0, and all have 0 if nobody agrees with others more than by chance; their votes then count alike. residual is by how much the reliabilities still moved in the last round, in the mean: above
    TOLERANCE the iteration ended after ``rounds`` without having settled. No votes give no rows.
    """
    return _reliabilities(_Votes(votes, classes), rounds)[0].select("annotator", "n_votes", "agreement", "reliability", "residual")


def consensus(votes: DataFrame, least: int = LEAST_ANNOTATORS, classes: list[str] = CLASSES, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The consensus of each item with votes of at least ``least`` annotators, and the annotators' reliabilities.

    Items: (item, label, probability, n_votes, agreement), where agreement is the share of pairs of votes that are equal.
    Annotators: see reliabilities. The votes are weighted by what the agreement matrix says of them: for a vote of
    annotator a for class l, how much more than by chance the others, by their spectral reliability, stood for each class
    where a gave l. So one who steadily swaps two classes informs, and one who gives a single class to all does not. Few
    shared votes leave the weight near that of the reliability alone. Of equally probable classes the one earlier in
    ``classes`` is taken. votes: (item, annotator, label), one row for each pair.
    """
    v = _Votes(votes, classes)
    k, every = v.k, range(v.k)
    right = F.least(F.lit(0.97), F.greatest(F.lit(0.03), F.lit(1 / k) + F.lit(1 - 1 / k) * F.col("reliability")))
    people, held = _reliabilities(v, rounds)
    right = F.when(F.col("agreement").isNull() | F.lit(not held), F.lit(UNKNOWN)).otherwise(right)
    known = durable(people.withColumns({"r": F.greatest(F.lit(0.0), F.col("reliability")), "right": right}), "known")
    voted = v.with_people(known.select("annotator", "r", "right", *[f"p{c}" for c in every]))
    odds = F.log(F.col("right") * (k - 1) / (1 - F.col("right")))
    centred = [x - F.col("r") * F.col(f"p{c}") for c, x in enumerate(v.by_class(F.col("r")))]
    sums = voted.groupBy("item").agg(*[F.sum(x).alias(f"o{c}") for c, x in enumerate(v.by_class(odds))], *[F.sum(x).alias(f"s{c}") for c, x in enumerate(centred)], F.sum(F.col("r") * F.col("r")).alias("g"))
    items = durable(sums, "items")
    tops = {r["top"]: r["count"] for r in items.select(_first_greatest([F.col(f"o{c}") for c in every]).alias("top")).groupBy("top").count().collect()}
    prior = [(tops.get(c, 0) + PRIOR) / (sum(tops.values()) + PRIOR * k) for c in every]

    others = v.with_items(voted, items.select("item", *[f"s{c}" for c in every], "g"))
    moments = others.groupBy("annotator", "l").agg(*[F.sum(F.col(f"s{c}") - x).alias(f"f{c}") for c, x in enumerate(centred)], F.sum(F.col("g") - F.col("r") * F.col("r")).alias("d"), F.first("right").alias("right"))
    by_rate = [F.lit(prior[c]) * F.when(F.col("l") == c, F.col("right")).otherwise((1 - F.col("right")) / (k - 1)) for c in every]
    whole = sum(by_rate[1:], by_rate[0])
    chances = [F.greatest(F.lit(FLOOR), (PRIOR * by_rate[c] / whole + F.lit(prior[c]) * F.col("d") + F.col(f"f{c}")) / (PRIOR + F.col("d"))) for c in every]
    total = sum(chances[1:], chances[0])
    profiles = durable(moments.select("annotator", "l", *[F.log(x / total / prior[c]).alias(f"w{c}") for c, x in enumerate(chances)]), "profiles")
    weighted = lookup_join(v.rows, profiles, ["annotator", "l"], "inner", v.n_people * k, v.n)
    found = weighted.groupBy("item").agg(*[(F.sum(f"w{c}") + math.log(prior[c])).alias(f"w{c}") for c in every], F.count("*").alias("n_votes"), *[F.count_if(F.col("l") == c).alias(f"n{c}") for c in every])
    logs = [F.col(f"w{c}") for c in every]
    best = F.greatest(*logs)
    same = sum((F.col(f"n{c}") * (F.col(f"n{c}") - 1) for c in every), F.lit(0))
    result = found.filter(F.col("n_votes") >= least).select(
        "item", F.array(*[F.lit(c) for c in classes])[_first_greatest(logs)].alias("label"), (1 / sum((F.exp(x - best) for x in logs[1:]), F.exp(logs[0] - best))).alias("probability"),
        "n_votes", F.when(F.col("n_votes") > 1, same / (F.col("n_votes") * (F.col("n_votes") - 1))).alias("agreement"),
    )
    return result, known.select("annotator", "n_votes", "agreement", "reliability", "residual")


def _first_greatest(values: list[Column]) -> Column:
    best = F.greatest(*values)
    return F.coalesce(*[F.when(x == best, F.lit(c)) for c, x in enumerate(values)])

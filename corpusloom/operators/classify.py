"""Model answers, pluggable classifiers, and trainers on Spark's own library."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, NGram, RegexTokenizer, SQLTransformer, Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = ("hate", "counter", "neutral")
ANSWER = "class string, severity string, confidence double, reasoning string"


def first_object(text: str | None) -> str | None:
    """The first balanced JSON object in a text.

    Strings are followed inside and outside of objects, so braces in quotes never count, nor do escaped quotes in them. A
    stray end begins anew.
    """
    depth = start = 0
    quoted = escaped = False
    for i, ch in enumerate(text or ""):
        if quoted:
            escaped, quoted = (False, True) if escaped else (ch == "\\", ch != '"')
        elif ch == '"':
            quoted = True
        elif ch == "{":
            start = start if depth else i
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def parse_answer(text: str | None) -> dict | None:
    """A model's answer; None without an object or a known class. Confidence is put into [0, 1], severity 'null' is none."""
    try:
        x = json.loads(first_object(text) or "")
    except ValueError:
        return None
    kind = str(x.get("class") or "").strip().lower()
    if kind not in CLASSES:
        return None
    try:
        sure = min(1.0, max(0.0, float(x.get("confidence"))))
    except (TypeError, ValueError):
        sure = 0.0
    severity = x.get("severity")
    severity = None if severity is None or str(severity).strip().lower() in ("", "null", "none") else str(severity).strip().lower()
    return {"class": kind, "severity": severity, "confidence": sure, "reasoning": x.get("reasoning") and str(x["reasoning"])}


def parsed(df: DataFrame, answer: str) -> DataFrame:
    """C13 over a column: ``df`` with the struct ``parsed``, NULL for answers that are none."""

    @F.pandas_udf(ANSWER)
    def parse(texts: pd.Series) -> pd.DataFrame:
        rows = [parse_answer(t) or {} for t in texts]
        return pd.DataFrame(rows, columns=["class", "severity", "confidence", "reasoning"])

    out = df.withColumn("_p", parse(F.col(answer)))
    return out.withColumn("parsed", F.when(F.col("_p")["class"].isNotNull(), F.col("_p"))).drop("_p")


def provider(endpoint: str) -> Callable[[str, str], str]:
    """A classifier by endpoint. 'stub:' answers offline by rule; network endpoints are for a source outside this library."""
    if endpoint.startswith("stub:"):
        words = [w for w in endpoint.removeprefix("stub:").split(",") if w]
        return lambda text, _: json.dumps({"class": "hate" if any(w in text.lower() for w in words) else "neutral", "confidence": 0.75, "severity": None})
    raise ValueError(f"no offline provider for {endpoint!r}")


def annotated(pending: DataFrame, key: str, text: str, endpoint: str, least: int = 10) -> DataFrame:
    """(key, class, severity, confidence, reasoning) of pending texts, in Arrow batches.

    Texts under ``least`` characters get a sentinel row with confidence 0 and are not sent.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = provider(endpoint)
        for pdf in batches:
            rows = []
            for k, t in pdf[[key, text]].itertuples(index=False):
                a = parse_answer(ask(t, "")) if t and len(t.strip()) >= least else {"class": "neutral", "confidence": 0.0}
                rows.append((k, *((a or {}).get(c) for c in ("class", "severity", "confidence", "reasoning"))))
            yield pd.DataFrame(rows, columns=[key, "class", "severity", "confidence", "reasoning"])

    kind = pending.schema[key].dataType.simpleString()
    return pending.select(key, text).mapInPandas(run, f"{key} {kind}, {ANSWER}").filter(F.col("class").isNotNull())


def tfidf_logistic(train: DataFrame, text: str, label: str, features: int = 1 << 14, ridge: float = 0.01):
    """TF-IDF of words and word pairs, and a class-balanced logistic regression; a fitted model.

    Counts are taken as they are, not as 1 + log; numbers differ from other libraries in that, smoothing, hashing and solver.
    """
    share = train.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.5
    weighted = train.withColumn("_w", F.when(F.col(label) == 1, F.lit(0.5 / max(share, 1e-9))).otherwise(F.lit(0.5 / max(1 - share, 1e-9)))).withColumn("_y", F.col(label).cast("double"))
    ready = weighted.withColumn(text, F.coalesce(text, F.lit("")))
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\W+"), NGram(n=2, inputCol="_words", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"), HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_x", minDocFreq=2),
        LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=ridge, maxIter=50),
    ]
    return Pipeline(stages=stages).fit(ready)


def word_vectors(texts: DataFrame, tokens: str, size: int = 50, least: int = 5, seed: int = 1):
    """Word vectors whose means stand for texts; the nearest built-in to document vectors. A fitted model."""
    return Word2Vec(vectorSize=size, minCount=least, inputCol=tokens, outputCol="vector", seed=seed).fit(texts)



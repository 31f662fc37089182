"""Checks that refuse wrong or partial results."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ReconciliationError(ValueError):
    """What was computed does not add up."""


def reconcile(name: str, computed: int, expected: int, allow: bool = False) -> None:
    """K1: refuse (or, where allowed, warn) unless both numbers are equal."""
    if computed != expected:
        text = f"{name}: computed {computed}, expected {expected}"
        if not allow:
            raise ReconciliationError(text)
        warnings.warn(text, stacklevel=2)


def require_complete(summary: dict) -> None:
    """K2: refuse a run that says it is not complete."""
    if summary.get("run_status") != "complete":
        raise ReconciliationError(f"the run is {summary.get('run_status')!r}")


def require_no_labels(labels: DataFrame) -> None:
    """K3: refuse to seal predictions once a label exists."""
    if not labels.isEmpty():
        raise ReconciliationError("labels exist already")


def require_schema(df: DataFrame, spec: StructType) -> DataFrame:
    """K4: ``df`` itself if it has the columns and types of ``spec``; extra columns are fine."""
    have = {f.name: f.dataType for f in df.schema}
    for f in spec:
        if f.name not in have:
            raise ReconciliationError(f"column {f.name} is missing")
        if have[f.name] != f.dataType:
            raise ReconciliationError(f"column {f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return df


def optional_columns(df: DataFrame, spec: StructType) -> DataFrame:
    """``df`` with the columns of ``spec`` it lacks as NULLs."""
    have = set(df.columns)
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in spec if f.name not in have])


def plan_text(df: DataFrame) -> str:
    """K5: the formatted plan as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def leaves_add_up(cube: DataFrame, n: str, expected: int, axes: list[str]) -> None:
    """K6: the cells of a cube that are no totals have to sum to ``expected``."""
    inner = cube
    for a in axes:
        inner = inner.filter(F.col(a) != "ALL")
    reconcile("cube", inner.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0], expected)

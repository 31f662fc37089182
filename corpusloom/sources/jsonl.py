"""Append-only JSON lines, in the order they were written."""

from __future__ import annotations

import hashlib
import json
import os
from glob import glob

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

_S = lambda n, t=StringType(): StructField(n, t)
SCORES = StructType([_S("uri"), _S("head"), _S("score", DoubleType()), _S("model_id"), _S("model_revision"), _S("scored_at")])
LABELS = StructType([_S("subject"), _S("subject_type"), _S("src"), _S("val"), _S("cts"), _S("neg", BooleanType()), _S("observed_at")])
SEALED = StructType([_S("uri"), _S("model"), _S("score", DoubleType()), _S("meaning")])


def read_log(spark: SparkSession, pattern: str, schema: StructType) -> DataFrame:
    """The records of all files that match, gzipped ones too, with ``file`` and ``line`` for their order.

    Names sort as times do. Files are read in splits; the line of a record is its byte offset, which grows as lines do:
    it comes from the position of the record in its file, taken in one pass a file. Blank and broken lines are no records.
    """
    lines = spark.read.option("lineSep", "\n").text(pattern).select(F.col("value"), F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    parsed = lines.filter(F.col("value").rlike(r"\S")).withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    order = F.struct("block", "at")
    return parsed.filter("r IS NOT NULL").select("r.*", "file", order.alias("line")).filter(F.coalesce(*[F.col(f.name).cast("string") for f in schema]).isNotNull())


def last_records(log: DataFrame, keys: list[str], first: list[str] = []) -> DataFrame:
    """Of each key the record that was written last, after ``first`` (such as a time) where given."""
    keep = [c for c in log.columns if c not in (*keys, "file", "line")]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*keep), F.struct(*first, "file", "line")).alias("_l"))
    return last.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in keep])


def newest_complete(pattern: str) -> str:
    """The last file whose summary beside it says that its run was complete."""
    for path in sorted(glob(pattern), reverse=True):
        beside = path.removesuffix(".gz").removesuffix(".jsonl") + ".summary.json"
        try:
            with open(beside) as f:
                if json.load(f).get("run_status") == "complete":
                    return path
        except (OSError, ValueError):
            continue
    raise FileNotFoundError(f"no complete run matches {pattern}")


def first_model(log: DataFrame, head: str) -> tuple[str, str] | None:
    """The model and revision that scored a head first."""
    r = log.filter(F.col("head") == head).orderBy("file", "line").select("model_id", "model_revision").first()
    return (r[0], r[1]) if r else None


def write_jsonl(df: DataFrame, path: str, gz: bool = True) -> None:
    """Records as JSON lines, by Spark's commit protocol."""
    df.write.option("compression", "gzip" if gz else "none").mode("errorifexists").json(path)


def file_sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    return h.hexdigest()


def seal(folder: str) -> dict[str, str]:
    """A manifest of the files of a result with their SHA-256, written beside them."""
    names = sorted(n for n in os.listdir(folder) if n.startswith("part-"))
    manifest = {n: file_sha256(f"{folder}/{n}") for n in names}
    write_atomic(f"{folder}/_manifest.json", json.dumps(manifest, indent=1))
    return manifest


def verify(folder: str) -> bool:
    """Whether all files are as they were sealed, and none was added."""
    with open(f"{folder}/_manifest.json") as f:
        held = json.load(f)
    names = sorted(n for n in os.listdir(folder) if n.startswith("part-"))
    return names == sorted(held) and all(file_sha256(f"{folder}/{n}") == held[n] for n in names)


def write_atomic(path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    part = f"{path}.{os.getpid()}.part"
    with open(part, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)



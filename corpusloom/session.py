"""Sessions, table access and durable intermediate results."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be broadcast after they were counted; at some 60 bytes a row this is well under 64 MB.
MAX_BROADCAST_ROWS = 400_000
#: Bytes of values in rows of varying width that may be broadcast after they were added up.
MAX_BROADCAST_BYTES = 64 << 20


def session(master: str | None = None, app: str = "corpusloom", cores: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on: UTC, ANSI, adaptive execution, skew splitting.

    ``master`` is left to spark-submit when None. Shuffle partitions start at ``cores`` and are raised by the caller
    (or ``conf``) on a cluster; adaptive execution merges what is too small.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="corpusloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage, survives lost executors and gives the optimizer the true size of an intermediate result. The
    files go when the Spark application ends (or with the shared folder).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int, most: int | None = None, size: int = 0) -> DataFrame:
    """Hint a broadcast only for a side whose row count, and ``size`` in bytes where rows vary, are known and bounded; the
    planner joins the rest by shuffle."""
    return F.broadcast(df) if rows <= (MAX_BROADCAST_ROWS if most is None else most) and size <= MAX_BROADCAST_BYTES else df

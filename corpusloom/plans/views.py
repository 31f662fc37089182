"""The tables as views, for Spark and, as common table expressions with the same rules, for the SQL they are checked by."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import frame_kind
from corpusloom.functions.uri import normal_uuid
from corpusloom.operators import latest, model
from corpusloom.plans.problems import sql_uuid
from corpusloom.session import table


@dataclass
class Views:
    """The views of one folder of tables; each is built when it is first used."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def posts(self) -> DataFrame:
        return model.posts(self.raw("zpost"))

    @cached_property
    def of_author(self) -> DataFrame:
        return model.posts_where(self.raw("zpost"), F.col("zauthordid") == self.heaviest)

    @cached_property
    def root_posts(self) -> DataFrame:
        return model.posts_where(self.raw("zpost"), F.col("zisrootpost") == 1)

    @cached_property
    def notes(self) -> DataFrame:
        return model.notes(self.raw("zannotation"))

    @cached_property
    def messages(self) -> DataFrame:
        return model.messages(self.raw("messages"))

    @cached_property
    def scores(self) -> DataFrame:
        return model.score_log(self.notes, self.posts)

    @cached_property
    def labels(self) -> DataFrame:
        return model.label_log(self.notes, self.posts)

    @cached_property
    def batches(self) -> DataFrame:
        rows = self.raw("zlabelbatch").select(normal_uuid(F.col("zid")).alias("batch"), frame_kind(F.col("zframejson")).alias("kind"), F.col("zpassnumber").alias("pass"), "z_pk")
        return model.unique_rows(rows, ["batch"], "z_pk").select("batch", "kind", "pass")

    @cached_property
    def latest_scores(self) -> DataFrame:
        return latest.latest_scores(self.scores)

    @cached_property
    def heaviest(self) -> str:
        """The author with most replies; of ties the least id."""
        r = model.replies(self.posts).filter("zauthordid IS NOT NULL").groupBy("zauthordid").count().orderBy(F.desc("count"), "zauthordid").first()
        return r[0] if r else ""


#: A day to count back from (2025-01-01), and an outlet and bounds for the queries that take some.
NOW, OUTLET, LEAST, MOST = 757_382_400.0, 38, 2, 50

_BLANKS = "chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)||chr(133)||chr(160)"


def clean(c: str) -> str:
    return f"lower(trim({c}, {_BLANKS}))"


def at(c: str) -> str:
    return f"make_timestamp(CAST(floor(({c} + 978307200) * 1000000) AS BIGINT))"


def in_range(c: str) -> str:
    return f"({c} BETWEEN -978307200 AND 252423993599)"


def week(c: str) -> str:
    return f"CAST(date_trunc('week', {at(c)}) AS DATE)"


POSTS = """p AS (SELECT *, CASE WHEN NOT isnan(zcreatedat) THEN zcreatedat END AS created FROM zpost WHERE zuri IS NOT NULL QUALIFY row_number() OVER (PARTITION BY zuri ORDER BY z_pk) = 1),
r AS (SELECT * FROM p WHERE zisrootpost = 0), t AS (SELECT zuri AS turi, zaccount AS outlet, ztext AS ttext FROM p WHERE zisrootpost = 1)"""
NOTES = f"""a AS (SELECT z_pk, {clean('zstage')} AS stage, {clean('zspeechclass')} AS class, {clean('zseverity')} AS severity, CASE WHEN NOT isnan(zconfidence) THEN zconfidence END AS confidence,
 zmodelname AS model, {clean('zannotatorid')} AS annotator, {sql_uuid('zbatchid')} AS batch, zpassnumber AS pass, zpost AS post, CASE WHEN NOT isnan(zcreatedat) THEN zcreatedat END AS created FROM zannotation)"""
SCORES = "s AS (SELECT p.zuri AS uri, 'hate' AS head, a.model, CASE WHEN a.class = 'hate' THEN confidence ELSE 1 - confidence END AS score, a.created AS scored_at, a.z_pk AS seq FROM a JOIN p ON a.post = p.z_pk WHERE stage = 'llm' AND class IN ('hate', 'counter', 'neutral') AND confidence IS NOT NULL)"
LABELS = "l AS (SELECT p.zuri AS uri, a.class AS val, a.created AS cts, coalesce(a.pass = 2, false) AS neg, a.z_pk AS seq FROM a JOIN p ON a.post = p.z_pk WHERE stage = 'human' AND class IN ('hate', 'counter', 'neutral'))"
MESSAGES = "m AS (SELECT * FROM messages WHERE channel IS NOT NULL AND msg_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY channel, msg_id ORDER BY fetched_at) = 1)"
BATCHES = f"b AS (SELECT {sql_uuid('zid')} AS batch, CASE WHEN json_valid(zframejson) THEN zframejson->>'$.kind' END AS kind, zpassnumber AS pass FROM zlabelbatch WHERE {sql_uuid('zid')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {sql_uuid('zid')} ORDER BY z_pk) = 1)"
LATEST = "ls AS (SELECT uri, score, model, scored_at FROM s QUALIFY row_number() OVER (PARTITION BY uri ORDER BY seq DESC) = 1)"
HEAVIEST = "(SELECT zauthordid FROM r WHERE zauthordid IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"

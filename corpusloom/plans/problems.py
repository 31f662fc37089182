"""Queries of the general data problems: dangling references, hierarchies, snapshot differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.uri import normal_uri, normal_uuid
from corpusloom.operators.hierarchy import descendants, paths, roots_and_depths
from corpusloom.operators.orphans import orphan_references, orphan_report
from corpusloom.operators.snapshots import post_snapshot_changes
from corpusloom.session import table


def post_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "zpost").select("z_pk", normal_uri(F.col("zuri")).alias("uri"), normal_uri(F.col("zparenturi")).alias("parent"), "zcreatedat")


def _annotation_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "zannotation").select("z_pk", normal_uuid(F.col("zbatchid")).alias("batch"), "zcreatedat")


def _orphans(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, str, DataFrame]]:
    posts, notes = post_edges(spark, sf_dir), _annotation_refs(spark, sf_dir)
    batches = table(spark, sf_dir, "zlabelbatch").select(normal_uuid(F.col("zid")).alias("batch"))
    return {
        "zpost": (posts, "parent", orphan_references(posts.select("z_pk", "parent", "zcreatedat"), posts.select("uri"), "parent", "uri")),
        "zannotation": (notes, "batch", orphan_references(notes, batches, "batch", "batch")),
    }


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (rows.select(F.lit(name).alias("source_table"), "z_pk") for name, (_, _, rows) in _orphans(spark, sf_dir).items())
    return a.unionByName(b)


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (orphan_report(refs, rows, name, ref, "zcreatedat") for name, (refs, ref, rows) in _orphans(spark, sf_dir).items())
    return a.unionByName(b).select("source_table", "period", "n_references", "n_orphans", F.round("orphan_rate", 6).alias("orphan_rate"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = roots_and_depths(post_edges(spark, sf_dir), "uri", "parent")
    return found.select(F.col("node").alias("zuri"), F.col("root").alias("root_uri"), F.col("depth").alias("tree_depth"))


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paths(post_edges(spark, sf_dir), "uri", "parent")
    return found.select(F.col("node").alias("zuri"), F.col("root").alias("root_uri"), F.col("depth").alias("tree_depth"), F.array_join("path", " > ").alias("path"))


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    below = descendants(paths(post_edges(spark, sf_dir), "uri", "parent"))
    return below.select(F.col("node").alias("zuri"), F.col("descendant").alias("descendant_uri"), "distance")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = post_snapshot_changes(table(spark, sf_dir, "zpost_snapshot"))
    return found.select(F.date_format("delivery", "yyyy-MM-dd").alias("snapshot_date"), F.col("key").alias("zuri"), F.col("change").alias("change_kind"))




def sql_uri(c: str) -> str:
    blanks = r"chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)||chr(133)||chr(160)"
    bare = f"rtrim(trim(url_decode(replace(trim({c}, {blanks}), '+', '%2B')), {blanks}), '/')"
    return f"nullif(lower(regexp_extract({bare}, '^[A-Za-z][A-Za-z0-9+.-]*:')) || substr({bare}, length(regexp_extract({bare}, '^[A-Za-z][A-Za-z0-9+.-]*:')) + 1), '')"


def sql_uuid(c: str) -> str:
    plain = f"lower(trim({c}, chr(32)||chr(9)||chr(10)||chr(13)))"
    form = "^(?:urn:uuid:)?\\{?([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})\\}?$"
    return f"CASE WHEN regexp_matches({plain}, '{form}') THEN regexp_replace({plain}, '{form}', '\\1\\2\\3\\4\\5') END"


_POSTS = f"p AS (SELECT z_pk, {sql_uri('zuri')} AS uri, {sql_uri('zparenturi')} AS parent, zcreatedat FROM zpost)"
_NOTES = f"n AS (SELECT z_pk, {sql_uuid('zbatchid')} AS batch, zcreatedat FROM zannotation), b AS (SELECT {sql_uuid('zid')} AS batch FROM zlabelbatch)"
_PERIOD = "CASE WHEN zcreatedat BETWEEN -978307200 AND 252423993599 AND NOT isnan(zcreatedat) THEN strftime(make_timestamp(CAST(floor((zcreatedat + 978307200) * 1000000) AS BIGINT)), '%Y-%m') ELSE 'unknown' END"
_TREE = """d AS (SELECT uri, min(parent) AS parent FROM p WHERE uri IS NOT NULL GROUP BY uri),
e AS (SELECT d.uri, u.uri AS parent FROM d LEFT JOIN d u ON d.parent = u.uri),
t AS (SELECT uri, uri AS root, CAST(0 AS BIGINT) AS depth, uri AS path FROM e WHERE parent IS NULL
      UNION ALL SELECT e.uri, t.root, t.depth + 1, t.path || ' > ' || e.uri FROM e JOIN t ON e.parent = t.uri)"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p4_found": p4_found, "p4_paths": p4_paths, "p4_descendants": p4_descendants, "p6_found": p6_found}

SQL = {
    "p3_found": f"""WITH {_POSTS}, {_NOTES}
SELECT 'zpost' AS source_table, z_pk FROM p WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p q WHERE q.uri = p.parent)
UNION ALL SELECT 'zannotation', z_pk FROM n WHERE batch IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b WHERE b.batch = n.batch)""",
    "p3_report": f"""WITH {_POSTS}, {_NOTES},
r AS (SELECT 'zpost' AS source_table, {_PERIOD} AS period, NOT EXISTS (SELECT 1 FROM p q WHERE q.uri = p.parent) AS lost FROM p WHERE parent IS NOT NULL
      UNION ALL SELECT 'zannotation', {_PERIOD}, NOT EXISTS (SELECT 1 FROM b WHERE b.batch = n.batch) FROM n WHERE batch IS NOT NULL)
SELECT source_table, period, count(*) AS n_references, count(*) FILTER (lost) AS n_orphans, round(count(*) FILTER (lost) / count(*), 6) AS orphan_rate FROM r GROUP BY ALL""",
    "p4_found": f"""WITH RECURSIVE {_POSTS}, {_TREE}
SELECT e.uri AS zuri, coalesce(t.root, 'cycle') AS root_uri, coalesce(t.depth, -1) AS tree_depth FROM e LEFT JOIN t ON e.uri = t.uri""",
    "p4_paths": f"""WITH RECURSIVE {_POSTS}, {_TREE}
SELECT e.uri AS zuri, coalesce(t.root, 'cycle') AS root_uri, coalesce(t.depth, -1) AS tree_depth, t.path FROM e LEFT JOIN t ON e.uri = t.uri""",
    "p4_descendants": f"""WITH RECURSIVE {_POSTS}, {_TREE},
u AS (SELECT e.parent AS zuri, t.uri AS descendant_uri, CAST(1 AS BIGINT) AS distance FROM t JOIN e ON t.uri = e.uri WHERE e.parent IS NOT NULL
      UNION ALL SELECT e.parent, u.descendant_uri, u.distance + 1 FROM u JOIN e ON u.zuri = e.uri WHERE e.parent IS NOT NULL)
SELECT * FROM u""",
    "p6_found": f"""WITH s AS (SELECT snapshot_date AS d, {sql_uri('zuri')} AS uri, lower(trim(zreplytreestatus, chr(32)||chr(9)||chr(10)||chr(13))) AS status, exported_at FROM zpost_snapshot),
l AS (SELECT d, uri, status FROM s WHERE uri IS NOT NULL QUALIFY row_number() OVER (PARTITION BY d, uri ORDER BY exported_at DESC, status DESC NULLS LAST) = 1),
o AS (SELECT d, lag(d) OVER (ORDER BY d) AS before FROM (SELECT DISTINCT d FROM l))
SELECT strftime(o.d, '%Y-%m-%d') AS snapshot_date, c.uri AS zuri, CASE WHEN a.uri IS NULL THEN 'added' ELSE 'changed' END AS change_kind
FROM o JOIN l c ON c.d = o.d LEFT JOIN l a ON a.d = o.before AND a.uri = c.uri
WHERE o.before IS NOT NULL AND (a.uri IS NULL OR a.status IS DISTINCT FROM c.status)
UNION ALL SELECT strftime(o.d, '%Y-%m-%d'), a.uri, 'removed' FROM o JOIN l a ON a.d = o.before WHERE NOT EXISTS (SELECT 1 FROM l c WHERE c.d = o.d AND c.uri = a.uri)""",
}

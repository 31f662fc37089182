"""The queries of this package, with SQL where it can tell what has to come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.uri import normal_uri
from corpusloom.llm import abuse, consensus, leakage, packing, quantiles, residue
from corpusloom.operators.hierarchy import roots_and_depths
from corpusloom.operators.skew import lookup_join
from corpusloom.session import durable, table


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.post_time_percentiles(table(spark, sf_dir, "zpost"))


def p1_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.daily_percentiles(table(spark, sf_dir, "zpost"))


def p1_exact_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the rank of each percentile, counted exactly, is within the stated error (and what SQL can tell: the counts)."""
    posts = table(spark, sf_dir, "zpost").select(F.coalesce("zaccount", F.lit(-1)).alias("zaccount"), "zcreatedat").filter("zcreatedat IS NOT NULL AND NOT isnan(zcreatedat)")
    marks = p1_percentiles(spark, sf_dir).withColumn("zaccount", F.coalesce("zaccount", F.lit(-1)))
    met = posts.join(F.broadcast(durable(marks, "marks")), "zaccount")
    names = [(f"p{round(100 * p):02d}", p) for p in quantiles.SHARES]
    ranks = met.groupBy("zaccount").agg(F.count("*").alias("n_values"), F.max("n").alias("n"), F.max("rank_error").alias("e"), *[x for c, _ in names for x in (F.count_if(F.col("zcreatedat") < F.col(c)).alias(f"{c}_below"), F.count_if(F.col("zcreatedat") <= F.col(c)).alias(f"{c}_upto"))])
    fine = [((F.col(f"{c}_below") < F.ceil(F.col("n") * p) + F.col("e") * F.col("n") + 1) & (F.col(f"{c}_upto") >= F.ceil(F.col("n") * p) - F.col("e") * F.col("n"))).alias(f"{c}_within") for c, p in names]
    return ranks.select("zaccount", "n_values", (F.col("n") == F.col("n_values")).alias("complete"), *fine)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = consensus.consensus(consensus.latest_votes(table(spark, sf_dir, "zannotation")))
    return items.select(F.col("item").alias("zpost"), F.col("label").alias("zspeechclass"))


def p2_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = consensus.consensus(consensus.latest_votes(table(spark, sf_dir, "zannotation")))
    return items.select(F.col("item").alias("zpost"), F.col("label").alias("zspeechclass"), F.round("probability", 6).alias("probability"), "n_votes", "agreement")


def p2_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = consensus.reliabilities(consensus.latest_votes(table(spark, sf_dir, "zannotation")))
    return found.select("annotator", "n_votes", F.round("agreement", 6).alias("agreement"), F.round("reliability", 6).alias("reliability"), F.round("residual", 6).alias("residual"))


def _abuse_model(spark: SparkSession, sf_dir: str):
    return abuse.train(abuse.corpus_sample([(table(spark, sf_dir, "zpost"), "ztext", ["z_pk"]), (table(spark, sf_dir, "messages"), "text", ["channel", "msg_id"])]))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _abuse_model(spark, sf_dir)
    posts = table(spark, sf_dir, "zpost").select(F.lit("zpost").alias("source_table"), F.col("z_pk").cast("string").alias("record_key"), F.col("ztext").alias("text"))
    messages = table(spark, sf_dir, "messages").select(F.lit("messages").alias("source_table"), F.concat("channel", F.lit("/"), F.col("msg_id").cast("string")).alias("record_key"), "text")
    bad = [abuse.abuse_score(x, F.col("text"), model).filter(F.col("abuse_score") >= abuse.LIMIT).select("source_table", "record_key") for x in (posts, messages)]
    return bad[0].unionByName(bad[1].filter(F.col("record_key").isNotNull()).distinct())


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per outlet (zaccount of the thread's true root) and per channel: texts, cases and their rate."""
    model = _abuse_model(spark, sf_dir)
    posts = table(spark, sf_dir, "zpost")
    edges = posts.select(normal_uri(F.col("zuri")).alias("uri"), normal_uri(F.col("zparenturi")).alias("parent"))
    roots = roots_and_depths(edges, "uri", "parent")
    outlets = posts.filter("zaccount IS NOT NULL").groupBy(normal_uri(F.col("zuri")).alias("root")).agg(F.min("zaccount").alias("zaccount"))
    n_outlets = outlets.count()
    of_post = durable(lookup_join(roots.select("node", "root"), outlets, ["root"], "left", n_outlets).select(F.col("node").alias("uri"), "zaccount"), "outlets")
    scored = abuse.abuse_score(posts.select(normal_uri(F.col("zuri")).alias("uri"), "ztext"), F.col("ztext"), model).filter("abuse_score IS NOT NULL")
    cases = scored.select("uri", (F.col("abuse_score") >= abuse.LIMIT).alias("bad"))
    by_outlet = cases.join(of_post, "uri", "left").groupBy(F.coalesce(F.col("zaccount").cast("string"), F.lit("none")).alias("source")).agg(F.count("*").alias("n_texts"), F.count_if("bad").alias("n_abusive"))
    messages = abuse.abuse_score(table(spark, sf_dir, "messages").select("channel", "msg_id", "text").dropDuplicates(["channel", "msg_id"]), F.col("text"), model).filter("abuse_score IS NOT NULL")
    by_channel = messages.groupBy(F.coalesce("channel", F.lit("none")).alias("source")).agg(F.count("*").alias("n_texts"), F.count_if(F.col("abuse_score") >= abuse.LIMIT).alias("n_abusive"))
    both = by_outlet.select(F.lit("outlet").alias("kind"), "*").unionByName(by_channel.select(F.lit("channel").alias("kind"), "*"))
    return both.withColumn("abuse_rate", F.round(F.col("n_abusive") / F.col("n_texts"), 6))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = packing.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return packing.pack_documents(sized)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "evalset"))


def p8_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "evalset"))
    return found.select("doc_id", "item_id", F.round("containment", 6).alias("containment"))


def p7_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of all containers: every document once, no container too full, none cut that fits, no token lost."""
    sized = durable(packing.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text"), "sized")
    placed = durable(packing.pack_documents(sized), "places")
    fullest = placed.filter("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.max("n").alias("fullest"))
    per = placed.groupBy("doc_id").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_placed")).join(sized.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens")), "doc_id", "full")
    met = per.agg(F.count("*").alias("n_docs"), F.bool_and(F.col("n_placed") == F.col("n_tokens")).alias("whole"), F.bool_and((F.col("n_pieces") == 1) | (F.col("n_tokens") > packing.CAPACITY)).alias("uncut"))
    return met.withColumn("_k", F.lit(0)).join(F.broadcast(fullest.withColumn("_k", F.lit(0))), "_k").select("n_docs", "whole", "uncut", (F.col("fullest") <= packing.CAPACITY).alias("none_too_full"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents")).select("doc_id")


def p9_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents")).select("doc_id", F.array_join("kinds", ",").alias("kinds"))


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_daily, p1_exact_ranks, p2_found, p2_agreement, p2_annotators, p5_found, p5_rates, p7_containers, p7_places, p8_found, p8_contained, p9_found, p9_kinds)}
#: The words of a text as DuckDB finds them, near enough for the tables: tags, links, entities, soft signs and letter case.
_WORDS = "regexp_extract_all(lower(nfc_normalize(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(text, '&nbsp;', ' '), '&quot;', ' '), '&#39;', ' '), '&amp;', ' '), '<[/!?]?[a-zA-Z][^<>]*>', ' ', 'g'), '!?\\[([^\\[\\]]*)\\]\\([^()\\s]*\\)', ' \\1 ', 'g'), '[\\x{00ad}\\x{200b}-\\x{200d}\\x{2060}\\x{feff}]', '', 'g'))), '[\\p{L}\\p{N}]+')"

SQL = {
    "p1_exact_ranks": "SELECT coalesce(zaccount, -1) AS zaccount, count(*) AS n_values, true AS complete, true AS p05_within, true AS p50_within, true AS p90_within, true AS p99_within FROM zpost WHERE zcreatedat IS NOT NULL AND NOT isnan(zcreatedat) GROUP BY 1",
    "p7_places": "SELECT count(DISTINCT doc_id) AS n_docs, true AS whole, true AS uncut, true AS none_too_full FROM documents",
    "p8_found": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, {_WORDS} AS w FROM evalset WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
eg AS (SELECT item_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""",
    "p8_contained": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, {_WORDS} AS w FROM evalset WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 12)),
eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM e WHERE len(w) >= 12)),
n AS (SELECT item_id, count(*) AS n FROM eg GROUP BY 1), m AS (SELECT doc_id, item_id, count(*) AS k FROM dg JOIN eg USING (g) GROUP BY 1, 2)
SELECT doc_id, item_id, round(k / n, 6) AS containment FROM m JOIN n USING (item_id) WHERE k >= 0.8 * n""",
}

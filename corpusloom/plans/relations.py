"""Queries of single predicates, joins, set operations and scalar functions, and of a stream."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from corpusloom.functions import stats, text
from corpusloom.functions.time import in_range as ranged
from corpusloom.functions.time import to_timestamp
from corpusloom.operators import authors as au
from corpusloom.operators import latest, model, sampling
from corpusloom.operators.ranks import percentiles_within
from corpusloom.plans.views import HEAVIEST, LATEST, MESSAGES, NOTES, OUTLET, POSTS, SCORES, LABELS, Views, at, in_range, week

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


W, A = f"WITH {POSTS}", f"WITH {POSTS}, {NOTES}"
S, L = f"{A}, {SCORES}, {LATEST}", f"{A}, {LABELS}"
_ACT = "lt AS (SELECT uri, val, cts, neg FROM l QUALIFY row_number() OVER (PARTITION BY uri, val ORDER BY cts DESC NULLS LAST, seq DESC) = 1), la AS (SELECT uri, val, cts FROM lt WHERE NOT neg)"


@query("F1_reply_root_split", f"{W} SELECT zisrootpost, count(*) AS n FROM p GROUP BY 1")
def _(v):
    return v.posts.groupBy("zisrootpost").agg(F.count("*").alias("n"))


@query("F2_of_author", f"{W} SELECT zuri FROM p WHERE zauthordid = {HEAVIEST}")
def _(v):
    return v.of_author.select("zuri")


@query("F4_lookup", f"{W} SELECT zuri, ztext FROM p WHERE zuri IN (SELECT thread_uri FROM documents) AND length(trim(ztext)) > 0")
def _(v):
    wanted = v.raw("documents").select(F.col("thread_uri").alias("zuri")).distinct()
    return v.posts.filter(F.length(F.trim("ztext")) > 0).join(wanted, "zuri", "left_semi").select("zuri", "ztext")


@query("F14_scores_of_head", f"{S} SELECT uri, score FROM s WHERE head = 'hate'")
def _(v):
    return v.scores.filter("head = 'hate'").select("uri", "score")


@query("F16_F17_thresholds", f"{S} SELECT count(*) FILTER (score > 0.5) AS n_above, count(*) FILTER (score >= 0.5) AS n_from FROM ls")
def _(v):
    return v.latest_scores.agg(F.count_if(F.col("score") > 0.5).alias("n_above"), F.count_if(F.col("score") >= 0.5).alias("n_from"))


@query("F22_page_search", f"{W} SELECT zuri FROM (SELECT zuri, ztext FROM p WHERE zisrootpost = 1 ORDER BY created DESC NULLS LAST, zuri LIMIT 500) WHERE contains(lower(ztext), 'bridge')")
def _(v):
    page = model.roots(v.posts).orderBy(F.desc_nulls_last("created"), "zuri").limit(500)
    return page.filter(text.contains_text(F.col("ztext"), "Bridge")).select("zuri")


@query("J1_reply_root", f"{W} SELECT r.zuri, outlet FROM r JOIN t ON r.zrooturi = t.turi")
def _(v):
    return model.with_root(model.replies(v.posts), v.posts).select("zuri", "outlet")


@query("J2_reply_root_account", f"{W} SELECT r.zuri, zhandle FROM r JOIN t ON r.zrooturi = t.turi JOIN ztrackedaccount k ON k.z_pk = outlet")
def _(v):
    names = v.raw("ztrackedaccount").select(F.col("z_pk").alias("outlet"), "zhandle")
    return model.with_root(model.replies(v.posts), v.posts).join(F.broadcast(names), "outlet").select("zuri", "zhandle")


@query("J4_left_left", f"{W} SELECT r.zuri, coalesce(zhandle, 'unknown') AS outlet FROM r LEFT JOIN t ON r.zrooturi = t.turi LEFT JOIN ztrackedaccount k ON k.z_pk = outlet")
def _(v):
    names = v.raw("ztrackedaccount").select(F.col("z_pk").alias("outlet"), "zhandle")
    return model.with_root(model.replies(v.posts), v.posts, "left").join(F.broadcast(names), "outlet", "left").select("zuri", F.coalesce("zhandle", F.lit("unknown")).alias("outlet"))


@query("J10_probed_handles", f"{W} SELECT DISTINCT r.zauthordid, zcurrenthandle AS handle FROM r LEFT JOIN zreplyauthor ON zdid = r.zauthordid")
def _(v):
    probed = v.raw("zreplyauthor").select(F.col("zdid").alias("zauthordid"), F.col("zcurrenthandle").alias("handle"))
    return model.replies(v.posts).select("zauthordid").distinct().join(probed, "zauthordid", "left")


@query("J11_reply_scores", f"{S} SELECT r.zuri, score FROM r LEFT JOIN ls ON ls.uri = r.zuri")
def _(v):
    return model.replies(v.posts).join(v.latest_scores.select(F.col("uri").alias("zuri"), "score"), "zuri", "left").select("zuri", "score")


@query("J12_child_parent_scores", f"{S} SELECT c.zuri, x.score, y.score AS parent_score FROM r c JOIN ls x ON x.uri = c.zuri LEFT JOIN ls y ON y.uri = c.zparenturi")
def _(v):
    mine = v.latest_scores.select(F.col("uri").alias("zuri"), "score")
    above = v.latest_scores.select(F.col("uri").alias("zparenturi"), F.col("score").alias("parent_score"))
    return model.replies(v.posts).join(mine, "zuri").join(above, "zparenturi", "left").select("zuri", "score", "parent_score")


@query("J13_labels_of_scored", f"{S}, {LABELS}, {_ACT} SELECT ls.uri, score, string_agg(DISTINCT val, ',' ORDER BY val) AS labels FROM ls LEFT JOIN la ON la.uri = ls.uri GROUP BY 1, 2")
def _(v):
    labels = latest.label_values(latest.latest_then_active(v.labels))
    return v.latest_scores.select("uri", "score").join(labels, "uri", "left")


@query("J14_annotation_posts", f"{A} SELECT a.z_pk, zuri FROM a JOIN p ON p.z_pk = a.post")
def _(v):
    return v.notes.select("z_pk", "post").join(v.posts.select(F.col("z_pk").alias("post"), "zuri"), "post").select("z_pk", "zuri")


@query("J16_two_passes", f"{A}, x AS (SELECT DISTINCT post FROM a WHERE stage = 'human' AND pass = 1 AND post IS NOT NULL), y AS (SELECT DISTINCT post FROM a WHERE stage = 'human' AND pass = 2 AND post IS NOT NULL) SELECT post FROM x JOIN y USING (post)")
def _(v):
    of = lambda k: v.notes.filter((F.col("stage") == "human") & (F.col("pass") == k) & F.col("post").isNotNull()).select("post").distinct()
    return of(1).join(of(2), "post")


@query("J19_merged_entries", "SELECT e.item_id, coalesce(o.lang, e.lang) AS lang, e.speech_class FROM evalset e LEFT JOIN (SELECT item_id, upper(lang) AS lang FROM evalset WHERE speech_class = 'positive') o USING (item_id)")
def _(v):
    fresh = v.raw("evalset").select("item_id", "lang", "speech_class")
    kept = fresh.filter("speech_class = 'positive'").select("item_id", F.upper("lang").alias("lang"))
    return latest.merged_entries(fresh, kept, "item_id", ["lang"])


@query("U1_score_union", f"{S} SELECT uri, seq FROM s UNION ALL SELECT uri, seq FROM s WHERE score > 0.9")
def _(v):
    return v.scores.select("uri", "seq").unionByName(v.scores.filter("score > 0.9").select("uri", "seq"))


_DRAWN = f"{A}, d AS (SELECT annotator, post, coalesce(bool_or(class IN ('hate', 'counter', 'neutral')), false) AS done FROM a WHERE stage = 'human' AND post IS NOT NULL AND annotator <> '' GROUP BY 1, 2)"


def _drawn(v):
    rows = v.notes.filter("stage = 'human' AND post IS NOT NULL AND annotator <> ''")
    return rows.select(F.col("annotator").alias("batch"), "post"), rows.filter(F.col("class").isin(model.CLASSES)).select(F.col("annotator").alias("batch"), "post")


@query("U4_unlabelled", f"{_DRAWN} SELECT annotator, post FROM d WHERE NOT done")
def _(v):
    return sampling.unlabelled(*_drawn(v), "batch", "post").withColumnRenamed("batch", "annotator")


@query("U5_complete", f"{_DRAWN} SELECT annotator, bool_and(done) AS complete FROM d GROUP BY 1")
def _(v):
    return sampling.complete(*_drawn(v), "batch", "post").withColumnRenamed("batch", "annotator")


@query("U6_common_keys", "SELECT zuri FROM zpost INTERSECT SELECT zuri FROM zpost_snapshot")
def _(v):
    return v.raw("zpost").select("zuri").intersect(v.raw("zpost_snapshot").select("zuri"))


@query("M4_percentiles", f"{S} SELECT model, round(quantile_cont(score, 0.1), 6) AS p10, round(quantile_cont(score, 0.9), 6) AS p90 FROM s GROUP BY 1")
def _(v):
    return rounded(percentiles_within(v.scores, ["model"], "score", {"p10": 0.1, "p90": 0.9}), "p10", "p90")


@query("M5_median_delay", f"{L}, {_ACT} SELECT val, round(quantile_cont((cts - created) / 86400, 0.5), 6) AS median_days FROM la JOIN p ON p.zuri = la.uri GROUP BY 1")
def _(v):
    rows = latest.latest_then_active(v.labels).join(v.posts.select(F.col("zuri").alias("uri"), "created"), "uri")
    days = rows.select("val", ((F.col("cts") - F.col("created")) / 86400).alias("days"))
    return rounded(percentiles_within(days, ["val"], "days", {"median_days": 0.5}), "median_days")


@query("M12_label_delays", f"{L}, {_ACT} SELECT uri, val, round((cts - created) / 86400, 6) AS days FROM la JOIN p ON p.zuri = la.uri")
def _(v):
    rows = latest.latest_then_active(v.labels).join(v.posts.select(F.col("zuri").alias("uri"), "created"), "uri")
    return rows.select("uri", "val", F.round((F.col("cts") - F.col("created")) / 86400, 6).alias("days"))


@query("C3_parsed_times", f"WITH {MESSAGES} SELECT channel, msg_id, CAST(epoch(TRY_CAST(sent_at AS TIMESTAMPTZ)) AS BIGINT) AS sent_s FROM m")
def _(v):
    return v.messages.select("channel", "msg_id", F.unix_seconds(F.try_to_timestamp("sent_at")).alias("sent_s"))


@query("C15_frame_hashes", "SELECT z_pk, sha256(zframejson) AS frame_hash FROM zlabelbatch")
def _(v):
    return v.raw("zlabelbatch").select("z_pk", F.sha2("zframejson", 256).alias("frame_hash"))


@query("C16_interval_text", f"{A}, k AS (SELECT model, count(*) AS n, count(*) FILTER (class = 'hate') AS h FROM a WHERE stage = 'llm' GROUP BY 1) SELECT model, printf('%.1f %% (%.1f-%.1f %%)', 100.0 * h / n, 0.0, 100.0) AS share FROM k")
def _(v):
    k = v.notes.filter("stage = 'llm'").groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("class") == "hate").alias("h"))
    return k.select("model", text.percent_interval(F.col("h") / F.col("n"), F.lit(0.0), F.lit(1.0)).alias("share"))


@query("C20_gold_labels", f"{A} SELECT post, coalesce(max(class) FILTER (stage = 'human' AND class = 'hate'), max(class) FILTER (stage = 'llm' AND class IN ('hate', 'counter', 'neutral'))) AS gold FROM a WHERE post IS NOT NULL GROUP BY 1 HAVING gold IS NOT NULL")
def _(v):
    mine = F.max(F.when((F.col("stage") == "human") & (F.col("class") == "hate"), F.col("class")))
    theirs = F.max(F.when((F.col("stage") == "llm") & F.col("class").isin(model.CLASSES), F.col("class")))
    return v.notes.filter("post IS NOT NULL").groupBy("post").agg(F.coalesce(mine, theirs).alias("gold")).filter("gold IS NOT NULL")


@query("C21_reconciled_severity", f"{A}, x AS (SELECT post, max(class) AS class, min(class) AS other, max(severity) AS severity FROM a WHERE stage = 'human' AND post IS NOT NULL AND class IN ('hate', 'counter', 'neutral') GROUP BY 1) SELECT post, class, CASE WHEN class = other THEN severity END AS severity FROM x")
def _(v):
    x = v.notes.filter("stage = 'human' AND post IS NOT NULL AND class IN ('hate', 'counter', 'neutral')").groupBy("post").agg(F.max("class").alias("class"), F.min("class").alias("other"), F.max("severity").alias("severity"))
    return x.select("post", "class", F.when(F.col("class") == F.col("other"), F.col("severity")).alias("severity"))


@query("C23_uniform_numbers", """WITH g AS (SELECT i, (7::UHUGEINT + (i + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM range(1000) t(i)),
a AS (SELECT i, (xor(z::UBIGINT, (z // 1073741824)::UBIGINT)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM g),
b AS (SELECT i, (xor(z::UBIGINT, (z // 134217728)::UBIGINT)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM a),
c AS (SELECT i, xor(z::UBIGINT, (z // 2147483648)::UBIGINT)::HUGEINT AS z FROM b)
SELECT i AS "at", CAST(CASE WHEN z >= 9223372036854775808 THEN z - 18446744073709551616 ELSE z END AS BIGINT) AS value FROM c""")
def _(v):
    return v.spark.createDataFrame(sampling.uniform_numbers(7, 1000))


@query("W10_week_before", f"{W}, k AS (SELECT {week('created')} AS week, count(*) AS n FROM p WHERE {in_range('created')} GROUP BY 1) SELECT week, n, lag(n) OVER (ORDER BY week) AS before FROM k")
def _(v):
    from pyspark.sql import Window

    return au.per_week(v.posts).select("week", F.col("n_posts").alias("n"), F.lag("n_posts").over(Window.orderBy("week")).alias("before"))


@query("P4_control_pool", f"{A} SELECT count(*) AS n_pool FROM r WHERE length(trim(ztext)) > 0 AND zuri NOT IN (SELECT p.zuri FROM a JOIN p ON p.z_pk = a.post)")
def _(v):
    seen = v.notes.filter("post IS NOT NULL").select(F.col("post").alias("z_pk")).join(v.posts.select("z_pk", "zuri"), "z_pk").select("zuri").distinct()
    return model.replies(v.posts).filter(F.length(F.trim("ztext")) > 0).join(seen, "zuri", "left_anti").agg(F.count("*").alias("n_pool"))


@query("A13_stream_of_weeks", f"SELECT {week('zcreatedat')} AS week, count(*) AS n FROM zpost WHERE {in_range('zcreatedat')} AND NOT isnan(zcreatedat) GROUP BY 1")
def _(v):
    """The weekly counts as a stream that has come to its end; all rows count, as nothing is older than the watermark allows."""
    from corpusloom.streaming.weekly import weekly_counts

    path = f"{v.sf_dir}/zpost.parquet"
    like = v.raw("zpost").select("zcreatedat")
    reader = v.spark.readStream.schema(like.schema)
    rows = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", "zpost.parquet").parquet(v.sf_dir)
    timed = rows.filter(ranged(F.col("zcreatedat"))).withColumn("at", to_timestamp(F.col("zcreatedat")))
    name = f"weeks_{uuid.uuid4().hex}"
    weekly_counts(timed, "at", [], late="4000 days").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return v.spark.table(name)


@query("M6_wilson", f"{A}, k AS (SELECT model, count(*) AS n, count(*) FILTER (class = 'hate') AS h FROM a WHERE stage = 'llm' GROUP BY 1) SELECT model, n, h, round(greatest(0, (h / n + 3.8416 / (2 * n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) AS low, round(least(1, (h / n + 3.8416 / (2 * n) + 1.96 * sqrt(h / n * (1 - h / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) AS high FROM k")
def _(v):
    k = v.notes.filter("stage = 'llm'").groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("class") == "hate").alias("h"))
    low, high = stats.wilson(F.col("h"), F.col("n"))
    return k.select("model", "n", "h", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("C1_unix_times", f"{W} SELECT zuri, CAST(floor(created + 978307200) AS BIGINT) AS unix_s FROM p WHERE {in_range('created')}")
def _(v):
    return v.posts.filter(ranged(F.col("created"))).select("zuri", F.unix_seconds(to_timestamp(F.col("created"))).alias("unix_s"))


@query("M14_monday_weeks", f"{W} SELECT CAST(date_trunc('week', {at('created')}) AS DATE) AS monday, count(*) AS n FROM r JOIN t ON r.zrooturi = t.turi WHERE outlet = {OUTLET} AND {in_range('created')} GROUP BY 1")
def _(v):
    rows = model.with_root(model.replies(v.posts), v.posts).filter(F.col("outlet") == OUTLET)
    return au.per_week(rows).withColumnsRenamed({"week": "monday", "n_posts": "n"})

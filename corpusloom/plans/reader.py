"""Queries of the interactive reader: authors, population, roots, pool, weeks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.stats import language_bucket
from corpusloom.functions.text import contains_text, has_text, has_words, long_enough
from corpusloom.operators import authors as au
from corpusloom.operators import model, roots, weekly
from corpusloom.plans.views import HEAVIEST, LATEST, LEAST, MOST, NOTES, NOW, OUTLET, POSTS, SCORES, Views, in_range, week

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


W = f"WITH {POSTS}"
_AUTHORS = """x AS (SELECT r.zauthordid, count(*) AS reply_count, min(created) AS first_seen, max(created) AS last_seen, count(DISTINCT outlet) AS n_outlets,
 arg_max(zauthorhandle, (coalesce(created, '-infinity'::DOUBLE), zuri)) FILTER (zauthorhandle IS NOT NULL) AS reply_handle FROM r {join} GROUP BY 1),
f AS (SELECT x.zauthordid, reply_count, first_seen, last_seen, n_outlets, coalesce(zcurrenthandle, reply_handle) AS handle FROM x LEFT JOIN zreplyauthor z ON z.zdid = x.zauthordid)"""
_LEFT, _IN = _AUTHORS.format(join="LEFT JOIN t ON r.zrooturi = t.turi"), _AUTHORS.format(join=f"JOIN t ON r.zrooturi = t.turi WHERE outlet = {OUTLET}")
_LIST = "zauthordid, reply_count, first_seen, last_seen, n_outlets, handle"


@query("A1_author_count", f"{W} SELECT count(DISTINCT zauthordid) AS n_authors FROM r")
def _(v):
    return au.author_count(v.posts)


@query("A2_authors_in_range", f"{W} SELECT count(*) AS n_authors FROM (SELECT zauthordid FROM r GROUP BY 1 HAVING count(*) BETWEEN {LEAST} AND {MOST})")
def _(v):
    return au.authors_in_range(v.posts, LEAST, MOST)


@query("A2_authors_in_range_of_outlet", f"{W} SELECT count(*) AS n_authors FROM (SELECT zauthordid FROM r JOIN t ON r.zrooturi = t.turi WHERE outlet = {OUTLET} GROUP BY 1 HAVING count(*) BETWEEN {LEAST} AND {MOST})")
def _(v):
    return au.authors_in_range(v.posts, LEAST, MOST, OUTLET)


@query("A3_authors", f"{W}, {_LEFT} SELECT {_LIST} FROM f")
def _(v):
    return au.authors(v.posts, v.raw("zreplyauthor"))


@query("A3_authors_of_outlet", f"{W}, {_IN} SELECT {_LIST} FROM f WHERE reply_count >= {LEAST}")
def _(v):
    return au.authors(v.posts, v.raw("zreplyauthor"), LEAST, None, OUTLET)


for _by, _order in {"replies": "reply_count DESC", "first": "first_seen ASC NULLS LAST", "last": "last_seen DESC NULLS LAST", "span": "last_seen - first_seen DESC NULLS LAST", "did": "zauthordid"}.items():
    query(f"O1_authors_by_{_by}", f"{W}, {_LEFT} SELECT {_LIST} FROM f ORDER BY {_order}, zauthordid LIMIT 500")(lambda v, by=_by: au.sorted_authors(au.authors(v.posts, v.raw("zreplyauthor")), by, 500))


@query("O3_showing_of", f"{W}, {_LEFT}, c AS (SELECT count(*) AS total FROM f WHERE reply_count >= {LEAST}) SELECT {_LIST}, total FROM (SELECT * FROM f WHERE reply_count >= {LEAST} ORDER BY reply_count DESC, zauthordid LIMIT 100), c")
def _(v):
    found = au.authors(v.posts, v.raw("zreplyauthor"), LEAST)
    total = found.agg(F.count("*").alias("total")).withColumn("_k", F.lit(0))
    return au.sorted_authors(found, "replies", 100).withColumn("_k", F.lit(0)).join(F.broadcast(total), "_k").drop("_k")


@query("A4_outlet_counts", f"{W}, g AS (SELECT zauthordid FROM r WHERE zauthordid IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 100) SELECT g.zauthordid, count(DISTINCT outlet) AS n_outlets FROM g LEFT JOIN r ON r.zauthordid = g.zauthordid LEFT JOIN t ON r.zrooturi = t.turi GROUP BY 1")
def _(v):
    page = model.replies(v.posts).filter("zauthordid IS NOT NULL").groupBy("zauthordid").count().orderBy(F.desc("count"), "zauthordid").limit(100)
    return au.outlet_counts(v.posts, page)


@query("A5_author_detail", f"{W} SELECT zauthordid, count(*) AS reply_count, min(created) AS first_seen, max(created) AS last_seen, count(DISTINCT outlet) AS n_outlets, max(zcurrenthandle) AS handle, max(zcurrentstatus) AS status FROM r JOIN t ON r.zrooturi = t.turi LEFT JOIN zreplyauthor z ON z.zdid = zauthordid WHERE zauthordid = {HEAVIEST} GROUP BY 1")
def _(v):
    return au.author_detail(v.of_author, v.root_posts, v.raw("zreplyauthor"), v.heaviest)


@query("A6_author_reply_count", f"{W} SELECT count(*) AS n_replies FROM r WHERE zauthordid = {HEAVIEST}")
def _(v):
    return model.replies(v.of_author).agg(F.count("*").alias("n_replies"))


@query("A7_outlet_breakdown", f"{W} SELECT outlet, count(*) AS n_replies, max(zhandle) AS outlet_handle FROM r JOIN t ON r.zrooturi = t.turi JOIN ztrackedaccount k ON k.z_pk = outlet WHERE zauthordid = {HEAVIEST} GROUP BY 1")
def _(v):
    return au.outlet_breakdown(v.of_author, v.root_posts, v.raw("ztrackedaccount"), v.heaviest)


_PER = "c AS (SELECT zauthordid, count(*) AS c, max(created) AS last_seen FROM r GROUP BY 1)"


@query("A8_population", f"{W}, {_PER} SELECT count(*) AS n_authors, CAST(sum(c) AS BIGINT) AS n_replies, count(*) FILTER (last_seen BETWEEN {NOW} - 2592000 AND {NOW}) AS n_active, list_sort(list(c))[(count(*) // 2)::INT + 1] AS median_replies FROM c")
def _(v):
    return au.population(v.posts, v.raw("zreplyauthor"), NOW)


@query("M1_upper_median", f"{W}, {_PER} SELECT list_sort(list(c))[(count(*) // 2)::INT + 1] AS median_replies FROM c")
def _(v):
    return au.upper_median(au.replies_per_author(v.posts), "c", "zauthordid")


@query("M2_histogram", f"{W}, {_PER}, h(bin, lo, hi) AS (VALUES ('1', 1, 1), ('2-9', 2, 9), ('10-99', 10, 99), ('100-999', 100, 999), ('1000+', 1000, NULL)) SELECT bin, count(c.c) AS n_authors FROM h LEFT JOIN c ON c.c >= lo AND (hi IS NULL OR c.c <= hi) GROUP BY 1")
def _(v):
    return au.histogram(au.replies_per_author(v.posts), "c")


@query("M3_active_authors", f"{W}, {_PER} SELECT count(*) AS n_active FROM c WHERE last_seen BETWEEN {NOW} - 2592000 AND {NOW}")
def _(v):
    return au.replies_per_author(v.posts).filter(F.col("last_seen").between(NOW - au.MONTH, NOW)).agg(F.count("*").alias("n_active"))


@query("M15_span_days", f"{W}, {_LEFT} SELECT zauthordid, CAST(greatest(0, floor((last_seen - first_seen) / 86400)) AS BIGINT) AS span_days FROM f WHERE first_seen IS NOT NULL")
def _(v):
    return au.seen_ranges(v.posts).filter("first_seen IS NOT NULL").select("zauthordid", au.span_days(F.col("first_seen"), F.col("last_seen")).alias("span_days"))


@query("A9_outlet_authors", f"{W} SELECT outlet, count(DISTINCT zauthordid) AS n_authors, count(*) AS n_replies FROM r JOIN t ON r.zrooturi = t.turi GROUP BY 1")
def _(v):
    return au.outlet_authors(v.posts)


@query("A10_status_counts", "SELECT coalesce(zcurrentstatus, 'unknown') AS status, count(*) AS n_authors, count(zlastprobedat) AS n_probed FROM zreplyauthor GROUP BY 1")
def _(v):
    return au.status_counts(v.raw("zreplyauthor"))


@query("A33_probed", "SELECT count(*) AS n_authors, count(zlastprobedat) AS n_probed FROM zreplyauthor")
def _(v):
    return v.raw("zreplyauthor").agg(F.count("*").alias("n_authors"), F.count("zlastprobedat").alias("n_probed"))


@query("A11_seen_ranges", f"{W} SELECT zauthordid, min(created) AS first_seen, max(created) AS last_seen FROM r GROUP BY 1")
def _(v):
    return au.seen_ranges(v.posts)


@query("A12_new_authors_per_week", f"{W} SELECT {week('first_seen')} AS week, count(*) AS n_authors FROM (SELECT zauthordid, min(created) AS first_seen FROM r WHERE {in_range('created')} GROUP BY 1) GROUP BY 1")
def _(v):
    return au.new_authors_per_week(v.posts)


_WEEKS = f"SELECT {week('created')} AS week, count(*) AS n_posts FROM {{rows}} AND {in_range('created')} GROUP BY 1"


@query("A13_replies_per_week_of_author", f"{W} {_WEEKS.format(rows=f'r WHERE zauthordid = {HEAVIEST}')}")
def _(v):
    return au.per_week(model.replies(v.of_author))


@query("A13_replies_per_week_of_accounts", f"{W} {_WEEKS.format(rows=f'r JOIN t ON r.zrooturi = t.turi WHERE outlet IN ({OUTLET}, 33, 20)')}")
def _(v):
    return au.per_week(au.replies_to_accounts(v.posts, [OUTLET, 33, 20]))


@query("A13_roots_per_week", f"{W} {_WEEKS.format(rows='p WHERE zisrootpost = 1')}")
def _(v):
    return au.per_week(v.root_posts)


@query("F3_empty_list", f"{W} SELECT zuri FROM r WHERE false")
def _(v):
    return au.replies_to_accounts(v.posts, []).select("zuri")


@query("U7_group_roots", f"{W} SELECT zuri, zaccount FROM p WHERE zisrootpost = 1 AND zaccount IN (38, 33, 20)")
def _(v):
    return model.posts_where(v.raw("zpost"), (F.col("zisrootpost") == 1) & F.col("zaccount").isin(38, 33, 20)).select("zuri", "zaccount")


@query("W7_newest_handle", f"{W} SELECT zauthordid, arg_max(zauthorhandle, (coalesce(created, '-infinity'::DOUBLE), zuri)) AS reply_handle FROM r WHERE zauthorhandle IS NOT NULL GROUP BY 1")
def _(v):
    return au.newest_handle(model.replies(v.posts))


@query("F13_handles", f"{W} SELECT DISTINCT zauthorhandle AS handle FROM r WHERE zauthordid = {HEAVIEST} AND zauthorhandle IS NOT NULL ORDER BY 1")
def _(v):
    return au.handles(v.of_author, v.heaviest)


@query("O4_newest_replies", f"{W} SELECT zuri, created, ztext FROM r WHERE zauthordid = {HEAVIEST} ORDER BY created DESC NULLS LAST, zuri LIMIT 100")
def _(v):
    return au.replies_of_author(v.of_author, v.heaviest)


@query("I8_author_backfill", f"{W}, g AS (SELECT zauthordid, min(created) AS f, max(created) AS l FROM r WHERE zauthordid IS NOT NULL GROUP BY 1) SELECT coalesce(zdid, zauthordid) AS zauthordid, least(zfirstseenat, f) AS first_seen, greatest(zlastseenat, l) AS last_seen, zfirstseenat IS NULL AS created_row FROM zreplyauthor FULL JOIN g ON zdid = zauthordid")
def _(v):
    seen = au.seen_ranges(v.posts).filter("zauthordid IS NOT NULL")
    return au.merged_ranges(v.raw("zreplyauthor"), seen)


_SIZES = "n AS (SELECT zrooturi AS nuri, count(*) AS n_replies FROM r WHERE zrooturi IS NOT NULL GROUP BY 1)"
_ROOTS = f"{W}, {_SIZES}, q AS (SELECT zuri, zaccount, created, ztext, zauthorhandle, coalesce(n_replies, 0) AS n_replies FROM p LEFT JOIN n ON nuri = zuri WHERE zisrootpost = 1)"


@query("A14_root_posts", f"{_ROOTS} SELECT zuri, zaccount, created, n_replies FROM q WHERE n_replies BETWEEN 0 AND 10")
def _(v):
    return roots.root_posts(v.posts, None, 0, 10)


@query("A14_root_posts_search", f"{_ROOTS} SELECT zuri, zaccount, created, n_replies FROM q WHERE contains(lower(ztext), 'harbour') OR contains(lower(zauthorhandle), 'harbour')")
def _(v):
    return roots.root_posts(v.posts, search="Harbour")


@query("A15_root_post_count", f"{_ROOTS} SELECT count(*) AS n_roots FROM q WHERE zaccount = {OUTLET} AND n_replies >= 1")
def _(v):
    return roots.root_posts(v.posts, OUTLET, *roots.preset_bounds("1+")).agg(F.count("*").alias("n_roots"))


for _name, (_lo, _hi) in roots.PRESETS.items():
    _test = " AND ".join([f"n_replies >= {_lo}"] * (_lo is not None) + [f"n_replies <= {_hi}"] * (_hi is not None)) or "true"
    query(f"F19_preset_{_name.replace('+', '_up').replace('-', '_to_')}", f"{_ROOTS} SELECT count(*) AS n_roots FROM q WHERE {_test}")(lambda v, n=_name: roots.root_posts(v.posts, None, *roots.preset_bounds(n)).agg(F.count("*").alias("n_roots")))


@query("J3_zero_reply_roots", f"{_ROOTS} SELECT count(*) AS n_roots, count(*) FILTER (n_replies = 0) AS n_without FROM q")
def _(v):
    return roots.root_posts(v.posts).agg(F.count("*").alias("n_roots"), F.count_if(F.col("n_replies") == 0).alias("n_without"))


_POOL = f"{W}, {_SIZES}, o AS (SELECT r.* FROM r JOIN t ON r.zrooturi = t.turi AND outlet = {OUTLET} JOIN n ON nuri = r.zrooturi WHERE length(trim(ztext)) > 0 AND created BETWEEN 690000000 AND 757000000 AND n_replies BETWEEN 2 AND 200)"
_FRAME = dict(since=690_000_000.0, until=757_000_000.0, outlet=OUTLET, least=2, most=200)


@query("A16_pool", f"{_POOL} SELECT zuri FROM o")
def _(v):
    return roots.pool(v.posts, **_FRAME).select("zuri")


@query("A16_pool_count", f"{_POOL} SELECT count(*) AS n_pool FROM o")
def _(v):
    return roots.pool(v.posts, **_FRAME).agg(F.count("*").alias("n_pool"))


@query("O5_pool_order", f"{_POOL} SELECT zuri FROM o ORDER BY zuri LIMIT 100")
def _(v):
    return roots.pool(v.posts, **_FRAME).select("zuri").orderBy("zuri").limit(100)


@query("P5_frame_thread_size", f"{W}, {_SIZES} SELECT count(*) AS n_pool FROM r JOIN n ON nuri = zrooturi WHERE length(trim(ztext)) > 0 AND created >= 740000000 AND n_replies >= 10")
def _(v):
    return roots.pool(v.posts, since=740_000_000.0, least=10).agg(F.count("*").alias("n_pool"))


@query("F7_date_range", f"{W} SELECT count(*) AS n_replies FROM r WHERE created BETWEEN 720000000 AND 730000000")
def _(v):
    return model.replies(model.posts_where(v.raw("zpost"), F.col("zcreatedat").between(720_000_000.0, 730_000_000.0))).agg(F.count("*").alias("n_replies"))


@query("F8_ingest_filter", f"{W} SELECT p.zuri FROM p JOIN ztrackedaccount k ON p.zaccount = k.z_pk WHERE p.created >= k.zstartat AND p.zauthordid = k.zdid AND NOT isnan(k.zstartat)")
def _(v):
    k = v.raw("ztrackedaccount").select(F.col("z_pk").alias("zaccount"), F.col("zdid"), model.number(F.col("zstartat")).alias("start"))
    met = model.posts(v.raw("zpost")).join(F.broadcast(k), "zaccount")
    return met.filter((F.col("created") >= F.col("start")) & (F.col("zauthordid") == F.col("zdid"))).select("zuri")


@query("F5_search", f"{W} SELECT zuri FROM p WHERE contains(lower(ztext), '100%') OR contains(lower(ztext), 'rail fare')")
def _(v):
    return v.posts.filter(contains_text(F.col("ztext"), "100%") | contains_text(F.col("ztext"), "Rail Fare")).select("zuri")


@query("F6_curated_substrings", f"""{W}, k(term, rank) AS (VALUES ('harbour tunnel', 1), ('Fahrpreis', 2), ('night bus', 3), ('no such thing', 4)), h AS (SELECT term, rank, min(zuri) AS zuri FROM k JOIN p ON contains(lower(ztext), lower(term)) GROUP BY ALL)
SELECT zuri, arg_min(term, rank) AS term FROM h GROUP BY 1""")
def _(v):
    terms = v.spark.createDataFrame([("harbour tunnel", 1), ("Fahrpreis", 2), ("night bus", 3), ("no such thing", 4)], "term string, rank int")
    return roots.search_terms(v.posts, terms)


@query("F9_text_tests", f"{W} SELECT count(*) AS n, count(*) FILTER (length(trim(ztext)) > 0) AS n_text, count(*) FILTER (regexp_matches(ztext, '\\S')) AS n_words, count(*) FILTER (length(regexp_replace(ztext, '^\\s+|\\s+$', '', 'g')) >= 10) AS n_long FROM r")
def _(v):
    t = F.col("ztext")
    return model.replies(v.posts).agg(F.count("*").alias("n"), F.count_if(has_text(t)).alias("n_text"), F.count_if(has_words(t)).alias("n_words"), F.count_if(long_enough(t)).alias("n_long"))


@query("F18_recent_authors", f"SELECT zdid FROM zreplyauthor WHERE zlastseenat BETWEEN {NOW} - 2592000 AND {NOW}")
def _(v):
    return v.raw("zreplyauthor").filter(F.col("zlastseenat").between(NOW - au.MONTH, NOW)).select("zdid")


@query("J5_labelling_context", f"""{W}
SELECT r.zuri, r.ztext, r.zrooturi, t.ttext AS root_text, CASE WHEN r.zparenturi <> r.zrooturi THEN r.zparenturi END AS parent_uri, CASE WHEN r.zparenturi <> r.zrooturi THEN q.ztext END AS parent_text FROM r JOIN t ON r.zrooturi = t.turi LEFT JOIN p q ON q.zuri = r.zparenturi""")
def _(v):
    return roots.labelling_context(v.posts, v.posts.select("zuri"))


@query("I4_rescrape_due", f"""{W} SELECT zuri, coalesce(coalesce(lower(trim(zreplytreestatus)) <> 'complete', true) OR c IS NULL OR c <= created + 1209600, false) AS due FROM (SELECT *, CASE WHEN NOT isnan(zreplytreelastchecked) THEN zreplytreelastchecked END AS c FROM p WHERE zisrootpost = 1)""")
def _(v):
    return roots.rescrape_due(v.root_posts)


@query("A24_account_totals", f"""{W} SELECT zaccount, count(*) AS n_posts, {', '.join(f'CAST(coalesce(sum(z{x}count), 0) AS BIGINT) AS total_{x}s' for x in ('like', 'reply', 'repost', 'quote'))} FROM p WHERE zisrootpost = 1 AND zaccount IS NOT NULL GROUP BY 1""")
def _(v):
    return roots.account_totals(v.root_posts)


_ACT = f"ra AS (SELECT {week('created')} AS week, count(*) AS n FROM p WHERE zisrootpost = 1 AND {in_range('created')} GROUP BY 1), rb AS (SELECT {week('created')} AS week, count(*) AS n FROM r WHERE {in_range('created')} GROUP BY 1), wk AS (SELECT coalesce(ra.week, rb.week) AS week, coalesce(ra.n, 0) AS n_roots, coalesce(rb.n, 0) AS n_replies FROM ra FULL JOIN rb ON ra.week = rb.week)"


@query("J20_weekly_activity", f"{W}, {_ACT} SELECT * FROM wk")
def _(v):
    return weekly.weekly_activity(v.posts)


@query("M16_trend", f"{W}, {_ACT} SELECT week, n_replies, round(CASE WHEN lag(n_replies) OVER (ORDER BY week) > 0 THEN (n_replies - lag(n_replies) OVER (ORDER BY week)) / lag(n_replies) OVER (ORDER BY week) ELSE 0 END, 6) AS change FROM wk")
def _(v):
    return weekly.trend(weekly.weekly_activity(v.posts), "n_replies").withColumn("change", F.round("change", 6))


@query("M18_last_weeks", f"{W}, {_ACT} SELECT * FROM wk ORDER BY week DESC LIMIT 12")
def _(v):
    return weekly.last_buckets(weekly.weekly_activity(v.posts))


@query("M17_weekly_classes", f"WITH {NOTES}, w AS (SELECT {week('created')} AS week, count(*) AS n, count(*) FILTER (class = 'hate') AS n_hate, count(*) FILTER (class = 'counter') AS n_counter FROM a WHERE {in_range('created')} AND class IN ('hate', 'counter', 'neutral') GROUP BY 1) SELECT *, round(n_hate / n, 6) AS hate_ratio, round(n_counter / n, 6) AS counter_ratio FROM w")
def _(v):
    return weekly.weekly_classes(v.notes).withColumns({c: F.round(c, 6) for c in ("hate_ratio", "counter_ratio")})


@query("A17_weekly_scores", f"""{W}, {NOTES}, {SCORES}, {LATEST}, j AS (SELECT outlet, strftime(make_timestamp(CAST(floor((created + 978307200) * 1000000) AS BIGINT)), '%G-W%V') AS week, score FROM r JOIN t ON r.zrooturi = t.turi LEFT JOIN ls ON ls.uri = r.zuri WHERE {in_range('created')})
SELECT outlet, week, count(*) AS n_total, count(score) AS n_scored, round(count(score) / count(*), 6) AS coverage, round(avg(score), 6) AS mean_score, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.9), 6) AS p90, round(count(*) FILTER (score > 0.5) / nullif(count(score), 0), 6) AS share_uncivil FROM j GROUP BY 1, 2""")
def _(v):
    return weekly.weekly_scores(v.posts, v.latest_scores).withColumns({c: F.round(c, 6) for c in ("coverage", "mean_score", "p50", "p90", "share_uncivil")})


@query("O6_decimated", f"""{W}, k AS (SELECT zuri, created, row_number() OVER (ORDER BY created, zuri) - 1 AS i, count(*) OVER () AS n FROM r WHERE zauthordid = {HEAVIEST} AND created IS NOT NULL),
g AS (SELECT unnest(range(1, 399)) AS i), x AS (SELECT DISTINCT greatest(1, least(n - 2, CAST(round(g.i * ((n - 2) / 399.0)) AS BIGINT))) AS i FROM g, (SELECT max(n) AS n FROM k))
SELECT zuri, created FROM k WHERE n <= 400 OR i = 0 OR i = n - 1 OR i IN (SELECT i FROM x)""")
def _(v):
    mine = model.replies(v.of_author).filter("created IS NOT NULL").select("zuri", "created")
    return weekly.decimated(mine, ["created", "zuri"], 400)


@query("M22_language_buckets", "SELECT CASE WHEN lower(substr(trim(lang), 1, 2)) IN ('en', 'de') THEN lower(substr(trim(lang), 1, 2)) ELSE 'other' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def _(v):
    return v.raw("documents").groupBy(language_bucket(F.col("lang")).alias("bucket")).agg(F.count("*").alias("n"))

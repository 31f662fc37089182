"""Queries of the analyses: structure, labels, metrics, samples, threads, channels, deletions, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import stats, text
from corpusloom.functions.time import in_range as ranged
from corpusloom.functions.time import iso_week, to_timestamp, week_start
from corpusloom.functions.uri import normal_uuid
from corpusloom.operators import channels, deletions, incremental, latest, metrics, model, sampling, structure, threads
from corpusloom.plans.problems import sql_uuid
from corpusloom.plans.views import BATCHES, HEAVIEST, LABELS, LATEST, MESSAGES, NOTES, POSTS, SCORES, Views, at, in_range

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

# structure: R1, R2, R3 and what they are built of
_SR = f"{S}, y AS (SELECT r.*, coalesce(CAST(outlet AS VARCHAR), 'unknown') AS outlet_name, ls.score FROM r LEFT JOIN t ON r.zrooturi = t.turi LEFT JOIN ls ON ls.uri = r.zuri)"
_AS = f"{_SR}, g AS (SELECT zauthordid, count(*) AS reply_count, count(score) AS n_scored, avg(score) AS mean_score, max(score) AS max_score, count(*) FILTER (score > 0.5) AS n_above, coalesce(sum(score), 0.0) AS mass FROM y GROUP BY 1)"


def _rows(v):
    return structure.scored_replies(v.posts, v.latest_scores)


@query("A18_author_scores", f"{_AS} SELECT zauthordid, reply_count, n_scored, round(mean_score, 6) AS mean_score, round(max_score, 6) AS max_score, n_above, round(mass, 6) AS mass FROM g")
def _(v):
    return rounded(structure.author_scores(_rows(v)), "mean_score", "max_score", "mass")


@query("M8_gini", f"{_AS}, k AS (SELECT mass, row_number() OVER (ORDER BY mass, zauthordid) AS i FROM g WHERE n_scored > 0) SELECT round(CASE WHEN sum(mass) > 0 THEN 2 * sum(i * mass) / (count(*) * sum(mass)) - (count(*) + 1) / count(*) ELSE 0 END, 6) AS gini FROM k")
def _(v):
    return rounded(structure.gini(structure.author_scores(_rows(v)).filter("n_scored > 0"), "mass", "zauthordid"), "gini")


_RK = f"{_AS}, v AS (SELECT *, row_number() OVER (ORDER BY reply_count DESC, zauthordid NULLS FIRST) AS volume_rank, CASE WHEN n_scored >= 10 THEN row_number() OVER (PARTITION BY n_scored >= 10 ORDER BY mean_score DESC, zauthordid NULLS FIRST) END AS mean_rank FROM g)"


def _share_sql(rank: str, f: float) -> str:
    return f"(SELECT round(sum(mass) FILTER ({rank} <= greatest(1, round_even(n * {f}, 0))) / nullif(sum(mass), 0), 6) FROM (SELECT mass, {rank}, count(*) OVER () AS n FROM v WHERE {rank} IS NOT NULL))"


for _name, _rank in (("volume", "volume_rank"), ("mean", "mean_rank")):
    for _f in (0.01, 0.1):
        query(f"M9_top_share_by_{_name}_{round(_f * 100)}", f"{_RK} SELECT {_share_sql(_rank, _f)} AS top_share")(
            lambda v, f=_f, rank=_rank: v.spark.createDataFrame([(structure.top_share(structure.ranked_authors(structure.author_scores(_rows(v))), "mass", rank, f),)], "s double").select(F.round("s", 6).alias("top_share"))
        )


@query("W11_ranked_authors", f"{_RK} SELECT zauthordid, reply_count, n_scored, volume_rank, mean_rank FROM v")
def _(v):
    return structure.ranked_authors(structure.author_scores(_rows(v))).select("zauthordid", "reply_count", "n_scored", "volume_rank", "mean_rank")


@query("R1_authors", f"{_RK} SELECT zauthordid, reply_count, n_scored, round(mean_score, 6) AS mean_score, round(max_score, 6) AS max_score, n_above, round(mass, 6) AS mass, volume_rank FROM v ORDER BY volume_rank")
def _(v):
    ranked = structure.ranked_authors(structure.author_scores(_rows(v))).drop("mean_rank")
    return rounded(ranked, "mean_score", "max_score", "mass").orderBy("volume_rank")


@query("R1_summary", f"""{_RK}, k AS (SELECT mass, row_number() OVER (ORDER BY mass, zauthordid) AS i FROM g WHERE n_scored > 0)
SELECT count(*) AS n_authors, sum(reply_count)::BIGINT AS n_replies, count(*) FILTER (n_scored = 0) AS n_authors_no_score, sum(reply_count - n_scored)::BIGINT AS n_replies_no_score, count(mean_rank) AS n_eligible_for_mean_rank,
(SELECT round(CASE WHEN sum(mass) > 0 THEN 2 * sum(i * mass) / (count(*) * sum(mass)) - (count(*) + 1) / count(*) ELSE 0 END, 6) FROM k) AS gini,
{_share_sql('volume_rank', 0.01)} AS top1pct_share_by_volume, {_share_sql('volume_rank', 0.1)} AS top10pct_share_by_volume, {_share_sql('mean_rank', 0.01)} AS top1pct_share_by_mean_score, {_share_sql('mean_rank', 0.1)} AS top10pct_share_by_mean_score FROM v""")
def _(v):
    return rounded(structure.concentration(structure.author_scores(_rows(v))), "gini", *[f"top{k}pct_share_by_{r}" for r in ("volume", "mean_score") for k in (1, 10)])


_B = "CASE WHEN coalesce(zdepth, 0) BETWEEN 1 AND 3 THEN CAST(zdepth AS VARCHAR) WHEN zdepth >= 4 THEN '4+' ELSE 'unknown' END"
_WLO, _WHI = (f"CASE WHEN {{n}} > 0 THEN {f}({e}, (({{k}} / {{n}}::DOUBLE + 3.8416 / (2 * {{n}})) {s} 1.96 * sqrt(({{k}} / {{n}}::DOUBLE) * (1 - {{k}} / {{n}}::DOUBLE) / {{n}} + 3.8416 / (4.0 * {{n}} * {{n}}))) / (1 + 3.8416 / {{n}})) ELSE 0.0 END" for f, e, s in (("greatest", "0.0", "-"), ("least", "1.0", "+")))


_CELLS = (("base", "n_base_uncivil", "n"), ("after_bad", "bad_after_bad", "n_after_bad"), ("after_good", "bad_after_good", "n_after_good"))


@query("R2_escalation", f"""{_SR}, c AS (SELECT y.outlet_name, {_B.replace('zdepth', 'y.zdepth')} AS depth_bucket, y.score > 0.5 AS bad, q.score > 0.5 AS above FROM y LEFT JOIN ls q ON q.uri = y.zparenturi WHERE y.score IS NOT NULL),
u AS (SELECT CASE WHEN grouping(outlet_name) = 1 THEN 'ALL' ELSE outlet_name END AS outlet_name, CASE WHEN grouping(depth_bucket) = 1 THEN 'ALL' ELSE depth_bucket END AS depth_bucket, count(*) AS n, count(*) FILTER (bad) AS n_base_uncivil, count(*) FILTER (above) AS n_after_bad, count(*) FILTER (NOT above) AS n_after_good, count(*) FILTER (above AND bad) AS bad_after_bad, count(*) FILTER (NOT above AND bad) AS bad_after_good FROM c GROUP BY CUBE (outlet_name, depth_bucket))
SELECT *, n < 100 AS small_n, {', '.join(f"round({k} / nullif({n}, 0), 6) AS p_{x}, round({_WLO.format(k=k, n=n)}, 6) AS {x}_low, round({_WHI.format(k=k, n=n)}, 6) AS {x}_high" for x, k, n in _CELLS)} FROM u""")
def _(v):
    return rounded(structure.escalation(_rows(v), v.latest_scores), *[c for x, _, _ in _CELLS for c in (f"p_{x}", f"{x}_low", f"{x}_high")])


_DEC = f"{S}, d AS (SELECT uri, score, least(9, (10 * (row_number() OVER (ORDER BY score, uri) - 1)) // count(*) OVER ()) + 1 AS decile FROM ls)"


@query("M10_deciles", f"{_DEC} SELECT uri, score, CAST(decile AS BIGINT) AS decile FROM d")
def _(v):
    return structure.deciles(v.latest_scores.select("uri", "score"))


_ACT = "lt AS (SELECT uri, val, cts, neg FROM l QUALIFY row_number() OVER (PARTITION BY uri, val ORDER BY cts DESC NULLS LAST, seq DESC) = 1), la AS (SELECT uri, val, cts FROM lt WHERE NOT neg)"


@query("R3_moderation", f"""{_DEC.replace('d AS (', f'{LABELS}, {_ACT}, d AS (', 1)}, j AS (SELECT d.uri, decile, p.created FROM d LEFT JOIN p ON p.zuri = d.uri), h AS (SELECT uri, bool_or(val = 'hate') AS hate, bool_or(val = 'counter') AS counter FROM la GROUP BY 1),
c AS (SELECT decile, count(*) AS n, count(h.uri) AS n_labelled, count(*) FILTER (hate) AS n_hate, count(*) FILTER (counter) AS n_counter FROM j LEFT JOIN h USING (uri) GROUP BY 1), w AS (SELECT decile, quantile_cont((cts - created) / 86400, 0.5) AS m FROM j JOIN la USING (uri) GROUP BY 1)
SELECT CAST(decile AS BIGINT) AS decile, n, n_labelled, n_hate, n_counter, round({_WLO.format(k='n_labelled', n='n')}, 6) AS low, round({_WHI.format(k='n_labelled', n='n')}, 6) AS high, round(m, 6) AS median_days FROM c LEFT JOIN w USING (decile)""")
def _(v):
    found = structure.moderation_by_decile(v.latest_scores, latest.latest_then_active(v.labels), v.posts)
    return rounded(found, "low", "high", "median_days")


# latest-wins logs and labels
@query("W4_latest_scores", f"{S} SELECT uri, score, model, scored_at FROM ls")
def _(v):
    return v.latest_scores


@query("W5_latest_by_time", f"{S} SELECT uri, score, model, scored_at FROM s QUALIFY row_number() OVER (PARTITION BY uri ORDER BY scored_at DESC NULLS LAST, seq DESC) = 1")
def _(v):
    return latest.latest_scores_by_time(v.scores)


@query("F15_active_labels", f"{L} SELECT uri, val, cts FROM l WHERE NOT neg QUALIFY row_number() OVER (PARTITION BY uri, val ORDER BY cts DESC NULLS LAST, seq DESC) = 1")
def _(v):
    return latest.active_then_latest(v.labels)


@query("W6_latest_labels", f"{L}, {_ACT} SELECT * FROM la")
def _(v):
    return latest.latest_then_active(v.labels)


@query("A34_label_values", f"{L}, {_ACT} SELECT uri, string_agg(DISTINCT val, ',' ORDER BY val) AS labels FROM la GROUP BY 1")
def _(v):
    return latest.label_values(latest.latest_then_active(v.labels))


@query("A23_sweep_counts", f"{L} SELECT val, count(*) FILTER (NOT neg) AS n_active, count(*) FILTER (neg) AS n_negated FROM l GROUP BY 1")
def _(v):
    return latest.sweep_counts(v.labels)


@query("A23_sweep_subjects", f"{L}, k AS (SELECT uri, bool_or(NOT neg) AS active FROM l GROUP BY 1) SELECT count(*) FILTER (active) AS n_active_subjects, count(*) FILTER (NOT active) AS n_negated_subjects FROM k")
def _(v):
    return latest.sweep_subjects(v.labels)


_ORDER = "ORDER BY created DESC NULLS LAST, z_pk DESC"


@query("W1_newest_by_stage", f"{A} SELECT post, stage, z_pk, class FROM a WHERE post IS NOT NULL QUALIFY row_number() OVER (PARTITION BY post, stage {_ORDER}) = 1")
def _(v):
    return latest.newest_by_stage(v.notes)


@query("W2_deduplicated", f"{A} SELECT z_pk FROM (SELECT * FROM a WHERE stage = 'llm' AND post IS NOT NULL QUALIFY row_number() OVER (PARTITION BY post, model {_ORDER}) = 1) UNION ALL SELECT z_pk FROM a WHERE NOT coalesce(stage = 'llm' AND post IS NOT NULL, false)")
def _(v):
    return latest.deduplicated(v.notes)


_PRED = f"{A}, pr AS (SELECT post, model, class, confidence FROM a WHERE stage = 'llm' AND post IS NOT NULL AND confidence > 0 QUALIFY row_number() OVER (PARTITION BY post, model {_ORDER}) = 1)"


@query("W3_latest_predictions", f"{_PRED} SELECT * FROM pr")
def _(v):
    return latest.latest_predictions(v.notes)


@query("J17_shared_posts", f"{_PRED} SELECT post, count(DISTINCT model) AS n_models FROM pr GROUP BY 1 HAVING count(DISTINCT model) >= 2")
def _(v):
    return latest.shared_by_models(latest.latest_predictions(v.notes), 2)


@query("M25_model_agreement", f"{_PRED} SELECT x.model AS model_a, y.model AS model_b, count(*) AS n_shared, round(avg(CASE WHEN x.class = y.class THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM pr x JOIN pr y ON x.post = y.post AND x.model < y.model WHERE x.class IS NOT NULL AND y.class IS NOT NULL GROUP BY 1, 2")
def _(v):
    found = latest.latest_predictions(v.notes).filter("class IS NOT NULL")
    return rounded(metrics.model_agreement(found, "post", "model", "class"), "agreement")


@query("U2_preferred_tags", f"{A}, x AS (SELECT DISTINCT post FROM a WHERE stage = 'llm' AND post IS NOT NULL), y AS (SELECT DISTINCT post FROM a WHERE stage = 'human' AND class = 'hate' AND post IS NOT NULL) SELECT post, max(tag) AS tag FROM (SELECT post, 'core' AS tag FROM x UNION ALL SELECT post, 'hard' FROM y) GROUP BY 1")
def _(v):
    some = v.notes.filter("post IS NOT NULL")
    return latest.preferred(some.filter("stage = 'llm'").select("post"), some.filter("stage = 'human' AND class = 'hate'").select("post"), "post")


_OUT = f"""{A}, {BATCHES}, o AS (SELECT a.z_pk, a.class, a.post, CASE WHEN a.batch IS NULL THEN 'no_batch' WHEN b.pass IS NULL AND b.kind IS NULL THEN 'unknown_batch' WHEN b.kind IS NULL THEN 'bad_frame' WHEN b.kind <> 'uniformRandom' THEN 'not_random' WHEN b.pass <> 1 THEN 'second_pass' WHEN NOT coalesce(a.class IN ('hate', 'counter', 'neutral'), false) THEN 'no_class' ELSE 'counted' END AS reason FROM a LEFT JOIN b ON a.batch = b.batch WHERE a.stage = 'human')"""


@query("J15_batch_outcomes", f"{_OUT} SELECT * FROM o")
def _(v):
    return latest.batch_outcomes(v.notes, v.batches)


@query("A28_base_rate_counts", f"{_OUT} SELECT reason, coalesce(class, 'none') AS class, count(*) AS n FROM o GROUP BY ALL")
def _(v):
    return latest.base_rate_counts(latest.batch_outcomes(v.notes, v.batches))


@query("R5_base_rate", f"{_OUT}, k AS (SELECT count(*) FILTER (reason = 'counted') AS n, count(*) FILTER (reason = 'counted' AND class = 'hate') AS n_hate FROM o) SELECT n, n_hate, round(n_hate / nullif(n, 0), 6) AS rate, round(CASE WHEN n > 0 THEN {_WLO.format(k='n_hate', n='n')} END, 6) AS low, round(CASE WHEN n > 0 THEN {_WHI.format(k='n_hate', n='n')} END, 6) AS high, CASE WHEN n > 0 THEN 'ok' ELSE 'no_data' END AS status FROM k")
def _(v):
    return rounded(latest.base_rate(latest.batch_outcomes(v.notes, v.batches)), "rate", "low", "high")


@query("M7_false_per_true", f"{_OUT}, k AS (SELECT count(*) FILTER (reason = 'counted' AND class = 'hate') / nullif(count(*) FILTER (reason = 'counted'), 0) AS p FROM o) SELECT round(CASE WHEN p > 0 THEN 0.05 * (1 - p) / (0.88 * p) END, 6) AS false_per_true FROM k")
def _(v):
    rate = latest.base_rate(latest.batch_outcomes(v.notes, v.batches))
    return rate.select(F.round(stats.false_per_true(F.col("rate")), 6).alias("false_per_true"))


@query("C11_frame_kinds", "SELECT coalesce(CASE WHEN json_valid(zframejson) THEN zframejson->>'$.kind' END, 'none') AS kind, count(*) AS n FROM zlabelbatch GROUP BY 1")
def _(v):
    return v.raw("zlabelbatch").groupBy(F.coalesce(text.frame_kind(F.col("zframejson")), F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


@query("C10_uuid_normal", f"SELECT z_pk, {sql_uuid('zbatchid')} AS batch FROM zannotation")
def _(v):
    return v.raw("zannotation").select("z_pk", normal_uuid(F.col("zbatchid")).alias("batch"))


@query("F23_queue", f"{A}, n AS (SELECT * FROM p ORDER BY created DESC NULLS LAST, zuri LIMIT 1000) SELECT zuri FROM n WHERE z_pk NOT IN (SELECT post FROM a WHERE stage = 'llm' AND model = 'local-s' AND post IS NOT NULL) ORDER BY created DESC NULLS LAST, zuri LIMIT 100")
def _(v):
    return latest.pending(v.notes, v.posts, "local-s")


@query("J18_not_done", f"{A} SELECT zuri FROM p WHERE z_pk NOT IN (SELECT post FROM a WHERE stage = 'llm' AND post IS NOT NULL)")
def _(v):
    done = v.notes.filter("stage = 'llm' AND post IS NOT NULL").select(F.col("post").alias("z_pk")).distinct()
    return incremental.remaining(v.posts.select("z_pk", "zuri"), done, "z_pk").select("zuri")


@query("I6_coverage", f"{A}, d AS (SELECT DISTINCT post FROM a WHERE stage = 'llm' AND post IS NOT NULL), k AS (SELECT max(created) AS mark FROM p JOIN d ON post = z_pk) SELECT CASE WHEN created > mark THEN 'forward' ELSE 'backlog' END AS part, count(*) AS n_posts FROM p, k WHERE created IS NOT NULL AND z_pk NOT IN (SELECT post FROM d) GROUP BY 1")
def _(v):
    return latest.coverage(v.notes, v.posts)


@query("A27_queue_counts", f"{A}, x AS (SELECT count(*) AS n_posts FROM p), y AS (SELECT count(DISTINCT post) AS n_judged FROM a WHERE stage = 'llm' AND model = 'local-m') SELECT n_posts, n_judged, greatest(0, n_posts - n_judged) AS n_pending FROM x, y")
def _(v):
    return latest.queue_counts(v.notes, v.posts, "local-m")


_NEW = f"nw AS (SELECT post, class FROM a WHERE stage = 'llm' AND post IS NOT NULL QUALIFY row_number() OVER (PARTITION BY post {_ORDER}) = 1)"


@query("A25_class_counts", f"{A}, {_NEW}, k AS (SELECT zaccount, count(*) AS n, count(*) FILTER (class = 'hate') AS n_hate, count(*) FILTER (class = 'counter') AS n_counter, count(*) FILTER (class = 'neutral') AS n_neutral FROM p LEFT JOIN nw ON post = z_pk WHERE zisrootpost = 1 AND zaccount IS NOT NULL GROUP BY 1) SELECT *, n - n_hate - n_counter - n_neutral AS n_pending, round(coalesce(n_hate / nullif(n_hate + n_counter + n_neutral, 0), 0), 6) AS hate_ratio FROM k")
def _(v):
    return rounded(latest.class_counts(v.notes, v.posts), "hate_ratio")


@query("A26_thread_counts", f"{A}, {_NEW} SELECT zrooturi, count(*) FILTER (class = 'hate') AS n_hate, count(*) FILTER (class = 'counter') AS n_counter, count(*) FILTER (class IS NULL) AS n_pending FROM p LEFT JOIN nw ON post = z_pk WHERE zrooturi IS NOT NULL GROUP BY 1")
def _(v):
    return latest.thread_counts(v.notes, v.posts)


@query("U8_lineages", f"{A} SELECT DISTINCT stage, model FROM a")
def _(v):
    return latest.lineages(v.notes)


@query("C19_subject_classes", "SELECT item_id, CASE WHEN list_has_any(labels, ['hate', 'threat']) THEN 'positive' WHEN list_has_any(labels, ['rude']) THEN 'hard_negative' END AS kind FROM evalset")
def _(v):
    return v.raw("evalset").select("item_id", latest.subject_class(F.col("labels"), ["hate", "threat"], ["rude"]).alias("kind"))


@query("A29_eval_summary", "SELECT speech_class, coalesce(lang, 'ALL') AS lang, count(*) AS n FROM evalset GROUP BY ROLLUP (speech_class, lang) HAVING speech_class IS NOT NULL")
def _(v):
    rows = v.raw("evalset").rollup("speech_class", "lang").agg(F.count("*").alias("n"), F.grouping("speech_class").alias("g"))
    return rows.filter("g = 0 AND speech_class IS NOT NULL").select("speech_class", F.coalesce("lang", F.lit("ALL")).alias("lang"), "n")


# metrics
_EV = f"{A}, hv AS (SELECT post, count(*) FILTER (class = 'hate') * 2 > count(*) AS y FROM a WHERE stage = 'human' AND post IS NOT NULL AND class IN ('hate', 'counter', 'neutral') GROUP BY 1), e AS (SELECT a.z_pk, CASE WHEN a.class = 'hate' THEN confidence ELSE 1 - confidence END AS score, hv.y, coalesce(a.model, 'none') AS model FROM a JOIN hv USING (post) WHERE a.stage IN ('llm', 'nltagger') AND a.confidence IS NOT NULL AND a.class IN ('hate', 'counter', 'neutral'))"


def _eval(v):
    votes = v.notes.filter("stage = 'human' AND post IS NOT NULL AND class IN ('hate', 'counter', 'neutral')").groupBy("post").agg((F.count_if(F.col("class") == "hate") * 2 > F.count("*")).alias("y"))
    judged = v.notes.filter("stage IN ('llm', 'nltagger') AND confidence IS NOT NULL AND class IN ('hate', 'counter', 'neutral')")
    score = F.when(F.col("class") == "hate", F.col("confidence")).otherwise(1 - F.col("confidence"))
    return judged.join(votes, "post").select("z_pk", score.alias("score"), "y", F.coalesce("model", F.lit("none")).alias("model"))


_AUC = "SELECT {by} sum(pos)::BIGINT AS n_pos, (sum(k) - sum(pos))::BIGINT AS n_neg, (sum((upto - (k - 1) / 2) * pos) - sum(pos) * (sum(pos) + 1) / 2) / nullif(sum(pos) * (sum(k) - sum(pos)), 0) AS auc FROM (SELECT *, sum(k) OVER ({part} ORDER BY score) AS upto FROM (SELECT {by} score, count(*) AS k, count(*) FILTER (y) AS pos FROM e GROUP BY ALL)) {group}"


@query("M19_roc_auc", f"{_EV}, u AS ({_AUC.format(by='', part='', group='')}) SELECT n_pos, n_neg, round(auc, 6) AS auc FROM u")
def _(v):
    return rounded(metrics.roc_auc(_eval(v), "score", "y"), "auc")


@query("M23_auc_by_group", f"{_EV}, u AS ({_AUC.format(by='model,', part='PARTITION BY model', group='GROUP BY model')}) SELECT model, n_pos, n_neg, CASE WHEN n_pos >= 20 AND n_neg >= 20 THEN round(auc, 6) END AS auc FROM u")
def _(v):
    return rounded(metrics.auc_by_language(_eval(v), "score", "y", "model"), "auc")


@query("O7_detector_order", f"{_EV}, u AS ({_AUC.format(by='model,', part='PARTITION BY model', group='GROUP BY model')}) SELECT model, n_pos, n_neg, round(auc, 6) AS auc FROM u ORDER BY auc DESC NULLS LAST, model")
def _(v):
    return rounded(metrics.roc_auc(_eval(v), "score", "y", ["model"]), "auc").orderBy(F.desc_nulls_last("auc"), "model")


_TH = f"{_EV}, th AS (SELECT score, pos, k, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(k) OVER (ORDER BY score DESC) AS flagged, sum(pos) OVER () AS p FROM (SELECT score, count(*) AS k, count(*) FILTER (y) AS pos FROM e GROUP BY 1))"


@query("M20_average_precision", f"{_TH} SELECT round(sum(pos * tp / flagged) / nullif(sum(pos), 0), 6) AS average_precision FROM th")
def _(v):
    return rounded(metrics.average_precision(_eval(v), "score", "y"), "average_precision")


@query("M21_best_f1", f"{_TH} SELECT round(2 * tp / (flagged + p), 6) AS f1, round(score, 6) AS threshold FROM th ORDER BY 2 * tp / (flagged + p) DESC, score LIMIT 1")
def _(v):
    return rounded(metrics.best_f1(_eval(v), "score", "y"), "f1", "threshold")


_AT = "count(*) FILTER (score >= 0.5 AND y) AS tp, count(*) FILTER (score >= 0.5 AND NOT y) AS fp, count(*) FILTER (score < 0.5 AND y) AS fn, count(*) FILTER (score < 0.5 AND NOT y) AS tn"


@query("M27_at_threshold", f"{_EV}, x AS (SELECT model, count(score) AS n, count(*) FILTER (score IS NULL) AS n_null, {_AT} FROM e GROUP BY 1) SELECT model, n, n_null, round(coalesce((tp + tn) / nullif(n, 0), 0), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM x")
def _(v):
    return rounded(metrics.at_threshold(_eval(v), "score", "y", ["model"]), "accuracy", "precision", "recall")


_CR = f"{A}, tr AS (SELECT post, class AS truth FROM a WHERE stage = 'human' AND post IS NOT NULL AND class IN ('hate', 'counter', 'neutral') QUALIFY row_number() OVER (PARTITION BY post {_ORDER}) = 1), gv AS (SELECT post, class AS given FROM a WHERE stage = 'llm' AND post IS NOT NULL AND class IN ('hate', 'counter', 'neutral') QUALIFY row_number() OVER (PARTITION BY post {_ORDER}) = 1), e AS (SELECT * FROM tr JOIN gv USING (post)), cl AS (SELECT DISTINCT class FROM (SELECT truth AS class FROM e UNION ALL SELECT given FROM e)), cr AS (SELECT class, count(*) FILTER (truth = class AND given = class) AS tp, count(*) FILTER (truth <> class AND given = class) AS fp, count(*) FILTER (truth = class AND given <> class) AS fn FROM cl, e GROUP BY 1)"


def _pairs(v):
    some = v.notes.filter("post IS NOT NULL AND class IN ('hate', 'counter', 'neutral')")
    truth = latest.last_by(some.filter("stage = 'human'"), ["post"], ["created", "z_pk"], ["class"]).withColumnRenamed("class", "truth")
    given = latest.last_by(some.filter("stage = 'llm'"), ["post"], ["created", "z_pk"], ["class"]).withColumnRenamed("class", "given")
    return truth.join(given, "post")


@query("A35_class_report", f"{_CR} SELECT class, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM cr")
def _(v):
    return rounded(metrics.class_report(_pairs(v), "truth", "given"), "precision", "recall", "f1")


@query("A35_macro", f"{_CR}, x AS (SELECT count(*) AS n, count(*) FILTER (truth = given) AS k FROM e), y AS (SELECT avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS m FROM cr) SELECT n, round(k / nullif(n, 0), 6) AS accuracy, round(m, 6) AS macro_f1 FROM x, y")
def _(v):
    pairs = _pairs(v)
    return rounded(metrics.macro(metrics.class_report(pairs, "truth", "given"), pairs, "truth", "given"), "accuracy", "macro_f1")


@query("M24_kappa", f"{_CR}, x AS (SELECT count(*) AS n, count(*) FILTER (truth = given) / count(*) AS po FROM e), pe AS (SELECT sum((tp + fn) * (tp + fp)) AS s FROM cr) SELECT n, round(po, 6) AS agreement, round(CASE WHEN s / (n * n) < 1 THEN (po - s / (n * n)) / (1 - s / (n * n)) WHEN po = 1 THEN 1.0 ELSE 0.0 END, 6) AS kappa FROM x, pe")
def _(v):
    return rounded(metrics.kappa(_pairs(v), "truth", "given"), "agreement", "kappa")


_SP = f"{A}, x AS (SELECT post, avg(CASE WHEN class = 'hate' THEN confidence ELSE 1 - confidence END) FILTER (stage = 'llm') AS u, avg(CASE WHEN class = 'hate' THEN confidence ELSE 1 - confidence END) FILTER (stage = 'nltagger') AS w FROM a WHERE post IS NOT NULL AND confidence IS NOT NULL AND class IN ('hate', 'counter', 'neutral') GROUP BY 1), y AS (SELECT post, round(u, 9) AS u, round(w, 9) AS w FROM x WHERE u IS NOT NULL AND w IS NOT NULL), z AS (SELECT *, rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1) / 2 AS ru, rank() OVER (ORDER BY w) + (count(*) OVER (PARTITION BY w) - 1) / 2 AS rw FROM y)"


@query("M26_spearman", f"{_SP} SELECT count(*) AS n, round(corr(ru, rw), 6) AS spearman, round(avg(CASE WHEN (u >= 0.5) = (w >= 0.5) THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM z")
def _(v):
    rows = v.notes.filter("post IS NOT NULL AND confidence IS NOT NULL AND class IN ('hate', 'counter', 'neutral')")
    score = F.when(F.col("class") == "hate", F.col("confidence")).otherwise(1 - F.col("confidence"))
    per = rows.groupBy("post").agg(F.round(F.avg(F.when(F.col("stage") == "llm", score)), 9).alias("u"), F.round(F.avg(F.when(F.col("stage") == "nltagger", score)), 9).alias("w"))
    return rounded(metrics.spearman(per, "u", "w", "post"), "spearman", "agreement")


@query("M28_fold_summary", f"{_EV}, f AS (SELECT model, avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) AS test, avg(score) AS train FROM e GROUP BY 1) SELECT round(avg(test), 6) AS mean, round(stddev_samp(test), 6) AS sd, round(avg(train - test), 6) AS overfit_gap FROM f")
def _(v):
    folds = _eval(v).groupBy("model").agg(F.avg(F.col("y").cast("double")).alias("test"), F.avg("score").alias("train"))
    return rounded(metrics.folds_summary(folds, "test", "train"), "mean", "sd", "overfit_gap")


@query("M31_signed_scores", f"{A} SELECT z_pk, round(CASE WHEN class = 'counter' THEN confidence WHEN class = 'hate' THEN -confidence ELSE 0.0 END, 6) AS signed FROM a WHERE stage = 'nltagger'")
def _(v):
    kind = F.when(F.col("class") == "counter", "positive").when(F.col("class") == "hate", "negative").otherwise("neutral")
    return v.notes.filter("stage = 'nltagger'").select("z_pk", F.round(stats.signed_score(kind, F.col("confidence")), 6).alias("signed"))


_COS = "list_cosine_similarity({a}.embedding::DOUBLE[], {b}.embedding::DOUBLE[])"


@query("M29_cosine_to_first", f"WITH f AS (SELECT * FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT e.vec_id, round({_COS.format(a='e', b='f')}, 6) AS cosine FROM embeddings e, f")
def _(v):
    e = v.raw("embeddings")
    first = e.orderBy("vec_id").limit(1).select(F.lit(0).alias("_k"), F.col("embedding").alias("other"))
    return e.withColumn("_k", F.lit(0)).join(F.broadcast(first), "_k").select("vec_id", F.round(stats.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("M30_most_similar", f"SELECT query, match, round(c, 6) AS cosine FROM (SELECT q.vec_id AS query, e.vec_id AS match, {_COS.format(a='q', b='e')} AS c FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0) QUALIFY row_number() OVER (PARTITION BY query ORDER BY c DESC, match) <= 10")
def _(v):
    e = v.raw("embeddings").select("vec_id", "embedding")
    return rounded(metrics.nearest(e, "vec_id", "embedding", e.filter("vec_id % 100 = 0"), 10), "cosine")


# samples
@query("U3_undrawn", f"{A} SELECT zuri FROM p WHERE zisrootpost = 0 AND zuri NOT IN (SELECT p.zuri FROM a JOIN p ON a.post = p.z_pk WHERE stage = 'human')")
def _(v):
    done = v.notes.filter("stage = 'human' AND post IS NOT NULL").select(F.col("post").alias("z_pk")).join(v.posts.select("z_pk", "zuri"), "z_pk")
    batches = done.groupBy(F.pmod("z_pk", F.lit(64))).agg(F.collect_set("zuri").alias("drawn"))
    return sampling.undrawn(model.replies(v.posts).select("zuri"), batches)


@query("P1_hash_draw")
def _(v):
    return sampling.drawn(model.replies(v.posts), "zuri", 200, 7)


@query("P1_exact_draw")
def _(v):
    r = model.replies(v.posts)
    return sampling.drawn_exactly(r, "zuri", r.filter("zlikecount = 0").select("zuri"), 200, 7)


@query("P4_control_sample")
def _(v):
    labelled = v.notes.filter("post IS NOT NULL").select(F.col("post").alias("z_pk")).join(v.posts.select("z_pk", "zuri"), "z_pk").select("zuri").distinct()
    return sampling.control_sample(model.replies(v.posts), "zuri", labelled, 2.0, 150, 7)


@query("P2_stratified_draw")
def _(v):
    rows = model.replies(v.posts).filter(ranged(F.col("created"))).select("zuri", iso_week(to_timestamp(F.col("created"))).alias("week"))
    return sampling.stratified(rows, "week", "zuri", 500, 7)


@query("P7_folds")
def _(v):
    return sampling.folds(_eval(v).select("z_pk", "y"), "y", "z_pk", 5, 7)


# threads
@query("T1_children", f"{W} SELECT zparenturi AS zuri, zuri AS child, row_number() OVER (PARTITION BY zparenturi ORDER BY coalesce(created, '-infinity'::DOUBLE), zuri) AS place FROM p WHERE zparenturi IS NOT NULL")
def _(v):
    return threads.children(v.posts)


_BIG = "(SELECT zrooturi FROM p WHERE zrooturi IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query("T6_thread", f"{W} SELECT zuri, zparenturi, created, zdepth FROM p WHERE zrooturi = {_BIG} ORDER BY created NULLS FIRST, zuri")
def _(v):
    top = v.posts.filter("zrooturi IS NOT NULL").groupBy("zrooturi").count().orderBy(F.desc("count"), "zrooturi").first()
    root = top[0] if top else ""
    return threads.thread(model.posts_where(v.raw("zpost"), F.col("zrooturi") == root), root)


@query("T4_heights", f"{W} SELECT zrooturi, coalesce(max(zdepth), 0) + 1 AS height, count(*) AS n_posts FROM p WHERE zrooturi IS NOT NULL GROUP BY 1")
def _(v):
    return threads.heights(v.posts)


_TREE = """WITH RECURSIVE {posts}, e AS (SELECT x.zuri, y.zuri AS parent, printf('%020.3f', coalesce(x.created, 0) + 1e12) || '|' || x.zuri AS own FROM p x LEFT JOIN p y ON x.zparenturi = y.zuri),
w AS (SELECT zuri, zuri AS root, CAST(0 AS BIGINT) AS depth, own AS line FROM e WHERE parent IS NULL UNION ALL SELECT e.zuri, w.root, w.depth + 1, w.line || chr(1) || e.own FROM e JOIN w ON e.parent = w.zuri),
f AS (SELECT zuri AS node, root, depth, row_number() OVER (PARTITION BY root ORDER BY line) AS position, line FROM w)""".replace("{posts}", POSTS)


@query("T2_flat_order", f"{_TREE} SELECT node, root, depth, position FROM f")
def _(v):
    return threads.flat_order(v.posts, "zuri", "zparenturi", "created")


@query("T5_layout", f"""{_TREE}, lf AS (SELECT f.*, sum(CASE WHEN node IN (SELECT parent FROM e WHERE parent IS NOT NULL) THEN 0 ELSE 1 END) OVER (PARTITION BY root ORDER BY position) AS leaf, node IN (SELECT parent FROM e WHERE parent IS NOT NULL) AS inner_ FROM f)
SELECT n.node, n.root, round((min(l.leaf) + max(l.leaf)) / 2 * 28 - 14, 6) AS x, CAST(n.depth * 48 + 33 AS DOUBLE) AS y FROM lf n JOIN lf l ON l.root = n.root AND NOT l.inner_ AND starts_with(l.line, n.line) GROUP BY n.node, n.root, n.depth""")
def _(v):
    edges = v.posts.join(v.posts.select(F.col("zuri").alias("zparenturi")), "zparenturi", "left_semi").select("zuri", "zparenturi").unionByName(v.posts.join(v.posts.select(F.col("zuri").alias("zparenturi")), "zparenturi", "left_anti").select("zuri", F.lit(None).cast("string").alias("zparenturi")))
    return rounded(threads.layout(threads.flat_order(v.posts, "zuri", "zparenturi", "created"), edges, "zuri", "zparenturi"), "x")


# channels
@query("A30_day_coverage", f"WITH {MESSAGES} SELECT channel, substr(sent_at, 1, 10) AS day, count(*) AS n_messages, min(msg_id) AS first_id, max(msg_id) AS last_id, max(msg_id) - min(msg_id) + 1 - count(*) AS n_missing FROM m WHERE sent_at IS NOT NULL GROUP BY 1, 2")
def _(v):
    return channels.day_coverage(v.messages)


@query("W9_gap_ranges", f"WITH {MESSAGES}, x AS (SELECT channel, substr(sent_at, 1, 10) AS day, msg_id, lag(msg_id) OVER (PARTITION BY channel, substr(sent_at, 1, 10) ORDER BY msg_id) AS b FROM m WHERE sent_at IS NOT NULL) SELECT channel, day, b + 1 AS first_missing, msg_id - 1 AS last_missing FROM x WHERE msg_id - b > 1")
def _(v):
    return channels.gap_ranges(v.messages)


@query("W8_contiguous_top", f"WITH {MESSAGES}, x AS (SELECT channel, msg_id, msg_id - row_number() OVER (PARTITION BY channel ORDER BY msg_id) AS b FROM m), y AS (SELECT channel, b, min(msg_id) AS low, max(msg_id) AS top FROM x GROUP BY 1, 2) SELECT channel, arg_min(top, low) AS contiguous_top FROM y GROUP BY 1")
def _(v):
    return channels.contiguous_top(v.messages)


_FW = f"WITH {MESSAGES}, fw AS (SELECT fwd_from_channel, count(*) AS n_forwards, count(DISTINCT channel) AS n_channels FROM m WHERE fwd_from_channel <> '' AND fwd_from_channel NOT IN (SELECT username FROM channels) GROUP BY 1)"


@query("A31_forward_evidence", f"{_FW} SELECT * FROM fw")
def _(v):
    return channels.forward_evidence(v.messages, v.raw("channels"))


@query("A32_candidates", f"{_FW} SELECT * FROM fw WHERE n_channels >= 3 OR n_forwards >= 20 ORDER BY n_forwards DESC")
def _(v):
    return channels.candidates(channels.forward_evidence(v.messages, v.raw("channels"))).orderBy(F.desc("n_forwards"), "fwd_from_channel")


@query("A36_forwarded_share", f"WITH {MESSAGES} SELECT channel, count(*) AS n_messages, round(avg(CASE WHEN coalesce(fwd_from_channel, '') <> '' THEN 1.0 ELSE 0.0 END), 6) AS forwarded_share FROM m GROUP BY 1")
def _(v):
    return rounded(channels.forwarded_share(v.messages), "forwarded_share")


@query("C18_messages_per_day", f"WITH {MESSAGES} SELECT substr(sent_at, 1, 10) AS day, count(*) AS n FROM m GROUP BY 1")
def _(v):
    return v.messages.groupBy(channels.day(F.col("sent_at")).alias("day")).agg(F.count("*").alias("n"))


@query("I11_messages_stored", "SELECT DISTINCT channel, msg_id FROM messages WHERE channel IS NOT NULL AND msg_id IS NOT NULL")
def _(v):
    return v.messages.select("channel", "msg_id")


@query("W13_freshness", f"WITH {MESSAGES}, x AS (SELECT channel, max(epoch(CAST(sent_at AS TIMESTAMPTZ))) AS last FROM m GROUP BY 1) SELECT channel, CAST(epoch(TIMESTAMP '2025-01-01') - last AS BIGINT) AS age_s, epoch(TIMESTAMP '2025-01-01') - last > 129600 AS stale FROM x")
def _(v):
    return channels.freshness(v.messages, "2025-01-01 00:00:00")


@query("W12_trailing_streak", f"WITH {MESSAGES}, x AS (SELECT channel, sum(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE 1 END) OVER (PARTITION BY channel ORDER BY msg_id DESC) AS c FROM m) SELECT channel, count(*) FILTER (c = 0) AS streak, count(*) FILTER (c = 0) >= 3 AS alarm FROM x GROUP BY 1")
def _(v):
    return channels.trailing_streak(v.messages.withColumn("skipped", F.coalesce("text", F.lit("")) == ""), "msg_id", "skipped", "channel")


# deletions: the store as ingested by mid-2024 against the whole one; what was delivered last is missing from 'live'
_SPLIT = "'2024-06-01'"
_DEL = f"{W}, live AS (SELECT * FROM p WHERE zlikecount IS NOT NULL AND zlikecount % 7 <> 0), wk AS (SELECT zuri AS wuri, lower(trim(zreplytreestatus)) = 'complete' AS complete, zaccount AS outlet FROM live WHERE zisrootpost = 1 AND lower(trim(zreplytreestatus)) IN ('complete', 'inprogress')), dl AS (SELECT r.*, complete, outlet FROM r JOIN wk ON wuri = r.zrooturi WHERE r.zuri NOT IN (SELECT zuri FROM live))"


def _deleted(v):
    live = v.posts.filter(F.col("zlikecount").isNotNull() & (F.col("zlikecount") % 7 != 0))
    return deletions.deleted(v.posts, live)


@query("R7_deleted_replies", f"{_DEL} SELECT zuri, complete, outlet FROM dl")
def _(v):
    return _deleted(v).select("zuri", "complete", "outlet")


_DAY = "strftime(CASE WHEN " + in_range("created") + " THEN " + at("created") + " END, '%Y-%m-%d')"


@query("A22_deletion_summary", f"{_DEL} SELECT coalesce(CAST(outlet AS VARCHAR), 'unknown') AS outlet, coalesce(zdepth, 0) AS depth, count(*) AS n, count(*) FILTER (coalesce(length(trim(ztext)), 0) = 0) AS n_empty, count(*) FILTER (complete) AS n_complete, min({_DAY}) AS first_day, max({_DAY}) AS last_day FROM dl GROUP BY 1, 2")
def _(v):
    return deletions.deletion_summary(_deleted(v))


# incremental
@query("I2_unique_posts", f"{W} SELECT zuri, z_pk FROM p")
def _(v):
    return v.posts.select("zuri", "z_pk")


@query("I3_merged_engagement", f"{W}, n AS (SELECT zuri, zlikecount AS lk FROM zpost WHERE zuri IS NOT NULL QUALIFY row_number() OVER (PARTITION BY zuri ORDER BY z_pk DESC) = 1) SELECT p.zuri, coalesce(lk, zlikecount) AS zlikecount, ztext FROM p JOIN n ON n.zuri = p.zuri")
def _(v):
    newest = latest.last_by(v.raw("zpost").filter("zuri IS NOT NULL"), ["zuri"], ["z_pk"], ["zlikecount"])
    return incremental.merged_engagement(v.posts.select("zuri", "zlikecount", "ztext"), newest, "zuri", ["zlikecount"])


@query("I12_upserted_snapshots", "SELECT zuri, max(exported_at)::VARCHAR AS exported_at FROM zpost_snapshot WHERE zuri IS NOT NULL GROUP BY 1")
def _(v):
    rows = v.raw("zpost_snapshot").filter("zuri IS NOT NULL").select("zuri", "exported_at")
    return incremental.upserted(rows.limit(0), rows, ["zuri"], "exported_at").select("zuri", F.regexp_replace(F.col("exported_at").cast("string"), r"^(.*)$", "$1").alias("exported_at"))


@query("I14_material_changes", "WITH x AS (SELECT zuri, snapshot_date, exported_at, zreplytreestatus AS s, lag(zreplytreestatus) OVER w AS b, row_number() OVER w AS i FROM zpost_snapshot WHERE zuri IS NOT NULL WINDOW w AS (PARTITION BY zuri ORDER BY snapshot_date, exported_at, zreplytreestatus NULLS FIRST)) SELECT zuri, CAST(snapshot_date AS VARCHAR) AS snapshot_date, s AS zreplytreestatus FROM x WHERE i = 1 OR s IS DISTINCT FROM b")
def _(v):
    rows = v.raw("zpost_snapshot").filter("zuri IS NOT NULL").select("zuri", "snapshot_date", "exported_at", "zreplytreestatus")
    found = latest.material_changes(rows, "zuri", ["snapshot_date", "exported_at", "zreplytreestatus"], ["zreplytreestatus"])
    return found.select("zuri", F.col("snapshot_date").cast("string").alias("snapshot_date"), "zreplytreestatus")


@query("I15_earlier_starts", f"{W}, n AS (SELECT zaccount, min(created) AS s FROM p WHERE zaccount IS NOT NULL AND {in_range('created')} GROUP BY 1) SELECT z_pk, least(zstartat, s) AS start FROM ztrackedaccount LEFT JOIN n ON zaccount = z_pk")
def _(v):
    wanted = v.posts.filter(F.col("zaccount").isNotNull() & ranged(F.col("created"))).groupBy(F.col("zaccount").alias("z_pk")).agg(F.min("created").alias("start"))
    return incremental.earlier_starts(v.raw("ztrackedaccount"), wanted)


# text
@query("C5_token_counts", "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(regexp_replace(ztext, 'https?://\\S+', ' urlplaceholdertoken ', 'g')), '[#@]?[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+')) AS t, CASE WHEN t = 'urlplaceholdertoken' THEN '<url>' ELSE t END AS token FROM zpost WHERE ztext IS NOT NULL) GROUP BY 1")
def _(v):
    return v.raw("zpost").select(F.explode(text.tokens(F.col("ztext"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("C6_lexicon_counts", f"SELECT z_pk, len(regexp_extract_all(lower(ztext), '({'|'.join(text.LEXICON)})')) AS n_terms FROM zpost WHERE ztext IS NOT NULL")
def _(v):
    return v.raw("zpost").filter("ztext IS NOT NULL").select("z_pk", text.term_count(F.col("ztext"), text.LEXICON).cast("long").alias("n_terms"))


@query("C9_web_links", f"{W} SELECT zuri, 'https://example.org/profile/' || split_part(zuri, '/', 3) || '/post/' || split_part(zuri, '/', 5) AS link FROM p WHERE zuri LIKE 'at://%/%.post/%'")
def _(v):
    return v.posts.filter("zuri LIKE 'at://%/%.post/%'").select("zuri", text.web_link(F.col("zuri")).alias("link"))


@query("C17_previews", f"{W} SELECT zuri, substr(ztext, 1, 60) AS preview FROM p WHERE zisrootpost = 1")
def _(v):
    return model.roots(v.posts).select("zuri", text.preview(F.col("ztext")).alias("preview"))


@query("C14_prompt_hashes", "SELECT item_id, sha256(replace(replace('Sprache {{language}}: {{text}}', '{{text}}', coalesce(text, '')), '{{language}}', coalesce(lang, ''))) AS prompt_hash FROM evalset")
def _(v):
    return v.raw("evalset").select("item_id", F.sha2(text.filled_prompt("Sprache {{language}}: {{text}}", F.col("text"), F.col("lang")), 256).alias("prompt_hash"))


@query("C2_iso_times", f"{W} SELECT zuri, strftime({at('created')}, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM p WHERE {in_range('created')}")
def _(v):
    return v.posts.filter(ranged(F.col("created"))).select("zuri", F.date_format(F.date_trunc("second", to_timestamp(F.col("created"))), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("M13_iso_weeks", f"{W} SELECT strftime({at('created')}, '%G-W%V') AS iso_week, CAST(date_trunc('week', {at('created')}) AS DATE) AS monday, count(*) AS n FROM p WHERE {in_range('created')} GROUP BY ALL")
def _(v):
    ts = to_timestamp(F.col("created"))
    return v.posts.filter(ranged(F.col("created"))).groupBy(iso_week(ts).alias("iso_week"), week_start(ts).alias("monday")).agg(F.count("*").alias("n"))


@query("M11_depth_buckets", f"{W} SELECT {_B} AS bucket, count(*) AS n FROM r GROUP BY 1")
def _(v):
    return model.replies(v.posts).groupBy(stats.depth_bucket(F.coalesce("zdepth", F.lit(0))).alias("bucket")).agg(F.count("*").alias("n"))

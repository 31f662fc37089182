"""Queries of whole reports, and of numbers that have no other query."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import stats, text
from corpusloom.functions.time import in_range as ranged
from corpusloom.functions.time import iso_week, to_timestamp
from corpusloom.functions.uri import normal_uuid
from corpusloom.operators import authors, compositions, incremental, integrity, latest, model, roots, sampling, structure, threads
from corpusloom.operators.ranks import with_rank
from corpusloom.plans.analysis import _ACT, _NEW, _ORDER, _OUT, _SR, _TREE, _WHI, _WLO
from corpusloom.plans.problems import sql_uuid
from corpusloom.plans.views import LABELS, MESSAGES, NOTES, POSTS, SCORES, Views, at, in_range
from corpusloom.session import shared_dir
from corpusloom.sources import documents, jsonl

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

# The newest score of each post by model and by tagger, against the labels that count
_STAGES = "pr AS (SELECT p.zuri AS uri, stage AS model, CASE WHEN class = 'hate' THEN confidence ELSE 1 - confidence END AS score FROM a JOIN p ON a.post = p.z_pk WHERE stage IN ('llm', 'nltagger') AND class IN ('hate', 'counter', 'neutral') AND confidence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY zuri, stage ORDER BY a.z_pk DESC) = 1)"
_ELIGIBLE = f"{_OUT}, {_STAGES}, lb AS (SELECT p.zuri AS uri, o.class = 'hate' AS hate FROM o JOIN p ON o.post = p.z_pk WHERE reason = 'counted' QUALIFY row_number() OVER (PARTITION BY p.zuri ORDER BY o.z_pk DESC) = 1)"


def _predictions(v):
    some = v.notes.filter(F.col("stage").isin("llm", "nltagger") & F.col("class").isin(model.CLASSES) & F.col("confidence").isNotNull())
    score = F.when(F.col("class") == "hate", F.col("confidence")).otherwise(1 - F.col("confidence"))
    met = some.join(v.posts.select(F.col("z_pk").alias("post"), F.col("zuri").alias("uri")), "post")
    return met.groupBy("uri", F.col("stage").alias("model")).agg(F.max_by(score, "z_pk").alias("score"))


def _eligible(v):
    counted = latest.batch_outcomes(v.notes, v.batches).filter("reason = 'counted'")
    met = counted.join(v.posts.select(F.col("z_pk").alias("post"), F.col("zuri").alias("uri")), "post")
    return met.groupBy("uri").agg((F.max_by("class", "z_pk") == "hate").alias("hate"))


@query("R6_comparison", f"""{_ELIGIBLE}, b0 AS (SELECT count(*) AS n_labels, count(*) FILTER (hate) AS n_hate FROM lb), md AS (SELECT unnest(['llm', 'nltagger']) AS model),
x AS (SELECT md.model, lb.uri, hate, score FROM lb CROSS JOIN md LEFT JOIN pr ON pr.uri = lb.uri AND pr.model = md.model),
rk AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2 AS r FROM x WHERE score IS NOT NULL),
au AS (SELECT model, (sum(r) FILTER (hate) - count(*) FILTER (hate) * (count(*) FILTER (hate) + 1) / 2) / nullif(count(*) FILTER (hate) * count(*) FILTER (NOT hate), 0) AS auc FROM rk GROUP BY 1),
q AS (SELECT model, count(score) AS n_compared, count(*) FILTER (score IS NULL) AS n_null, count(*) FILTER (score >= 0.5 AND hate) AS tp, count(*) FILTER (score >= 0.5 AND NOT hate) AS fp, count(*) FILTER (score < 0.5 AND hate) AS fn, count(*) FILTER (score < 0.5 AND NOT hate) AS tn FROM x GROUP BY 1),
pa AS (SELECT l.score AS u, t.score AS w FROM pr l JOIN pr t ON l.uri = t.uri AND l.model = 'llm' AND t.model = 'nltagger'), pz AS (SELECT *, rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1) / 2 AS ru, rank() OVER (ORDER BY w) + (count(*) OVER (PARTITION BY w) - 1) / 2 AS rw FROM pa),
sp AS (SELECT count(*) AS n_both, corr(ru, rw) AS spearman, avg(CASE WHEN (u >= 0.5) = (w >= 0.5) THEN 1.0 ELSE 0.0 END) AS agreement FROM pz)
SELECT q.model, n_compared, n_null, round(coalesce((tp + tn) / nullif(n_compared, 0), 0), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(auc, 6) AS auc,
n_labels, n_hate, round(n_hate / n_labels, 6) AS prevalence, round({_WLO.format(k='n_hate', n='n_labels')}, 6) AS low, round({_WHI.format(k='n_hate', n='n_labels')}, 6) AS high, n_both, round(spearman, 6) AS spearman, round(agreement, 6) AS agreement
FROM q LEFT JOIN au ON au.model = q.model, b0, sp""")
def _(v):
    found = compositions.comparison(_predictions(v), _eligible(v), "llm", "nltagger", 1)
    return rounded(found, "accuracy", "precision", "recall", "auc", "prevalence", "low", "high", "spearman", "agreement")


_KIND = f"{A}, {LABELS}, {_ACT}, lk AS (SELECT uri, list(DISTINCT val) AS labels FROM la GROUP BY 1), ek AS (SELECT uri, CASE WHEN list_contains(labels, 'hate') THEN 'positive' WHEN list_contains(labels, 'counter') THEN 'hard_negative' END AS class FROM lk), es AS (SELECT ek.* FROM ek JOIN p ON p.zuri = ek.uri WHERE class IS NOT NULL AND length(trim(ztext, ' ')) > 0)"


def _label_sets(v):
    return latest.latest_then_active(v.labels).groupBy("uri").agg(F.array_sort(F.collect_set("val")).alias("labels"))


@query("R8_evaluation_set", f"""{_KIND}, po AS (SELECT count(*) AS n FROM r WHERE length(trim(ztext, ' ')) > 0 AND zuri NOT IN (SELECT uri FROM lk)), np AS (SELECT count(*) AS n FROM es WHERE class = 'positive')
SELECT class, count(*) AS n, count(DISTINCT uri) AS n_posts, 0::BIGINT AS n_labelled_easy FROM es GROUP BY 1 UNION ALL SELECT 'easy_negative', least(round_even(1.5 * np.n, 0)::BIGINT, po.n), least(round_even(1.5 * np.n, 0)::BIGINT, po.n), 0 FROM po, np""")
def _(v):
    drawn = compositions.evaluation_set(_label_sets(v), v.posts, ["hate"], ["counter"], 1.5, 7)
    return drawn.groupBy("class").agg(F.count("*").alias("n"), F.countDistinct("zuri").alias("n_posts"), F.count_if((F.col("class") == "easy_negative") & (F.size("labels") > 0)).alias("n_labelled_easy"))


_DT = f"""{_KIND}, dk AS (SELECT uri, coalesce(CASE WHEN list_contains(labels, 'hate') THEN 'positive' WHEN list_contains(labels, 'counter') THEN 'hard_negative' END, 'easy_negative') AS class FROM lk), {_STAGES}, dr AS (SELECT pr.model AS detector, class, score FROM pr JOIN dk USING (uri))"""


def _side(name: str) -> str:
    return f"""{name}0 AS (SELECT detector, score, class = 'positive' AS y FROM dr WHERE class IN ('positive', '{name}_negative')),
{name}1 AS (SELECT detector, score, count(*) AS k, count(*) FILTER (y) AS pos FROM {name}0 GROUP BY 1, 2), {name}2 AS (SELECT *, sum(pos) OVER (PARTITION BY detector ORDER BY score DESC) AS tp, sum(k) OVER (PARTITION BY detector ORDER BY score DESC) AS flagged, sum(k) OVER (PARTITION BY detector ORDER BY score) AS upto, sum(pos) OVER (PARTITION BY detector) AS p FROM {name}1),
{name}3 AS (SELECT detector, sum(pos)::BIGINT AS n_positive, (sum(k) - sum(pos))::BIGINT AS n_{name}, (sum((upto - (k - 1) / 2) * pos) - sum(pos) * (sum(pos) + 1) / 2) / nullif(sum(pos) * (sum(k) - sum(pos)), 0) AS auc_{name}, sum(pos * tp / flagged) / nullif(sum(pos), 0) AS pr_auc_{name}, max(2 * tp / (flagged + p)) AS best_f1_{name} FROM {name}2 GROUP BY 1)"""


@query("R9_detectors", f"""{_DT}, {_side('hard')}, {_side('easy')}
SELECT hard3.detector, hard3.n_positive, n_hard, n_easy, {', '.join(f'round({c}_{s}, 6) AS {c}_{s}' for s in ('hard', 'easy') for c in ('auc', 'pr_auc', 'best_f1'))} FROM hard3 JOIN easy3 USING (detector) ORDER BY auc_hard DESC NULLS LAST, detector""")
def _(v):
    kinds = _label_sets(v).select("uri", F.coalesce(latest.subject_class(F.col("labels"), ["hate"], ["counter"]), F.lit("easy_negative")).alias("class"))
    rows = _predictions(v).withColumnRenamed("model", "detector").join(kinds, "uri")
    return rounded(compositions.detector_report(rows), *[f"{c}_{s}" for s in ("hard", "easy") for c in ("auc", "pr_auc", "best_f1")])


_GOLD = f"{A}, gd AS (SELECT post, class AS truth FROM a WHERE stage = 'human' AND post IS NOT NULL AND class IN ('hate', 'counter', 'neutral') QUALIFY row_number() OVER (PARTITION BY post {_ORDER}) = 1), pm AS (SELECT post, model, class FROM a WHERE stage = 'llm' AND post IS NOT NULL AND confidence > 0 QUALIFY row_number() OVER (PARTITION BY post, model {_ORDER}) = 1)"


def _gold(v):
    return latest.last_by(v.notes.filter(F.col("class").isin(model.CLASSES) & (F.col("stage") == "human") & F.col("post").isNotNull()), ["post"], ["created", "z_pk"], ["class"]).withColumnRenamed("class", "truth")


_F1 = {c: f"coalesce(2 * count(*) FILTER (class = '{c}' AND truth = '{c}') / nullif(count(*) FILTER (class = '{c}') + count(*) FILTER (truth = '{c}'), 0), 0)" for c in model.CLASSES}


@query("R10_benchmark", f"{_GOLD} SELECT model, count(*) AS n, round(count(*) FILTER (class = truth) / count(*), 6) AS accuracy, {', '.join(f'round({x}, 6) AS f1_{c}' for c, x in _F1.items())}, round(({' + '.join(_F1.values())}) / 3, 6) AS macro_f1 FROM pm JOIN gd USING (post) GROUP BY 1")
def _(v):
    return rounded(compositions.benchmark(_gold(v), latest.latest_predictions(v.notes)), "accuracy", "macro_f1", *[f"f1_{c}" for c in model.CLASSES])


_TAGS = "tg AS (SELECT post, max(tag) AS tag FROM (SELECT DISTINCT post, 'core' AS tag FROM a WHERE stage = 'llm' AND post IS NOT NULL UNION ALL SELECT DISTINCT post, 'hard' FROM a WHERE stage = 'human' AND class = 'hate' AND post IS NOT NULL) GROUP BY 1)"


@query("O8_hard_cases", f"""{_GOLD}, {_TAGS}, wr AS (SELECT post, count(*) AS n, count(*) FILTER (class = truth) AS n_right FROM pm JOIN gd USING (post) GROUP BY 1)
SELECT post, tag, truth, coalesce(n, 0) AS n_models, coalesce(n_right, 0) AS n_right FROM tg JOIN gd USING (post) LEFT JOIN wr USING (post) WHERE n IS NULL OR n_right < n ORDER BY tag <> 'hard', post""")
def _(v):
    some = v.notes.filter("post IS NOT NULL")
    tags = latest.preferred(some.filter("stage = 'llm'").select("post"), some.filter("stage = 'human' AND class = 'hate'").select("post"), "post")
    return compositions.disagreements(_gold(v), latest.latest_predictions(v.notes), tags)


_MODELS, _TERMS = ["local-m", "local-s", "tagger-a"], ["ferry subsidy", "Hafentunnel", "river dredging", "Rundfunkbeitrag"]


@query("R11_benchmark_set", f"""{A}, pm AS (SELECT DISTINCT post, model FROM a WHERE stage IN ('llm', 'nltagger') AND post IS NOT NULL AND confidence > 0 AND model IN ({', '.join(f"'{m}'" for m in _MODELS)})), cr AS (SELECT zuri FROM p WHERE z_pk IN (SELECT post FROM pm GROUP BY 1 HAVING count(DISTINCT model) = 3)),
hd AS ({' UNION ALL '.join(f"SELECT min(zuri) AS zuri FROM p WHERE contains(lower(ztext), '{t.lower()}')" for t in _TERMS)}), tg AS (SELECT zuri, max(tag) AS tag FROM (SELECT zuri, 'core' AS tag FROM cr UNION ALL SELECT zuri, 'hard' FROM hd WHERE zuri IS NOT NULL) GROUP BY 1),
ex AS (SELECT uri, max(speech_class) AS user_label FROM evalset WHERE uri IS NOT NULL GROUP BY 1) SELECT tg.zuri, coalesce(ztext, '') AS text, tag, user_label FROM tg JOIN p ON p.zuri = tg.zuri LEFT JOIN ex ON ex.uri = tg.zuri""")
def _(v):
    judged = v.notes.filter("stage IN ('llm', 'nltagger') AND post IS NOT NULL AND confidence > 0").select("post", "model").distinct()
    terms = v.spark.createDataFrame([(t, i) for i, t in enumerate(_TERMS)], "term string, rank int")
    existing = v.raw("evalset").filter("uri IS NOT NULL").groupBy(F.col("uri").alias("zuri")).agg(F.max("speech_class").alias("user_label"))
    return compositions.benchmark_set(judged, v.posts, _MODELS, terms, existing, ["user_label"])


@query("J17_judged_by_three", f"{A} SELECT post, count(DISTINCT model) AS n_models FROM a WHERE stage IN ('llm', 'nltagger') AND post IS NOT NULL AND confidence > 0 GROUP BY 1 HAVING count(DISTINCT model) >= 3")
def _(v):
    return latest.shared_by_models(v.notes.filter("stage IN ('llm', 'nltagger') AND post IS NOT NULL AND confidence > 0"), 3)


@query("F21_hate_in_threads", f"{_TREE.replace('f AS (SELECT', f'{NOTES}, {_NEW}, f AS (SELECT', 1)} SELECT node, f.root, depth, position FROM f JOIN p ON p.zuri = node JOIN nw ON nw.post = p.z_pk WHERE nw.class = 'hate'")
def _(v):
    newest = latest.last_by(v.notes.filter("stage = 'llm' AND post IS NOT NULL"), ["post"], ["created", "z_pk"], ["class"])
    classes = newest.join(v.posts.select(F.col("z_pk").alias("post"), F.col("zuri").alias("node")), "post").select("node", "class")
    return threads.of_class(threads.flat_order(v.posts, "zuri", "zparenturi", "created"), classes, "hate")


_FR = "CASE WHEN json_valid(zframejson) THEN zframejson END"
_DAY = lambda k: f"strftime(make_timestamp(CAST(floor((CAST(({_FR})->>'$.{k}' AS DOUBLE) + 978307200) * 1000000) AS BIGINT)), '%Y-%m-%d')"


@query("C22_frame_texts", f"""WITH f AS (SELECT z_pk, ({_FR})->>'$.kind' AS kind, ({_FR})->>'$.outletPK' AS o, {_DAY('dateFrom')} AS a, {_DAY('dateTo')} AS b, ({_FR})->>'$.minThreadReplies' AS lo, ({_FR})->>'$.maxThreadReplies' AS hi FROM zlabelbatch),
g AS (SELECT z_pk, kind, concat_ws(', ', 'outlet #' || o, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a || '–' || b WHEN a IS NOT NULL THEN 'from ' || a WHEN b IS NOT NULL THEN 'until ' || b END, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo || '–' || hi || ' replies/thread' WHEN lo IS NOT NULL THEN '≥' || lo || ' replies/thread' WHEN hi IS NOT NULL THEN '≤' || hi || ' replies/thread' END) AS t FROM f)
SELECT z_pk, CASE WHEN kind = 'uniformRandom' THEN 'uniform random' WHEN kind = 'filtered' THEN CASE WHEN t <> '' THEN 'filtered: ' || t ELSE 'filtered (no filters set)' END ELSE 'unknown frame (failed to decode)' END AS summary FROM g""")
def _(v):
    return v.raw("zlabelbatch").select("z_pk", text.frame_summary(F.col("zframejson")).alias("summary"))


@query("M32_time_left", f"{A}, k AS (SELECT batch, count(DISTINCT post) AS done, max(created) - min(created) AS took FROM a WHERE stage = 'human' AND batch IS NOT NULL AND post IS NOT NULL GROUP BY 1), b AS (SELECT {sql_uuid('zid')} AS batch, max(zpoolsizeatdraw) AS total FROM zlabelbatch GROUP BY 1) SELECT batch, done, total, round(CASE WHEN done > 0 AND done < total THEN took / done * (total - done) END, 3) AS seconds_left FROM k JOIN b USING (batch)")
def _(v):
    done = v.notes.filter("stage = 'human' AND batch IS NOT NULL AND post IS NOT NULL").groupBy("batch").agg(F.countDistinct("post").alias("done"), (F.max("created") - F.min("created")).alias("took"))
    total = v.raw("zlabelbatch").select(normal_uuid(F.col("zid")).alias("batch"), "zpoolsizeatdraw").filter("batch IS NOT NULL").groupBy("batch").agg(F.max("zpoolsizeatdraw").alias("total"))
    return done.join(total, "batch").select("batch", "done", "total", F.round(stats.time_left(F.col("took"), F.col("done"), F.col("total")), 3).alias("seconds_left"))


# samples: what SQL can tell of a draw by hash or by another language's generator
_STRATA = f"{W}, k AS (SELECT strftime({at('created')}, '%G-W%V') AS week, count(*) AS c FROM r WHERE {in_range('created')} GROUP BY 1), e AS (SELECT week, c, 1 + least(c - 1, floor((500 - m) * c / t)) AS given, (500 - m) * c / t - floor((500 - m) * c / t) AS f, m, t FROM (SELECT *, count(*) OVER () AS m, sum(c) OVER () AS t FROM k))"


@query("P2_stratum_counts", f"""{_STRATA}, x AS (SELECT *, 500 - sum(given) OVER () AS rest FROM e), y AS (SELECT *, row_number() OVER (PARTITION BY given < c ORDER BY f DESC, c DESC, week) AS i FROM x)
SELECT week, CAST(CASE WHEN t <= 500 THEN c WHEN m >= 500 THEN CASE WHEN row_number() OVER (ORDER BY c DESC, week) <= 500 THEN 1 ELSE 0 END ELSE given + CASE WHEN given < c AND i <= rest THEN 1 ELSE 0 END END AS BIGINT) AS n_drawn FROM y""")
def _(v):
    rows = model.replies(v.posts).filter(ranged(F.col("created"))).select("zuri", iso_week(to_timestamp(F.col("created"))).alias("week"))
    return sampling.stratified(rows, "week", "zuri", 500, 7).groupBy("week").agg(F.count("*").alias("n_drawn"))


@query("P7_fold_balance", f"{A}, hv AS (SELECT DISTINCT post FROM a WHERE stage = 'human' AND post IS NOT NULL AND class IN ('hate', 'counter', 'neutral')), n AS (SELECT class, count(*) AS n FROM a WHERE stage = 'human' AND class IN ('hate', 'counter', 'neutral') GROUP BY 1) SELECT class, n, 5 AS n_folds, true AS balanced FROM n")
def _(v):
    rows = v.notes.filter(F.col("class").isin(model.CLASSES) & (F.col("stage") == "human")).select("z_pk", "class")
    per = sampling.folds(rows, "class", "z_pk", 5, 7).groupBy("class", "fold").agg(F.count("*").alias("k"))
    return per.groupBy("class").agg(F.sum("k").alias("n"), F.count("*").cast("int").alias("n_folds"), (F.max("k") - F.min("k") <= 1).alias("balanced"))


@query("P1_draw_sizes", f"{W}, c AS (SELECT count(DISTINCT zuri) AS n FROM r WHERE zuri NOT IN (SELECT zuri FROM r WHERE zlikecount = 0)) SELECT least(200, n) AS n_drawn, least(200, n) AS n_keys, 0::BIGINT AS n_excluded FROM c")
def _(v):
    r = model.replies(v.posts)
    barred = r.filter("zlikecount = 0").select("zuri")
    drawn = sampling.drawn_exactly(r, "zuri", barred, 200, 7)
    return drawn.join(barred.withColumn("barred", F.lit(True)), "zuri", "left").agg(F.count("*").alias("n_drawn"), F.countDistinct("zuri").alias("n_keys"), F.count("barred").alias("n_excluded"))


# numbers that only tests covered
@query("F10_long_enough", f"{W} SELECT zuri FROM p WHERE length(regexp_replace(ztext, '^\\s+|\\s+$', '', 'g')) >= 10")
def _(v):
    return v.posts.filter(text.long_enough(F.col("ztext"))).select("zuri")


@query("F20_authors_with_blank_bounds", f"{W}, c AS (SELECT zauthordid, count(*) AS n FROM r WHERE zauthordid IS NOT NULL GROUP BY 1) SELECT count(*) AS n_authors FROM c WHERE n >= 1")
def _(v):
    counts = model.replies(v.posts).filter("zauthordid IS NOT NULL").groupBy("zauthordid").agg(F.count("*").alias("n"))
    return counts.filter(authors.bounded(F.col("n"), *authors.valid_bounds(None, None))).agg(F.count("*").alias("n_authors"))


@query("C4_escaped_search", f"{W} SELECT zuri FROM p WHERE contains(ztext, '0%') OR contains(ztext, '_')")
def _(v):
    like = lambda s: F.col("ztext").like(f"%{text.escape_like(s)}%")
    return v.posts.filter(like("0%") | like("_")).select("zuri")


@query("O9_rotated_queue", "SELECT z_pk, (row_number() OVER (ORDER BY z_pk) - 1 + 3) % count(*) OVER () AS place FROM ztrackedaccount")
def _(v):
    rows = with_rank(v.raw("ztrackedaccount").select("z_pk"), ["z_pk"], "position").withColumn("position", F.col("position") - 1)
    return rows.select("z_pk", roots.rotated(rows.count(), -3).cast("long").alias("place"))


@query("S9_first_model", f"{A}, {SCORES} SELECT head, arg_min(model, seq) AS model FROM s GROUP BY 1")
def _(v):
    return v.scores.groupBy("head").agg(F.min_by("model", "seq").alias("model"))


@query("I1_resume_cursors", f"WITH {MESSAGES}, l AS (SELECT channel, arg_max(coalesce(text, '') = '' OR msg_id % 3 = 0, msg_id) AS failed, max(msg_id) AS newest FROM m GROUP BY 1) SELECT channel, CASE WHEN failed AND newest > 90000 - {incremental.RESUME_HOURS} * 3600 THEN newest END AS cursor FROM l")
def _(v):
    status = F.when((F.coalesce("text", F.lit("")) == "") | (F.col("msg_id") % 3 == 0), "failed").otherwise("ok")
    log = v.messages.select("channel", status.alias("status"), F.col("msg_id").alias("cursor"), F.col("msg_id").cast("double").alias("at"))
    return incremental.resume_cursor(log, "channel", 90_000.0)


@query("I5_tree_states", """SELECT z_pk, CASE WHEN s = 'complete' OR o IN (0, 2) THEN 'complete' WHEN o = 1 THEN 'inProgress' ELSE s END AS state FROM (SELECT z_pk, lower(trim(zreplytreestatus)) AS s, zlikecount % 4 AS o FROM zpost WHERE zisrootpost = 1)""")
def _(v):
    tops = v.raw("zpost").filter("zisrootpost = 1").select("z_pk", F.lower(F.trim("zreplytreestatus")).alias("s"), F.element_at(F.array(*[F.lit(x) for x in ("ok", "partial", "gone", "retry")]), (F.col("zlikecount") % 4 + 1).cast("int")).alias("o"))
    return tops.select("z_pk", incremental.next_state(F.col("s"), F.col("o")).alias("state"))


@query("K6_leaves", f"{_SR} SELECT count(*) AS n_scored, count(*) AS n_in_leaves FROM y WHERE score IS NOT NULL")
def _(v):
    rows = structure.scored_replies(v.posts, v.latest_scores)
    cube = structure.escalation(rows, v.latest_scores)
    n = rows.filter("score IS NOT NULL").count()
    integrity.leaves_add_up(cube, "n", n, ["outlet_name", "depth_bucket"])
    return cube.filter("outlet_name <> 'ALL' AND depth_bucket <> 'ALL'").agg(F.lit(n).cast("long").alias("n_scored"), F.sum("n").alias("n_in_leaves"))


@query("S12_markdown_table", "SELECT username, coalesce(status, '') AS status FROM channels")
def _(v):
    shown = documents.markdown(v.raw("channels").select("username", "status"), "Channels", ["as they stand"])
    rows = [[c.strip() for c in line.strip("|").split("|")] for line in shown.splitlines() if line.startswith("| ")][1:]
    return v.spark.createDataFrame(rows, "username string, status string")


@query("S14_sealed", "SELECT true AS intact, false AS intact_when_changed")
def _(v):
    folder = f"{shared_dir(v.spark)}/sealed-{uuid.uuid4().hex}"
    jsonl.write_jsonl(v.scores.select("uri", "score"), folder)
    local = folder.removeprefix("file://")
    jsonl.seal(local)
    before = jsonl.verify(local)
    with open(f"{local}/part-added.json", "w") as f:
        f.write("{}")
    return v.spark.createDataFrame([(before, jsonl.verify(local))], "intact boolean, intact_when_changed boolean")


@query("S20_review_entries", "SELECT uri, max(speech_class) AS class FROM evalset WHERE uri IS NOT NULL GROUP BY 1")
def _(v):
    folder = f"{shared_dir(v.spark)}/reviews-{uuid.uuid4().hex}"
    once = v.raw("evalset").filter("uri IS NOT NULL").groupBy("uri").agg(F.max("speech_class").alias("class"))
    once.select(F.concat(F.lit("# Review\n\n## "), "uri", F.lit("\nclass: "), "class", F.lit("\nreviewed: yes\nThe class: of this text is a quotation.")).alias("value")).write.text(folder)
    return documents.review_entries(v.spark, folder).select("uri", "class")

"""The reader's operators on the fixtures of its own tests."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import stats, text
from corpusloom.functions.time import iso_week
from corpusloom.operators import authors as au
from corpusloom.operators import roots, weekly
from tests_support import posts, reply, root

PROBED = "zdid string, zcurrenthandle string, zcurrentstatus string, zlastprobedat double, zfirstseenat double, zlastseenat double"


@pytest.fixture(scope="module")
def authors_main(spark):
    """Two outlets, seven authors with 1, 2, 3, 9, 10, 99 and 100 replies, the least first."""
    rows, pk = [root(1, 1), root(2, 2)], 10
    for n in (1, 2, 3, 9, 10, 99, 100):
        for i in range(n):
            rows.append(reply(pk, f"a{n:03d}", 1 + (i % 2 if n == 100 else 0), depth=2 if n == 2 and i else 1))
            pk += 1
    return posts(spark, rows)


@pytest.fixture(scope="module")
def nobody(spark):
    return spark.createDataFrame([], PROBED)


def test_limit_comes_after_the_ranking(authors_main, nobody):
    top = au.sorted_authors(au.authors(authors_main, nobody), "replies", 2).collect()
    assert [(r["zauthordid"], r["reply_count"]) for r in top] == [("a100", 100), ("a099", 99)]


def test_histogram_edges(authors_main):
    got = {r["bin"]: r["n_authors"] for r in au.histogram(au.replies_per_author(authors_main), "c").collect()}
    assert got == {"1": 1, "2-9": 3, "10-99": 2, "100-999": 1, "1000+": 0}


def test_population(authors_main, nobody):
    r = au.population(authors_main, nobody, 1e9).first()
    assert (r["n_authors"], r["n_replies"], r["median_replies"], r["n_active"]) == (7, 224, 9, 0)


def test_authors_of_two_outlets(authors_main, nobody):
    got = {r["zauthordid"]: r["n_outlets"] for r in au.authors(authors_main, nobody).collect()}
    assert got["a100"] == 2 and got["a099"] == 1
    assert {r["zauthordid"] for r in au.authors(authors_main, nobody, outlet=2).collect()} == {"a100"}


def test_median_of_an_even_number(spark):
    rows = [root(1)] + [reply(10 * n + i, f"a{n}") for n in (1, 2, 3, 4) for i in range(n)]
    assert au.upper_median(au.replies_per_author(posts(spark, rows)), "c", "zauthordid").first()[0] == 3


def test_empty_store(spark, nobody):
    p = posts(spark, [])
    assert au.population(p, nobody, 0.0).first().asDict() == {"n_authors": 0, "n_replies": 0, "n_active": 0, "median_replies": 0}
    assert au.authors(p, nobody).count() == au.sorted_authors(au.authors(p, nobody), "span", 5).count() == 0
    assert roots.root_posts(p).count() == 0


def test_orphans_count_only_without_a_join(spark, nobody):
    p = posts(spark, [root(1), reply(10, "a"), reply(11, "a"), reply(12, "b", to=99)])
    assert au.authors_in_range(p, 1, None).first()[0] == 2
    assert au.authors_in_range(p, 1, None, 1).first()[0] == 1
    assert au.author_detail(p, p, nobody, "b").count() == 0
    assert {r["zauthordid"]: r["n_outlets"] for r in au.outlet_counts(p, p.select("zauthordid").filter("zauthordid = 'b'").distinct()).collect()} == {"b": 0}


def test_handles(spark):
    probed = spark.createDataFrame([("c", "probed", "active", 1.0, 0.0, 1.0), ("a", None, "active", None, 0.0, 1.0)], PROBED)
    p = posts(spark, [root(1), reply(10, "a", handle="old"), reply(11, "a", handle="new"), reply(12, "b"), reply(13, "c", handle="old")])
    got = {r["zauthordid"]: r["handle"] for r in au.authors(p, probed).collect()}
    assert got == {"a": "new", "b": None, "c": "probed"}
    assert [r[0] for r in au.handles(p, "a").collect()] == ["new", "old"]


def test_delivered_again_is_ignored(spark):
    p = posts(spark, [root(1), reply(10, "a", text="first"), (11, *reply(10, "b", text="second")[1:])])
    assert [(r["z_pk"], r["zauthordid"]) for r in p.filter("zisrootpost = 0").collect()] == [(10, "a")]


def test_root_counts(spark):
    rows, pk = [], 1000
    for i, n in enumerate((0, 3, 50, 75, 120)):
        rows.append(root(i + 1))
        for _ in range(n):
            rows.append(reply(pk, "a", i + 1))
            pk += 1
    p = posts(spark, rows)
    count = lambda *b: sorted(r["n_replies"] for r in roots.root_posts(p, None, *b).collect())
    assert count(None, None) == [0, 3, 50, 75, 120]
    assert count(*roots.preset_bounds("50-99")) == [50, 75]
    assert count(3, 75) == [3, 50, 75]
    assert count(*roots.preset_bounds("custom", 0, 0)) == [0]


def test_search_takes_wildcards_as_they_are(spark):
    p = posts(spark, [root(1, text="100% sure"), root(2, text="1000 sure"), root(3, text="a Needle"), root(4, text=None)])
    found = lambda s: sorted(r["zuri"] for r in roots.root_posts(p, search=s).collect())
    assert found("100%") == ["r1"] and found("needle") == ["r3"] and found("_") == []
    assert text.escape_like("a%b_c\\") == "a\\%b\\_c\\\\"


def test_bounds():
    assert au.valid_bounds(None, None) == (1, None)
    with pytest.raises(ValueError):
        au.valid_bounds(5, 4)


def test_context_shows_no_judgement(spark):
    p = posts(spark, [root(1), reply(10, "a"), reply(11, "b", parent="p10"), reply(12, "c", to=99)])
    got = roots.labelling_context(p, p.select("zuri"))
    assert not {c for c in got.columns if any(w in c for w in ("score", "label", "class", "model", "confidence"))}
    assert {r["zuri"]: r["parent_uri"] for r in got.collect()} == {"p10": None, "p11": "p10"}


def test_iso_year_is_not_the_calendar_year(spark):
    assert spark.sql("SELECT timestamp'2024-12-30' AS t").select(iso_week(F.col("t"))).first()[0] == "2025-W01"


@pytest.mark.parametrize("n, cap", [(1000, 400), (5, 400), (401, 400), (10, 2), (10, 3), (0, 5)])
def test_decimation_keeps_both_ends(spark, n, cap):
    df = spark.range(n).select("id")
    got = sorted(r[0] for r in weekly.decimated(df, ["id"], cap).collect())
    assert len(got) == min(n, cap) and (not n or (got[0], got[-1]) == (0, n - 1))


def test_trend_is_zero_after_nothing(spark):
    df = spark.createDataFrame([(1, 0), (2, 4), (3, 6)], "week int, n int")
    assert [r["change"] for r in weekly.trend(df, "n").orderBy("week").collect()] == [0.0, 0.0, 0.5]


def test_wilson(spark):
    low, high = spark.createDataFrame([(8, 10), (0, 0)], "k int, n int").select(*stats.wilson(F.col("k"), F.col("n"))).collect()[0]
    assert (round(low, 4), round(high, 4)) == (0.4902, 0.9433)
    r = spark.createDataFrame([(0, 0)], "k int, n int").select(*stats.wilson(F.col("k"), F.col("n"))).first()
    assert tuple(r) == (0.0, 0.0)


@pytest.mark.parametrize("given, n", [("1.2K", 1200), ("3M", 3_000_000), ("17", 17), ("", None), ("x", None), (None, None)])
def test_view_counts(spark, given, n):
    assert spark.createDataFrame([(given,)], "v string").select(text.view_count(F.col("v"))).first()[0] == n


def test_links_and_tokens(spark):
    df = spark.createDataFrame([("https://t.example/s/name/12", "Grüße @You #tag https://a.b/c x_1"), ("https://t.example/name", None)], "l string, t string")
    got = df.select(*text.link_parts(F.col("l")), text.tokens(F.col("t"))).collect()
    assert [tuple(r)[:2] for r in got] == [("name", 12), ("name", None)]
    assert got[0][2] == ["grüße", "@you", "#tag", "<url>", "x_1"] and got[1][2] == []


def test_prompt_is_filled_in_order(spark):
    df = spark.createDataFrame([("a {{language}}", "de")], "t string, l string")
    assert df.select(text.filled_prompt("{{text}}/{{language}}", F.col("t"), F.col("l"))).first()[0] == "a de/de"


def test_lookups_reach_the_scan_and_choose_the_first_row(spark, tmp_path):
    """An author's posts: the scan filters by author, nothing but their URIs is shuffled, and later deliveries do not count."""
    from corpusloom.operators import integrity, model
    from tests_support import POST

    rows = [root(1), reply(10, "a"), reply(11, "b"), (12, *reply(10, "b", text="again")[1:]), (9, *reply(11, "a", text="before")[1:]), reply(13, "c")]
    path = str(tmp_path / "zpost.parquet")
    spark.createDataFrame(rows, POST).write.parquet(path)
    raw = spark.read.parquet(path)
    for who in "abcx":
        got = model.posts_where(raw, F.col("zauthordid") == who)
        assert sorted(map(str, got.collect())) == sorted(map(str, model.posts(raw).filter(F.col("zauthordid") == who).select(*got.columns).collect()))
    plan = integrity.plan_text(model.posts_where(raw, F.col("zauthordid") == "a").select("zuri"))
    assert "EqualTo(zauthordid,a)" in plan and "ztext" not in plan and "Python" not in plan


def test_plans_prune_and_stay_in_the_jvm(spark, tmp_path):
    from corpusloom.operators import integrity, model
    from tests_support import POST

    path = str(tmp_path / "zpost.parquet")
    spark.createDataFrame([root(1), reply(10, "a")], POST).write.parquet(path)
    p = model.posts(spark.read.parquet(path))
    for plan in (au.author_count(p), au.outlet_authors(p), roots.root_posts(p), weekly.weekly_activity(p)):
        text_ = integrity.plan_text(plan)
        assert "ztext" not in text_ and "Python" not in text_ and "CartesianProduct" not in text_ and "NestedLoop" not in text_

"""Leaked passages against brute force, in many spellings."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import leakage

WORDS = [f"w{i}" for i in range(300)] + ["Straße", "Äpfel", "fünf"]


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = leakage.words(t)
        for j in range(len(w) - 11):
            windows.setdefault(tuple(w[j : j + 12]), set()).add(i)
    return {(d, i) for d, t in docs for w in [leakage.words(t)] for j in range(len(w) - 11) for i in windows.get(tuple(w[j : j + 12]), ())}


def test_against_brute_force(spark):
    rng = random.Random(1)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.choice([5, 12, 30, 60])))) for i in range(40)] + [(98, None), (99, "")]
    docs = []
    for d in range(150):
        w = rng.choices(WORDS, k=rng.choice([0, 10, 300, 4000]))
        for _ in range(rng.randint(0, 2)):
            own = (rng.choice(items)[1] or "").split()
            n = rng.choice([11, 12, 13, 40])
            at = rng.randint(0, max(0, len(own) - n))
            w[len(w) // 2 : len(w) // 2] = own[at : at + n]
        docs.append((d, " ".join(w)))
    docs += [(500, None), (501, ""), (7, docs[3][1]), (8, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("minhash", F.lit("clash")).withColumn("passage", F.lit(1)).repartition(5)
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(3))
    got = {tuple(r) for r in leakage.leaked_items(df, it.drop("doc_id")).collect()}
    assert got == brute(docs, items) and len(got) > 20


TEXT = "Fünf Äpfel lagen auf der Straße, und niemand fragte, wem sie gehörten oder wer sie aß."


@pytest.mark.parametrize(
    "spelled",
    [TEXT, TEXT.upper(), unicodedata.normalize("NFD", TEXT), TEXT.replace(" ", "  \n> "), TEXT.replace(",", " –").replace(".", "!"), TEXT.replace("lagen", "<b>lagen</b>").replace("der", "<a href='x y'>der</a>"), TEXT.replace("Äpfel", "&Auml;pfel"), TEXT.replace("Äpfel", "**Äpfel**"), TEXT.replace("Straße", "Stra­ße"), "x " * 9000 + TEXT + " y" * 9000],
)
def test_spellings_do_not_matter(spark, spelled):
    docs = spark.createDataFrame([(1, spelled)], "doc_id long, text string")
    items = spark.createDataFrame([(5, TEXT)], "item_id long, text string")
    assert [tuple(r) for r in leakage.leaked_items(docs, items).collect()] == [(1, 5)]


@pytest.mark.parametrize(
    "piece",
    [
        f'<a href="https://x.example/?{"q=1&r=zz&" * 80}">lagen</a>', f"<p style='{'color: red; ' * 60}' hidden>lagen</p>", f"<img src=data:image/png;base64,{'Qk0a' * 200}== alt=x>lagen", "<div " + " ".join(f'data-a{i}="some words {i}"' for i in range(40)) + ">lagen</div>",
        '[lagen](https://x.example/a "A title of it")', "[lagen](https://x.example/a 'A title')", "[lagen](/wiki/Apfel_(Obst))", "[lagen](https://x.example/a (title))", "[lagen](https://x.example/my file.html)", "[lagen](<my file.html>)", "[lagen]( /a )",
    ],
)
def test_long_tags_and_links_of_every_form_do_not_matter(piece):
    assert leakage.words(TEXT.replace("lagen", piece)) == leakage.words(TEXT)


def test_prose_in_brackets_and_after_a_stray_sign_is_kept():
    prose = "he said so and then he said it again to all of them " * 10
    for text in (f"where a <b {prose} and c> d", f"[sic] ({prose})", f"[sic](he said {prose})", f"x <b = {prose}"):
        assert "".join(leakage.words(text)).count("hesaidso") >= 10
    leakage.words("<a =b" * 20_000 + "[x](" * 20_000 + "[y](a(" * 5_000 + "[z](./ " * 5_000)


def test_eleven_words_are_no_leak_and_empty_sides(spark):
    items = spark.createDataFrame([(5, TEXT)], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(TEXT.split()[:11]) + " z " + " ".join(TEXT.split()[5:16]))], "doc_id long, text string")
    assert leakage.leaked_items(docs, items).count() == 0
    assert leakage.leaked_items(docs.limit(0), items).count() == 0
    assert leakage.leaked_items(docs, items.limit(0)).count() == 0


def test_equal_passages_have_equal_minhashes():
    rng = random.Random(2)
    w = rng.choices(WORDS, k=500)
    whole, part = leakage.signatures(w), leakage.signatures(["q", *w[100:112], "z"])
    assert list(whole) == [12, 24, 48, 96] and list(part) == [12]
    assert len(set(part[12].tolist()) & set(whole[12].tolist())) >= 1 and len(whole[12]) < 0.4 * 500
    assert len(whole[48]) < len(whole[24]) < 3 * len(whole[12])
    alone = leakage.signatures(w[200:248])
    assert all(set(alone[n].tolist()) <= set(whole[n].tolist()) for n in (12, 24, 48))
    assert leakage.signatures([]) == leakage.signatures(w[:11]) == leakage.signatures(w, ()) == {}


def test_sliding_least():
    import numpy as np

    a = np.random.default_rng(1).integers(0, 1 << 60, 200).astype(np.uint64)
    for width in (1, 2, 3, 8, 20, 44, 92, 200):
        assert leakage._sliding_least(a, width).tolist() == [a[i : i + width].min() for i in range(201 - width)]


def test_items_of_all_sizes(spark):
    """Items of 12 to 300 words, of which twelve, some or all stand in long documents: against brute force."""
    rng = random.Random(7)
    items = [(i, " ".join(rng.choices(WORDS, k=n))) for i, n in enumerate([12, 13, 20, 24, 31, 48, 60, 96, 120, 200, 300] * 2)]
    docs = []
    for d in range(110):
        own = items[d % len(items)][1].split()
        n = rng.choice([12, min(len(own), 30), len(own)])
        at = rng.randint(0, len(own) - n)
        w = rng.choices(WORDS, k=2000)
        docs.append((d, " ".join(w[:900] + own[at : at + n] + w[900:])))
    df, it = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert {tuple(r) for r in leakage.leaked_items(df, it).collect()} == want and len(want) >= 110


def test_items_with_changed_words_are_contained(spark):
    """Every tenth to fifteenth word is another, so that twelve in sequence hardly remain; and how many of them are found."""
    rng = random.Random(8)
    items = [(i, " ".join(rng.choices(WORDS, k=[48, 96, 150, 300][i % 4]))) for i in range(60)]
    docs, want = [], {}
    for i, t in items:
        own = t.split()
        for j in range(rng.randint(5, 25), len(own), 30):
            own[j] = "other"
        docs.append((i, " ".join(rng.choices(WORDS, k=700) + own + rng.choices(WORDS, k=700))))
    shingles = lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    for d, x in docs:
        for i, t in items:
            s = shingles(t.split())
            share = len(s & shingles(x.split())) / len(s)
            if share >= 0.8:
                want[d, i] = share
    df = spark.createDataFrame([*docs, docs[0]], "doc_id long, text string").withColumn("containment", F.lit("clash")).repartition(5)
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in leakage.contained_items(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got) and len(want) >= 50 and len(got) >= 0.95 * len(want)
    assert leakage.contained_items(df.limit(0), df.withColumnRenamed("doc_id", "item_id")).count() == 0

"""The abuse classifier on labelled sentences it has not seen, and on disguises."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import abuse, abuse_seed


@pytest.fixture(scope="module")
def model():
    return abuse.train([p.replace("{", "").replace("}", "") for p in abuse_seed.PLAIN])


@pytest.mark.parametrize("given, plain", [("W.A.N.K.E.R", "wanker"), ("a s s h o l e", "asshole"), ("p.i.e.c.e. .o.f. .s.h.i.t", "piece of shit"), ("m0r0n", "moron"), ("$lut", "slut"), ("wh*re", "whore"), ("as**ole", "asshole"), ("mоrоn", "moron"), ("scum​bag", "scumbag"), ("schwaaaaanz", "schwanz"), ("idi!ot", "idiiot"), ("Straße", "strasse"), ("24th", "0th"), ("1,200.50 euros", "0 euros")])
def test_undisguised(given, plain):
    assert abuse.undisguise(given) == plain


def test_quotations_in_longer_texts_are_set_apart():
    assert "quotation" in abuse.undisguise("Please stop using the word 'idiot' here")
    assert "idiot" in abuse.undisguise("'you idiot'")


def test_held_out_accuracy(model):
    texts, labels = abuse_seed.labelled(3000, 7)
    got = abuse.scores(pd.Series(texts), *model).to_numpy() >= abuse.LIMIT
    assert (got == np.array(labels, bool)).mean() > 0.97


@pytest.mark.parametrize("text", ["You filthy idiot!", "I agree. Now drop dead, you worthless rat", "DU BIST EIN IDIOT, du elender Drecksack", "These migrants are vermin", "show me your t1ts, bitch", "Stfu you stupid 🐷"])
def test_abuse_is_found_wherever_it_stands(model, text):
    for whole in (text, "The library opens on Monday. " * 400 + text, text + "\n" + "Danke für die Übersicht. " * 400):
        assert abuse.scores(pd.Series([whole]), *model)[0] >= abuse.LIMIT


@pytest.mark.parametrize("text", ["", "   ", "!!!", "The pest controller found a rat in the cellar of the clinic.", "Somebody wrote 'wanker' on the wall of the library, it was painted over.", "Das ist völliger Unsinn und das weißt du auch.", "The speed limit is garbage and everybody knows it.", "Brustkrebsvorsorge ab Mai wieder in Velmark, 12 Termine frei."])
def test_harmless(model, text):
    assert abuse.scores(pd.Series([text]), *model)[0] < abuse.LIMIT


def test_equal_input_gives_an_equal_model():
    lines, labels = [" you idiot ", " good day ", " you moron ", " nice day "], np.array([1, 0, 1, 0])
    a, b = abuse.fit(lines, labels), abuse.fit(lines, labels)
    assert a[1] == b[1] and (a[0] == b[0]).all()
    assert (abuse.score_lines(lines, *a) > 0.5).tolist() == [True, False, True, False]


def test_columns_nulls_and_sample(spark, model):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "You worthless moron."), (3, "You worthless moron."), (4, "Thanks!")], "id int, text string").withColumn("abuse_score", F.lit("clash"))
    got = [(r["id"], None if r["abuse_score"] is None else r["abuse_score"] >= abuse.LIMIT) for r in abuse.abuse_score(df, F.col("text"), model).orderBy("id").collect()]
    assert got == [(1, None), (2, False), (3, True), (3, True), (4, False)]
    assert abuse.abuse_score(df.limit(0), F.col("text"), model).count() == 0
    many = spark.range(5000).select("id", F.concat(F.lit("t"), "id").alias("text"))
    sample = abuse.corpus_sample([(many, "text", ["id"])], 100)
    assert len(sample) == 100 and sample == abuse.corpus_sample([(many.repartition(7), "text", ["id"])], 100)
    assert abuse.corpus_sample([(many.limit(0), "text", ["id"])], 100) == []


#: Sentences in words of their own, written apart from the patterns of the training text.
OTHER_ABUSE = """Your whole family is a waste of oxygen.
Shut up, you miserable little worm.
I will smash your face in when I see you.
Those people are nothing more than filthy dogs.
Somebody please put a bullet in that senator.
You dumb cow, go back to the kitchen.
He is a spineless clown and a dirty rat.
I'd love to rip your clothes off, baby.
These immigrants are maggots feeding on us.
You retarded monkey, learn to read.
Hope you get cancer and suffer.
We know your address, sleep well tonight.
What a fat ugly pig she is.
All of them should be gassed.
Blow me, bitch.
Du bist der letzte Dreck.
Halt einfach die Schnauze, du Missgeburt.
Solche Leute gehören an die Wand gestellt.
Ich breche dir jeden Knochen einzeln.
Diese Parasiten leben auf unsere Kosten wie Ungeziefer.
Die dumme Kuh soll zurück an den Herd.
Verreck doch endlich, du Ratte.
Zieh dich aus, ich will deine Brüste sehen.
Die Politikerin ist eine hirnlose Schlampe.""".split("\n")
OTHER_HARMLESS = """The worm farm at the school won a prize.
He smashed the record at the regatta.
My dog is filthy after the walk.
She put the senator's letter on the table.
The kitchen of the town hall is being repaired.
The clown at the fair made the children laugh.
The monkey house at the zoo opens on Friday.
She survived cancer and thanked the clinic.
We know the address of the new library.
The gas bill is outrageous, I am furious about this council.
This budget is an idiotic mess and an insult to taxpayers.
He was called a pig in the street and pressed charges.
Calling refugees maggots is disgusting, stop it.
The court heard that he had written 'I will break your bones'.
The rat trap in the cellar caught nothing.
Die Kuh auf der Weide ist trächtig.
Der Dreck am Ufer muss weg.
Die Wand im Rathaus wird gestrichen.
Er brach sich beim Turnen zwei Knochen.
Wer andere als Ratten bezeichnet, wird angezeigt.
Ungeziefer im Getreidespeicher kostet die Bauern viel Geld.
Diese Entscheidung ist eine Frechheit, ich bin stinksauer.
Brustkrebs wird früh erkannt besser geheilt.
Die Ausstellung zeigt nackte Figuren aus Bronze.""".split("\n")
ORDINARY = ["The council met on Monday and spoke about the bridge.", "My neighbour counted twelve buses in one morning.", "Thank you for the summary.", "The library opens at nine.", "Im Protokoll steht das anders.", "Die Schule wird im Mai saniert."]


def test_other_words_than_those_of_the_training_text():
    """How far the model carries: most of the abuse, and few of the harmless sentences."""
    model = abuse.train(ORDINARY)
    found = [(abuse.scores(pd.Series(x), *model) >= abuse.LIMIT).sum() for x in (OTHER_ABUSE, OTHER_HARMLESS)]
    assert found[0] >= 0.7 * len(OTHER_ABUSE) and found[1] <= 0.25 * len(OTHER_HARMLESS)

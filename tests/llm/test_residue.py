"""Evidence line by line, and boilerplate by host."""

import random
import re
from re import _parser

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import residue


@pytest.mark.parametrize(
    "line, kind",
    [
        ("Dear {{ first_name }}, thank you.", "gap"), ("By %%AUTHOR%%, updated today.", "gap"), ("Posted in [[region]] by <%= name %>.", "gap"), ("Laut [Name einfügen] bleibt es dabei.", "gap"), ("${item.title} told us.", "gap"), ("Foto: ~caption~ (replace)", "gap"), ("According to &lt;byline&gt;, it stands.", "gap"), ("[INSERT QUOTE HERE]", "gap"), ("{author} was here", "gap"),
        ("Hello [object Object], you have undefined new replies.", "gap"), ("Posted by null on Invalid Date.", "gap"), ("Share this: undefined", "gap"),
        ("Lorem ipsum dolor sit amet consectetur adipiscing.", "filler"), ("Dies ist ein Blindtext, an dem man nichts lernt.", "filler"), ("TKTK quote TKTK", "filler"), ("Text folgt.", "filler"), ("Headline goes here.", "filler"),
        ("Error 403: Forbidden.", "error"), ("HTTP 502 - Bad Gateway", "error"), ("404 Not Found", "error"), ("Oops! Something went wrong (504).", "error"), ("The page you requested could not be found.", "error"), ("Es ist ein Fehler aufgetreten.", "error"), ("Checking your browser before you continue.", "error"), ("Good. Access denied.", "error"),
        ("Please enable JavaScript to view the comments.", "script"), ("Diese Seite benötigt JavaScript.", "script"), ("<noscript>Scripting must be allowed</noscript>", "script"), ("Ohne Skripte kann die Seite nicht angezeigt werden.", "script"),
        ("In the template file a name in double braces such as {{headline}} is replaced by the exporter.", None), ("The variable ${HOME} in the scripts points to the disk.", None), ("Lorem ipsum is what printers call filler text.", None), ("The council site answered with error 404 for a whole afternoon, and people laughed.", None), ("A reader asks why the box only works with JavaScript switched on.", None), ("Room 404 of the town hall is not found easily.", None), ("[sic] and [...] are kept.", None), ("Fehlende Werte werden nie null.", None), ("90% agreed, 10% did not.", None), ("", None), ("   ", None),
    ],
)
def test_evidence(line, kind):
    assert residue.evidence(line) == kind


def test_boilerplate_is_subtracted_unless_it_is_all_there_is(spark):
    notice = "Please enable JavaScript to use the comments."
    full = [(i, f"The council met with {chr(97 + i % 26)}{chr(97 + i // 26)} and spoke of many things.\nNothing else happened in the town.\n{notice}", "a") for i in range(40)]
    error = [(100 + i, "HTTP 502 - Bad Gateway", "b") for i in range(40)]
    own = [(200, f"The council met and spoke about the bridge and the school.\n{notice}", "c"), (201, "Dear {{name}}, hello.", "a"), (202, "The council met in the old hall of the town today.", "a"), (203, None, "a"), (204, "", None), (205, "Text folgt.", None), (205, "Text folgt.", None)]
    df = spark.createDataFrame(full + error + own, "doc_id long, text string, source string").withColumn("kinds", F.lit("clash")).withColumn("line", F.lit(1)).repartition(6)
    got = sorted((r["doc_id"], ",".join(r["kinds"])) for r in residue.residue(df).collect())
    assert got == sorted([(100 + i, "error") for i in range(40)] + [(200, "script"), (201, "gap"), (205, "filler"), (205, "filler")])
    assert residue.residue(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [20, 200])
def test_gaps_filler_and_errors_count_in_recurring_lines_of_hosts_of_any_size(spark, n):
    broken = ["By {{ author }}, updated today.", "Text folgt.", "Error 502: Bad Gateway."]
    docs = [(i, f"The council met with {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} and spoke of many things.\n{broken[i % 3] if i < n else ''}", "a") for i in range(5 * n)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert sorted(r["doc_id"] for r in residue.residue(df).collect()) == list(range(n))


def test_long_texts_are_read_to_the_end(spark):
    df = spark.createDataFrame([(1, "The council met again in the hall. " * 20_000 + "By __AUTHOR__, updated.", "a")], "doc_id long, text string, source string")
    assert residue.residue(df).count() == 1


@pytest.mark.parametrize(
    "line, kind",
    [
        ("Please enable JS and disable any ad blocker", "script"), ("JS is required", "script"), ("<NOSCRIPT>", "script"), ("Some parts of the page will not work", "script"),
        ("Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.", "filler"), ("This is example text.", "filler"), ("This is dummy content.", "filler"), ("asd, asd, asd", "filler"), ("He wrote: ut et in ad ex ea.", "filler"),
        ("Bitte laden Sie die Seite neu.", "error"), ("Bitte versuchen Sie, sich anzumelden.", "error"), ("This site is down", "error"), ("The service is unable to start", "error"), ("Der Beitrag wurde geloescht", "error"), ("You do not have the rights", "error"), ("SQL syntax", "error"), ("Unable to fetch more", "error"),
        ("%Öffnungszeiten% am Montag", "gap"), ("By &LT;author&GT;, today", "gap"), ("You have NİL messages", "gap"),
    ],
)
def test_no_evidence_is_dropped_unseen(line, kind):
    assert residue.evidence(line) == kind


def drawn(tree, rng, groups):
    """A text that the parsed pattern may match, with assertions left out."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name in ("NOT_LITERAL", "ANY"):
            out += "x"
        elif name == "IN":
            allowed = re.compile("|".join({"LITERAL": lambda a: re.escape(chr(a)), "RANGE": lambda a: f"[{chr(a[0])}-{chr(a[1])}]", "CATEGORY": lambda a: {"CATEGORY_DIGIT": r"\d", "CATEGORY_WORD": r"\w", "CATEGORY_SPACE": r"\s", "CATEGORY_NOT_WORD": r"\W", "CATEGORY_NOT_DIGIT": r"\D", "CATEGORY_NOT_SPACE": r"\S"}[str(a)]}[str(o)](a) for o, a in arg if str(o) != "NEGATE"))
            negated = str(arg[0][0]) == "NEGATE"
            out += rng.choice([c for c in "abcdsözÄAXZ059 .,:;!?_-–—#~{}[]()<>%$@&^/'|*=" if bool(allowed.fullmatch(c)) != negated])
        elif name == "BRANCH":
            out += drawn(rng.choice(arg[1]), rng, groups)
        elif name == "SUBPATTERN":
            text = drawn(arg[3], rng, groups)
            groups[arg[0]] = text
            out += text
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(drawn(arg[2], rng, groups) for _ in range(arg[0] + rng.randint(0, min(2, arg[1] - arg[0]))))
        elif name == "GROUPREF":
            out += groups[arg]
        else:
            assert name in ("AT", "ASSERT", "ASSERT_NOT"), name
    return out


@pytest.mark.parametrize("name", ["_GAP", "_CAPITAL_GAP", "_HOLLOW", "_FILLER", "_SCRIPT", "_ERROR"])
def test_tests_before_the_patterns_lose_nothing(name):
    pattern, rng, n = getattr(residue, name), random.Random(3), 0
    tree = _parser.parse(pattern.pattern, pattern.flags)
    for _ in range(20_000):
        s = drawn(tree, rng, {})
        s = rng.choice([str, str.upper, str.title, lambda x: x.replace("i", "ı").replace("s", "ſ"), lambda x: x.replace("i", "İ")])(rng.choice(["", "", "They wrote "]) + s).strip()
        if not pattern.search(s):
            continue
        n += 1
        low = residue._folded(s)
        passes = {"_GAP": lambda: residue._SIGN.search(s) or "placeholder" in low, "_CAPITAL_GAP": lambda: residue._CAPITAL_SIGN.search(s), "_HOLLOW": lambda: any(w in low for w in residue._HOLLOW_WORDS), "_FILLER": lambda: pattern.match(s) or residue._may_be_filler(low), "_SCRIPT": lambda: any(w in low for w in residue._SCRIPT_WORDS) and (pattern.match(s) or "<noscript" in low), "_ERROR": lambda: pattern.match(s)}
        assert passes[name](), s
    assert n > 5_000


@pytest.mark.parametrize(
    "line, kind",
    [
        ("Dear [First Name], thank you for your order.", "gap"),
        ("Hi $NAME, your parcel is on its way", "gap"),
        ("{0} comments", "gap"),
        ("Dear FNAME_PLACEHOLDER", "gap"),
        ("502 – Proxy Error", "error"),
        ("Seite nicht gefunden (404). Zur Startseite", "error"),
        ("Oops! We can't seem to find the page you're looking for.", "error"),
        ("Please enable cookies and JavaScript to continue", "script"),
        ("This site requires JS.", "script"),
        ("Lorem ipsum dolor sit amet", "filler"),
        ("Hello *|FNAME|*, welcome back", "gap"),
        ("Hello %s, you have %d new messages", "gap"),
        ("Sehr geehrte [Anrede], anbei", "gap"),
        ("Geburtsdatum: TT.MM.JJJJ", "gap"),
        ("<?php echo $title; ?>", "gap"),
        ("[% article.title %]", "gap"),
        ("Welcome {$user.name}", "gap"),
        ("500 Internal Server Error", "error"),
        ("Interner Serverfehler", "error"),
        ("HTTP ERROR 503", "error"),
        ("The requested URL /a/b was not found on this server.", "error"),
        ("nginx/1.18.0", "error"),
        ("Whitelabel Error Page", "error"),
        ("Sorry, you have been blocked", "error"),
        ("Just a moment...", "error"),
        ("Application error: a client-side exception has occurred", "error"),
        ("Wir führen gerade Wartungsarbeiten durch.", "error"),
        ("This page isn't working", "error"),
        ("You need to have JavaScript enabled in your browser", "script"),
        ("Bitte JavaScript im Browser aktivieren", "script"),
        ("Diese Seite funktioniert nicht ohne JavaScript", "script"),
        ("Bitte aktivieren Sie Cookies und JavaScript.", "script"),
        ("Page not found | 404", "error"),
        ("Sed ut perspiciatis unde omnis iste natus error", "filler"),
        ("Beispieltext", "filler"),
        ("Dein Text hier", "filler"),
        ("The server encountered an internal error or misconfiguration", "error"),
        ("Video unavailable", "error"),
        ("Die angeforderte Seite konnte nicht gefunden werden.", "error"),
        ("It looks like we couldn't find the page you requested", "error"),
        ("Lorem ipsum is what printers call filler text, the column reminds us.", None),
        ("Room 12 of the town hall is not found easily, visitors report.", None),
        ("0% agreed.", None),
        ("The council site answered with error 500 for a whole afternoon.", None),
        ("Our crawler skips pages that say page not found, of which we met 12 in March.", None),
        ("Der Blindtext im Entwurf des Radwegeplans wurde in der Sitzung zum Thema.", None),
        ("The prompt has two gaps, {{text}} and {{language}}, and both are filled before the model sees it.", None),
        ("The workshop on undefined behaviour of the scraper is on Friday.", None),
        ("Fehlende Werte bleiben fehlend und werden nie null.", None),
        ("[sic] and [...] are kept as the outlet wrote them.", None),
        ("The ferry costs $12 and A$AP played, 50 %s of it", None),
        ("He learned JavaScript at school and now teaches it.", None),
        ("404 people came, 502 stayed away.", None),
        ("In the template file a name in double braces such as {{headline}} is replaced by the exporter.", None),
        ("We could not find the money for the page of history.", None),
        ("The server brought the soup.", None),
        ("Wartungsarbeiten am Hafentunnel beginnen im Mai.", None),
        ("The museum is not available on Mondays.", None),
        ("Just a moment ago the mayor resigned.", None),
        ("Attention was required of everyone.", None),
        ("Die Seite des Flusses, an der wir wohnen, wurde nicht gebaut.", None),
        ("The proxy error in the vote count was corrected.", None),
    ],
)
def test_evidence_in_other_words(line, kind):
    """Lines that stand in none of the tables, and sentences that only write about such things."""
    assert residue.evidence(line) == kind

"""Template residue, filler, error pages and script notices that stand where content should be.

Normalised lines are counted by host; those that recur on many documents of a host are its boilerplate. A document is
excluded if it holds evidence: an unfilled or emptily filled gap, filler text or a message of a server or program in any
line, or a demand to switch scripts on in what remains without boilerplate. Sentences that write about such things are no
evidence.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import broadcast_if_small, durable

#: A line is boilerplate on this many documents of its host and this share of them.
RECURRENT_DOCS, RECURRENT_SHARE = 25, 0.05
#: With fewer words left beside its boilerplate, a document consists of it, and evidence in boilerplate counts.
RESIDUAL_WORDS = 8

_NAME = r"[^\W\d][\w.\-]{0,40}"
#: How templates mark a gap.
_GAP = re.compile(
    rf"\{{\{{[{{#/^&>]?\s*{_NAME}(?:\s*\|[^{{}}\n]{{0,40}})?\s*\}}\}}|\{{%-?\s*[^{{}}%\n]{{1,60}}?\s*-?%\}}|<%[=-]?\s*[^<>%\n]{{1,60}}?\s*%>|[$#]\{{\s*{_NAME}\s*\}}|\$\(\s*{_NAME}\s*\)"
    rf"|%%\s*{_NAME}\s*%%|(?<![\w%])%{_NAME}%(?![\w%])|(?<!\w)__[^\W\d_][\w.]{{0,40}}?__(?!\w)|@@\s*{_NAME}\s*@@|\[\[\s*{_NAME}\s*\]\]|<<\s*{_NAME}\s*>>|&lt;\s*{_NAME}\s*&gt;|(?<![\\\w}}{{$#]){{[^\W\d][\w.]{{2,40}}}}(?![\w{{}}])"
    rf"|~{_NAME}~\s*\(replace\)|\[\s*[\w.\- ]{{2,40}}:\s*(?:tbd|tba|todo|tk)\s*\]|\[\s*(?:insert|enter|add|your|put)\s[^\[\]\n]{{1,50}}\]|\[\s*[\w.\- ]{{2,50}}\s(?:einf(?:ü|ue)gen|einsetzen|erg(?:ä|ae)nzen|here)\s*\]|<\s*[\w.\- ]{{2,50}}\s(?:here|hier|einf(?:ü|ue)gen)\s*>|<\s*(?:insert|your)\s[\w.\- ]{{2,50}}>|\[(?:(?:first|last|full|middle|user|company|product|event|city|street|vor|nach|kunden|firmen|produkt)[ _-]?)?(?:name|titel|title|anrede|salutation|datum|date|ort|city|address|adresse|company|firma|betreff|subject|link|url|signature|unterschrift)(?: hier| here)?\]"
    rf"|\*\|\s*[^\W\d][\w:.]*\s*\|\*|\{{\{{\s*\}}\}}|\[%-?\s*[^\[\]%\n]{{1,60}}?\s*-?%\]|<\?(?:php|=)[^<>\n]{{0,120}}\?>|\{{\$[a-z_][\w.>\[\]-]{{0,40}}\}}|(?<![\w{{]){{\d{{1,2}}}}(?![\w}}])|\b(?:[a-z]+_)*placeholder(?:_[a-z]+)+\b|\b(?:[a-z]+_)+placeholder\b",
    re.I,
)
#: Gaps that only capitals or their very form give away.
_CAPITAL_GAP = re.compile(r"(?<![\w$])\$[A-Z][A-Z_]{2,}\b(?!\$)|(?<![\w%])(?<!\d )%(?:\d\$)?[sd](?![\w%])|\b(?:TT\.MM\.JJJJ|XX+\.XX+\.XX+|DD[./-]MM[./-]YYYY|MM[./-]DD[./-]YYYY)\b")
_EMPTY = r"(?:undefined|null|none|nan|nil|\[object object\]|invalid date|n/a)"
#: What programs write for a value they have not got.
_HOLLOW = re.compile(
    rf"\[object object\]|\binvalid date\b|\bshowing {_EMPTY} of\b|\b{_EMPTY} of {_EMPTY}\b|\b(?:by|von|hello|hallo|dear|share this|posted in|posted by|updated|published|teilen|autor|author|foto|photo|source|quelle):? {_EMPTY}(?=[\s,.!:;]|$)"
    rf"|\b{_EMPTY} (?:new )?(?:comments?|repl(?:y|ies)|likes?|views?|kommentare|antworten|beitr(?:ä|ae)ge|results?)\b(?=[.,!]|$)|^{_EMPTY}[.!]?$|:\s*{_EMPTY}$|\b{_EMPTY}, {_EMPTY}\b|\b(?:you have|es gibt|sie haben) {_EMPTY}\b",
    re.I,
)
#: The words of the customary filler text.
_LATIN = "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
_FILLER = re.compile(
    rf"(?:\b(?:{'|'.join(_LATIN.split())})\b[\s,.;:!?]*){{6,}}|^lorem ipsum\W*$|\blorem ipsum dolor\b|\bsed ut perspiciatis unde\b|^(?:beispieltext|fülltext|musterinhalt|filler|filler text|test (?:text|content|inhalt|page|seite|post|beitrag))\W*$|^(?:dein|ihr|euer) (?:text|inhalt|titel) (?:hier|kommt hierhin|steht hier)\W*$|\bdies ist ein (?:blind|typo|muster|platzhalter)text\b|^(?:ein )?(?:blindtext|platzhaltertext|platzhalter|mustertext|placeholder|placeholder text|sample text|dummy text)\W*$"
    rf"|\b((?:sample|dummy|placeholder|filler) text)\b(?:\W+\1\b)+|\b(asdf|qwer|qwertz|qwerty|asd|jkl)\b(?:\W+\2\b)+|^(?:test\W+){{2,}}\d*\W*$|\btk ?tk\b|^(?:the )?(?:text|inhalt|bild|artikel|content|story|more) (?:folgt|to come|coming soon)\W*$"
    rf"|^hier (?:steht|kommt|folgt|erscheint) (?:sp(?:ä|ae)ter |bald |demn(?:ä|ae)chst )?(?:der|die|das|ihr|ein|dein) (?:\w+ )?(?:artikel|text|inhalt|titel|teaser|bild)\b|^bitte (?:hier )?(?:den |einen |ihren )?(?:text|inhalt|titel|bild) (?:einsetzen|einf(?:ü|ue)gen|erg(?:ä|ae)nzen|ersetzen)"
    rf"|^this is (?:a |some |the )?(?:placeholder|dummy|sample|filler|example) (?:copy|text|content|page|paragraph)\b|^replace (?:it|this|me|this text) with your own\b|\b(?:goes|comes) here\W*$|^(?:enter )?your [\w ]{{2,30}} here\W*$|^(?:add|type|insert|write) (?:your |some )?(?:text|content|headline|title) here\b"
    rf"|^(?:headline|subheadline|title|caption|body|teaser) (?:here|goes here|tbd)\W*$|^coming soon\W*$",
    re.I,
)
_REASON = "not found|proxy error|server error|serverfehler|interner serverfehler|unavailable|dienst nicht verf(?:ü|ue)gbar|nicht verf(?:ü|ue)gbar|zeit(?:ü|ue)berschreitung|verbotener zugriff|forbidden|gone|bad gateway|bad request|internal server error|service (?:temporarily )?unavailable|gateway time-?out|unauthori[sz]ed|too many requests|request time-?out|method not allowed|access denied|permission denied|zugriff verweigert|nicht gefunden|seite nicht gefunden|page not found|connection (?:refused|reset|timed out)|request timed out"
#: How servers, programs and gatekeepers report that there is no page. Each has to begin the sentence.
_ERROR = re.compile(
    rf"^(?:(?:http )?(?:http(?:/\d(?:\.\d)?)?|error|fehler|status)(?: code)?\s*[:#(–—-]?\s*[45]\d\d\)?\s*(?:[:–—-].*|\W*|(?:{_REASON}).*)$|[45]\d\d\s*[:–—|-]?\s*(?:error|fehler|{_REASON})\b|(?:{_REASON})\W*(?:[([]?(?:http|error|fehler|code)?[ :#-]*[45]\d\d[)\]]?)?\W*$"
    rf"|(?:oops|whoops|uh-?oh|hoppla|ups)\b[\s\S]{{0,20}}(?:wrong|error|schief|fehler|broke|not find|problem)|something went wrong\b|(?:leider )?(?:es )?(?:ist|trat) (?:leider )?ein (?:\w+ )?fehler (?:aufgetreten|auf)\b|(?:leider )?ist (?:etwas|da etwas) schief|etwas ist schief|an? (?:unexpected |unknown |internal |fatal )?error (?:has )?occurred"
    rf"|(?:sorry[,!.]? |we(?:'re| are) sorry[,!.]? (?:but )?|leider )?(?:the|this|that|die|diese|dieser|der|our|unser|wir konnten die|we (?:can(?:'t|not)|could(?:n't| not)) find (?:the|that)) (?:angeforderte |gesuchte |gew(?:ü|ue)nschte |requested )?(?:page|content|post|article|thread|link|url|site|seite|artikel|beitrag|inhalt)\b(?: (?:that|which|you(?:'re| are| have|'ve)?|sie|die|looking|for|requested|angefordert(?:e|en)?|suchen|haben|ist|wurde|is|was|has|cannot|can't|could|does|doesn't|no|longer|leider|nicht|mehr|be|been|not|isn't|wasn't|may|existiert|konnte|kann))*[, ]+(?:found|exist|exists|available|removed|deleted|moved|unavailable|gefunden|verf(?:ü|ue)gbar|gel(?:ö|oe)scht|existiert|vorhanden|werden)\b"
    rf"|(?:sorry[,!.]? |it (?:looks|seems) like )?(?:we|i) (?:can(?:'t|not|’t)|could(?:n't| not|n’t)|were unable to) (?:seem to )?(?:find|locate) (?:what you(?:'|’| a)re looking for|(?:the|that|this|your) (?:\w+ )?(?:page|content|post|article|link|url|site)\b)|(?:sorry[,!.]? )?you have been blocked\b|attention required\b|just a moment\W*$|(?:cloudflare )?ray id\b|whitelabel error page|application error\b|err_[a-z_]+\b|(?:apache|nginx|openresty|iis)/\d[\d.]*|this (?:page|site) (?:isn't|isn’t|is not) working"
    rf"|the requested (?:url|resource|page|address)\b.{{0,80}}(?:not found|not available|could not|rejected|removed)|the server (?:encountered|returned|is (?:temporarily )?(?:unable|overloaded|busy)|didn't respond|did not respond)|(?:die|der) (?:angeforderte|gew(?:ü|ue)nschte) \w+ (?:konnte nicht|wurde nicht|ist nicht)|(?:(?:this|das|dieses) )?(?:video|content|tweet|post|inhalt) (?:is |ist )?(?:un|nicht )(?:available|verf(?:ü|ue)gbar)|wartungsarbeiten\W*$|wir f(?:ü|ue)hren (?:gerade|derzeit) wartungsarbeiten|(?:we(?:'re|’re| are)|site is) (?:currently |temporarily )?(?:down|undergoing) (?:for )?(?:scheduled )?maintenance"
    rf"|the link (?:you followed )?(?:may|might) be broken|(?:this|the|der|dieser) (?:service|server|site|dienst|website|seite) (?:is|was|ist|could not|cannot|encountered|has)\b.{{0,30}}(?:unavailable|unable to|overloaded|maintenance|nicht (?:verf(?:ü|ue)gbar|erreichbar)|(?:ü|ue)berlastet|wartung|complete your request|internal error|misconfiguration|down\b)|service (?:is )?(?:temporarily )?unavailable|down for maintenance|wegen wartung"
    rf"|slow down and retry|please (?:try again|come back|retry|reload|refresh)\b|(?:bitte )?versuchen sie es (?:sp(?:ä|ae)ter|erneut|noch)|bitte (?:versuchen|laden) sie\b|you (?:don't|do not) have (?:the )?(?:permission|access|rights)|sie haben keine (?:berechtigung|rechte)|(?:access|zugriff) (?:to this \w+ )?(?:is |has been |wurde |ist )?(?:denied|blocked|verweigert|gesperrt)"
    rf"|checking (?:your browser|if the site connection)|(?:please )?(?:verify|confirm|prove)(?: that)? you(?:'re| are) (?:a )?(?:human|not a robot)|(?:please )?complete the (?:captcha|security check)|(?:bitte )?best(?:ä|ae)tigen sie,? dass sie (?:ein mensch|kein roboter)|are you a (?:robot|human)\b|we(?:'ve| have) detected unusual traffic|unusual traffic from|ddos protection|one more step\W*$|performing security verification"
    rf"|(?:php )?(?:warning|fatal error|parse error|notice|deprecated)\s*:.{{0,120}}(?:\bline\b|\.php|/srv/|/var/|/home/|failed|undefined)|traceback\b|uncaught (?:\w+)?(?:error|exception)|exception in thread|segmentation fault|back-?end fetch failed|guru (?:ref|meditation)|error establishing a database|(?:sql|mysql|database)\s?(?:state|error|syntax|query failed|connection failed)|stack trace\s*:"
    rf"|(?:your|ihre|deine) (?:session|sitzung) (?:has |ist |wurde )?(?:expired|timed out|abgelaufen|beendet)|(?:we(?:'re| are)|wir haben) (?:having trouble|probleme) (?:loading|beim laden)|(?:we )?(?:could(?:n't| not)|can(?:'t|not)|unable to|failed to) (?:load|fetch|retrieve|display) (?:the|this|these|your|comments|content|page|data|more)\b)",
    re.I,
)
#: Notices that a page shows nothing without scripts.
_SCRIPT = re.compile(
    r"<noscript\b|^(?:please |you (?:need|have|must|will need) (?:to )?|to (?:use|view|see|continue|read).{0,40}|bitte )?(?:enable|activate|turn on|switch on|allow) (?:(?:\w+ ){0,3}?(?:and|&|or) )?(?:javascript|java script|scripts?|scripting|js)\b|^(?:it (?:looks|seems|appears).{0,20}|we(?:'ve| have) (?:detected|noticed) (?:that )?|your browser has )?(?:javascript|java script|scripts?|scripting|js)(?: \w+){0,2}? (?:is|are|must be|has to be|have to be|needs? to be|seems? to be|muss|m(?:ü|ue)ssen|ist|sind|wurde)(?: currently| aktuell| derzeit)? (?:disabled|blocked|required|not enabled|not supported|turned off|off|allowed|enabled|deaktiviert|blockiert|ausgeschaltet|erforderlich|aktiviert|n(?:ö|oe)tig|notwendig|abgeschaltet|eingeschaltet)"
    r"|^(?:\w+[ '-]){0,4}?\w+ (?:needs|requires|require|ben(?:ö|oe)tigt|ben(?:ö|oe)tigen|erfordert|braucht) (?:(?:\w+ ){0,3}?(?:and|und|&) )?(?:javascript|java script|scripts|skripte|scripting|js)\W*$|^(?:\w+[ '-]){0,4}?\w+ (?:needs|requires|ben(?:ö|oe)tigt|erfordert) (?:javascript|scripts|skripte|js) (?:to|um|zum|in|for|f(?:ü|ue)r)\b|^bitte (?:aktivieren|erlauben|schalten) sie (?:(?:\w+ ){0,3}?(?:und|oder) |\w+ )?(?:javascript|skripte)|^bitte (?:javascript|java script|skripte|js)\b.{0,30}(?:aktivieren|einschalten|erlauben|zulassen)|^(?:die|diese|unsere) \w+ (?:funktioniert|l(?:ä|ae)uft) (?:nur|nicht) (?:mit|ohne) (?:aktivierte\w? )?(?:javascript|skripte|js)\b|^(?:you need|you must|you have) .{0,20}(?:javascript|js) (?:enabled|turned on|switched on)|^(?:javascript|skripte) (?:bitte )?(?:aktivieren|einschalten|erlauben)"
    r"|^your browser (?:does not|doesn't|cannot|can't) (?:support|run) (?:javascript|scripts?)|^ihr browser (?:unterst(?:ü|ue)tzt|kann) (?:kein|keine) (?:javascript|skripte)|^(?:ohne|without) (?:aktiviertes? )?(?:javascript|scripts|skripte|scripting) (?:kann|k(?:ö|oe)nnen|funktioniert|ist|l(?:ä|ae)sst|this|the|you|some)\b|^switch to a supported browser\b|^(?:turn|switch) it on in your browser|^some parts of [\w ]{2,40} (?:will|may|do) not work\b",
    re.I,
)
#: Words beside a sign that is written about and not left over.
_MENTION = re.compile(
    r"\b(?:template files?|templates?|vorlagen?|prompts?|variables?|variablen?|braces|brackets|klammern|syntax|placeholders? (?:are|is|was|were|named|called|such)|such as|for example|e\.g\.|zum beispiel|z\. ?b\.|is replaced|are replaced|wird ersetzt|werden ersetzt|are filled|is filled|wird gef(?:ü|ue)llt|exporter|called|genannt|hei(?:ß|ss)t|macros?|environment|the word|das wort|printers|column|documentation|manual|handbuch|tutorial)\b",
    re.I,
)
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”“)]*\s+(?=\S)")
_LEAD = re.compile(r"^(?:[\s>*•·–—#|-]+|@[\w.-]+:\s*|https?://\S+\s*|(?:<(?!%|<|noscript)/?[a-z]+\d?\s*/?>\s*))+", re.I)
#: Cheap tests before a search in the midst of a sentence. Each follows from the pattern it stands before: a gap begins with
#: one of the signs, a hollow value is one of the words of _EMPTY, and a filler that need not begin the sentence holds one of
#: the words or six of the customary ones, and a notice names scripts, a browser or parts of a page. What else has to begin
#: the sentence is matched there, without a test before. Sentences that recur are judged once a worker.
_SIGN, _CAPITAL_SIGN = re.compile(r"[{\[~$<%&]|__|@@|\*\|"), re.compile(r"[$%]|MM|XX")
_HOLLOW_WORDS = ("undefined", "null", "none", "nan", "nil", "object object", "invalid date", "n/a")
_FILLER_WORDS = ("lorem ipsum dolor", "sed ut perspiciatis", "dies ist ein ", "sample text", "dummy text", "placeholder text", "filler text", "asd", "qwer", "jkl", "tktk", "tk tk", " here")
_LATIN_WORDS, _LATIN_SIGNS = frozenset(_LATIN.split()), ",.;:!?"
_SCRIPT_WORDS = ("script", "skript", "js", "browser", "some parts of")


def _folded(s: str) -> str:
    """``s`` in the letter case of the words above; patterns that ignore case take three more letters for i and s."""
    return s.lower() if s.isascii() else s.replace("İ", "i").lower().replace("ı", "i").replace("ſ", "s")


def _may_be_filler(low: str) -> bool:
    if any(w in low for w in _FILLER_WORDS):
        return True
    for c in _LATIN_SIGNS:
        low = low.replace(c, " ")
    return sum(map(_LATIN_WORDS.__contains__, low.split())) >= 6


def evidence(line: str) -> str | None:
    """The kind of evidence a line holds: 'gap', 'filler', 'error' or 'script'; None without any."""
    if not line:
        return None
    for s in _SENTENCE.split(line):
        s = _LEAD.sub("", s.strip()).strip()
        if s and (kind := _of_sentence(s)):
            return kind
    return None


@functools.lru_cache(maxsize=50_000)
def _of_sentence(s: str) -> str | None:
    low = _folded(s)
    if (_SIGN.search(s) or "placeholder" in low) and any(not _MENTION.search(s, max(0, m.start() - 60), m.end() + 45) for m in _GAP.finditer(s)):
        return "gap"
    if _CAPITAL_SIGN.search(s) and any(not _MENTION.search(s, max(0, m.start() - 60), m.end() + 45) for m in _CAPITAL_GAP.finditer(s)):
        return "gap"
    if any(w in low for w in _HOLLOW_WORDS) and _HOLLOW.search(s):
        return "gap"
    if (m := _FILLER.match(s) or (_may_be_filler(low) and _FILLER.search(s))) and not _MENTION.search(s, max(0, m.start() - 60), m.end() + 45):
        return "filler"
    if any(w in low for w in _SCRIPT_WORDS) and (_SCRIPT.match(s) or ("<noscript" in low and _SCRIPT.search(s))):
        return "script"
    if _ERROR.match(s):
        return "error"
    return None


def _kinds() -> Column:
    @F.pandas_udf("array<struct<at:int,kind:string>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [{"at": i, "kind": k} for i, x in enumerate(t.split("\n")) if (k := evidence(x))] if t else [])

    return found


def _line_key(host: Column, line: Column) -> Column:
    """What counts as the same line of a host: letter case, digits and white space do not matter."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\d+", "0"), r"\s+", " "))
    return F.when(F.length(plain) > 0, F.xxhash64(host, plain))


def boilerplate(docs: DataFrame, text: str, host: str, least: int = RECURRENT_DOCS, share: float = RECURRENT_SHARE) -> DataFrame:
    """(line): the keys of lines that recur on at least ``least`` documents and ``share`` of the documents of a host.

    Each document counts a line once. Only 8-byte keys are shuffled, counted on the map side first.
    """
    host_key = F.coalesce(F.col(host).cast("string"), F.lit(""))
    sizes = docs.groupBy(F.xxhash64(host_key).alias("host")).agg(F.count("*").alias("n_docs"))
    keys = F.array_distinct(F.transform(F.split(F.col(text), "\n"), lambda x: _line_key(host_key, x)))
    lines = docs.select(F.xxhash64(host_key).alias("host"), F.explode(keys).alias("line")).filter("line IS NOT NULL")
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return counts.join(sizes, "host").filter(F.col("n") >= F.col("n_docs") * F.lit(share)).select("line")


def residue(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", least: int = RECURRENT_DOCS, share: float = RECURRENT_SHARE) -> DataFrame:
    """(``key``, kinds): the documents with template residue, filler, error or script notices, and the kinds of them.

    Gaps, filler and errors count however often their line recurs, so these do not depend on the size of a host. A script
    notice in boilerplate of the host is subtracted, unless a document has fewer than RESIDUAL_WORDS words besides
    boilerplate: then the boilerplate is all its content, as on a blocking page that was stored many times. NULL and empty
    texts are no cases; NULL hosts are one host. Repeated documents are each reported. Texts are read whole.
    """
    host_key = F.coalesce(F.col(host).cast("string"), F.lit(""))
    marked = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("_key"), host_key.alias("_host"), F.col(text).alias("_text"))
    found = marked.withColumn("_found", _kinds()(F.col("_text"))).filter(F.size("_found") > 0).withColumn("_row", F.monotonically_increasing_id())
    cases = durable(
        found.select(
            "_key",
            "_row",
            F.transform(F.split("_text", "\n"), lambda x: F.struct(_line_key(F.col("_host"), x).alias("line"), F.size(F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("n_words"))).alias("_lines"),
            "_found",
        ),
        "evidence",
    )
    common = durable(boilerplate(docs, text, host, least, share).distinct(), "boilerplate")
    n_common = common.count()
    lines = cases.select("_key", "_row", F.posexplode("_lines").alias("at", "l"), "_found").select("_key", "_row", "l.line", "l.n_words", F.get(F.filter("_found", lambda x: x["at"] == F.col("at")), F.lit(0))["kind"].alias("kind"))
    known = lines.join(broadcast_if_small(common.withColumn("common", F.lit(True)), n_common), "line", "left")
    judged = known.groupBy("_row").agg(
        F.first("_key").alias(key),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.coalesce(F.bool_or(F.col("kind").isNotNull() & (F.col("common").isNull() | (F.col("kind") != "script"))), F.lit(False)).alias("own"),
        F.sum(F.when(F.col("common").isNull(), F.col("n_words")).otherwise(0)).alias("rest"),
    )
    return judged.filter(F.col("own") | (F.col("rest") < RESIDUAL_WORDS)).select(key, "kinds")

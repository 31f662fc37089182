"""Text helpers: tokens, counts, links, prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The terms of the lexicon detector.
LEXICON = [
    "untermensch", "subhuman", "vermin", "cockroaches", "parasites", "invasion", "invaders", "infestation", "ungeziefer",
    "gas the", "exterminate", "genocide", "kill all", "kill yourself", "kill every", "should be shot", "should be killed",
    "todesstrafe für", "erschießen", "vergasen", "auslöschen",
    "ausländer raus", "zurück in die wüste", "geht zurück", "rapefugee", "rapefugees", "go back to your country", "not your country",
    "konzentrationslager", "nazi kolonie", "antisemiten haben pech",
    "islamisierung", "umvolkung", "great replacement", "white genocide", "braunen horden", "die braunen",
]


def escape_like(s: str) -> str:
    """C4: a search text with the wildcards of LIKE taken literally."""
    return s.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_text(c: Column, search: str) -> Column:
    """substring search without letter case; wildcards are ordinary characters."""
    return F.coalesce(F.lower(c).contains(search.lower()), F.lit(False))


def has_text(c: Column) -> Column:
    """more than spaces (other white space counts as text)."""
    return F.length(F.trim(c)) > 0


def has_words(c: Column) -> Column:
    """more than white space of any kind."""
    return c.rlike(r"\S")


def long_enough(c: Column, least: int = 10) -> Column:
    """at least ``least`` characters between outer white space."""
    return F.length(F.regexp_replace(c, r"^\s+|\s+$", "")) >= least


def tokens(c: Column) -> Column:
    """Lower-case words with a leading # or @ kept, links as '<url>'; empty for NULL."""
    marked = F.lower(F.regexp_replace(c, r"https?://\S+", " urlplaceholdertoken "))
    found = F.regexp_extract_all(marked, F.lit(r"(?U)[#@]?\w+"), F.lit(0))
    return F.coalesce(F.transform(found, lambda t: F.when(t == "urlplaceholdertoken", F.lit("<url>")).otherwise(t)), F.array().cast("array<string>"))


def term_count(c: Column, terms: list[str]) -> Column:
    """How often any of ``terms`` occurs, without letter case and overlaps; 0 for NULL. At one place the earlier term counts."""
    pattern = "(?iu)(" + "|".join(map(re.escape, terms)) + ")"
    return F.coalesce(F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0))), F.lit(0))


def view_count(c: Column) -> Column:
    """C7: '1.2K' and '3M' as whole numbers; NULL for what is no count."""
    plain = F.upper(F.trim(c))
    factor = F.when(plain.endswith("K"), 1_000).when(plain.endswith("M"), 1_000_000).otherwise(1)
    value = F.regexp_extract(plain, r"^([0-9]+(?:\.[0-9]+)?)[KM]?$", 1)
    return F.when(value != "", F.floor(F.round(F.try_divide(value.try_cast("double") * factor, F.lit(1.0)), 6)).cast("long"))


def link_parts(c: Column) -> tuple[Column, Column]:
    """Channel and message id of a channel link, NULL without them."""
    path = r"^(?:https?://)?[^/]+/(?:s/)?([A-Za-z0-9_]+)(?:/([0-9]+))?"
    channel, number = F.regexp_extract(c, path, 1), F.regexp_extract(c, path, 2)
    return F.nullif(channel, F.lit("")), F.nullif(number, F.lit("")).try_cast("long")


def web_link(uri: Column, host: str = "https://example.org") -> Column:
    """The web address of a post's at:// URI; other URIs stay as they are."""
    parts = F.split(uri, "/")
    ok = uri.startswith("at://") & (F.size(parts) == 5) & F.coalesce(F.get(parts, F.lit(3)).endswith(".post"), F.lit(False))
    return F.when(ok, F.concat(F.lit(f"{host}/profile/"), F.get(parts, F.lit(2)), F.lit("/post/"), F.get(parts, F.lit(4)))).otherwise(uri)


def frame_kind(json: Column) -> Column:
    """C11: the kind of a sampling frame, NULL for broken JSON."""
    return F.when(F.try_parse_json(json).isNotNull(), F.get_json_object(json, "$.kind"))


def filled_prompt(template: str, text: Column, language: Column) -> Column:
    """C14: {{text}} is filled first, then {{language}}, also inside the text."""
    one = F.replace(F.lit(template), F.lit("{{text}}"), F.coalesce(text, F.lit("")))
    return F.replace(one, F.lit("{{language}}"), F.coalesce(language, F.lit("")))


def preview(c: Column, n: int = 60) -> Column:
    """C17: the first ``n`` characters."""
    return F.substring(c, 1, n)


def percent_interval(p: Column, low: Column, high: Column) -> Column:
    """C16: '12.3 % (10.1-14.9 %)', 'n/a' for NULL."""
    return F.coalesce(F.when(p.isNotNull(), F.format_string("%.1f %% (%.1f-%.1f %%)", p * 100, low * 100, high * 100)), F.lit("n/a"))


def frame_summary(c: Column) -> Column:
    """One line about a sampling frame (JSON): 'uniform random', or which filters are set.

    A frame that cannot be read says so. Days are written yyyy-MM-dd (UTC), whatever the device would show.
    """
    frame = F.from_json(c, "kind string, outletPK long, dateFrom double, dateTo double, minThreadReplies long, maxThreadReplies long")
    known = frame_kind(c)
    day = lambda x: F.date_format(F.timestamp_seconds(x + 978_307_200), "yyyy-MM-dd")
    def between(low: Column, high: Column, from_: str, until: str, unit: str) -> Column:
        both = F.when(low.isNotNull() & high.isNotNull(), F.concat(low, F.lit("–"), high, F.lit(unit)))
        return F.coalesce(both, F.concat(F.lit(from_), low, F.lit(unit)), F.concat(F.lit(until), high, F.lit(unit)))
    parts = F.array_compact(F.array(
        F.concat(F.lit("outlet #"), frame["outletPK"].cast("string")),
        between(day(frame["dateFrom"]), day(frame["dateTo"]), "from ", "until ", ""),
        between(frame["minThreadReplies"].cast("string"), frame["maxThreadReplies"].cast("string"), "≥", "≤", " replies/thread"),
    ))
    filtered = F.when(F.size(parts) > 0, F.concat(F.lit("filtered: "), F.array_join(parts, ", "))).otherwise(F.lit("filtered (no filters set)"))
    return F.when(known == "uniformRandom", F.lit("uniform random")).when(known == "filtered", filtered).otherwise(F.lit("unknown frame (failed to decode)"))

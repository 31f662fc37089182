"""HTML pages, review documents, CSV and Markdown."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.jsonl import write_atomic


class _Page(HTMLParser):
    """Messages of a channel page: blocks marked by class names, with their text, time, views, forward and media."""

    BLOCK, TEXT, VIEWS, FORWARD = "message", "message_text", "message_views", "message_forwarded"
    VOID = {"br", "img", "hr", "input", "meta", "link", "source"}

    def __init__(self):
        super().__init__()
        self.rows, self.open, self.row = [], [], None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        names = (a.get("class") or "").split()
        if "data-post" in a and self.BLOCK in names:
            channel, _, number = a["data-post"].partition("/")
            self.row = {"channel": channel, "msg_id": int(number) if number.isdigit() else None, "sent_at": None, "text": "", "views": "", "forward": None, "media": None}
            self.rows.append(self.row)
        if self.row is not None:
            if tag == "time" and a.get("datetime"):
                self.row["sent_at"] = a["datetime"]
            if self.FORWARD in names:
                self.row["forward"] = a.get("href")
            if tag in ("img", "video", "audio") and self.row["media"] is None:
                self.row["media"] = "photo" if tag == "img" else tag
            if tag == "br" and any(self.TEXT in n for n in self.open):
                self.row["text"] += "\n"
        if tag not in self.VOID:
            self.open.append(names)

    def handle_endtag(self, tag):
        if self.open and tag not in self.VOID:
            self.open.pop()

    def handle_data(self, data):
        if self.row is not None:
            if any(self.TEXT in n for n in self.open):
                self.row["text"] += data
            elif any(self.VIEWS in n for n in self.open):
                self.row["views"] += data.strip()


def page_messages(pages: DataFrame, html: str) -> DataFrame:
    """(channel, msg_id, sent_at, text, views, forward, media) of the messages on HTML pages; NULL pages have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf[html]:
                if text:
                    p = _Page()
                    p.feed(text)
                    rows += p.rows
            out = pd.DataFrame(rows, columns=["channel", "msg_id", "sent_at", "text", "views", "forward", "media"])
            yield out.astype({"msg_id": "Int64"})

    return pages.select(html).mapInPandas(run, "channel string, msg_id long, sent_at string, text string, views string, forward string, media string")


_HEAD = re.compile(r"^## (\S+)\s*$")
_FIELD = re.compile(r"^(class|severity|notes|reviewed):[ \t]*(.*?)\s*$")


def review_entries(spark: SparkSession, path: str) -> DataFrame:
    """(uri, class, severity, notes, reviewed) of a Markdown review: '## uri' begins an entry, whole lines 'field: value'
    fill it. Text that merely holds such words is no field, as a field takes the whole line from its start."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["value"]:
                entry = None
                for line in text.splitlines():
                    if m := _HEAD.match(line):
                        entry = {"uri": m[1], "class": None, "severity": None, "notes": None, "reviewed": False}
                        rows.append(entry)
                    elif entry is not None and (m := _FIELD.match(line)):
                        entry[m[1]] = m[2].lower() in ("yes", "true", "x") if m[1] == "reviewed" else (m[2] or None)
            yield pd.DataFrame(rows, columns=["uri", "class", "severity", "notes", "reviewed"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "uri string, class string, severity string, notes string, reviewed boolean")


def benchmark_uris(spark: SparkSession, path: str) -> DataFrame:
    """The URIs of a JSON array of entries."""
    return spark.read.option("multiLine", True).json(path).select("uri").filter("uri IS NOT NULL").distinct()


def imported_seeds(spark: SparkSession, path: str, existing: DataFrame) -> DataFrame:
    """The rows of a CSV whose username is new; of repeated usernames the first line."""
    rows = spark.read.csv(path, header=True, schema="username string, title string, source_list string").filter("username IS NOT NULL")
    once = rows.withColumn("_at", F.monotonically_increasing_id()).groupBy("username").agg(F.min_by("title", "_at").alias("title"), F.min_by("source_list", "_at").alias("source_list"))
    return once.join(existing.select("username"), "username", "left_anti")


def write_csv(df: DataFrame, path: str, comments: list[str], digits: int | None = None, most: int = 100_000) -> int:
    """A small result as one CSV with '#' lines on top; NULL is an empty cell. Larger results are refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: use the distributed writer")
    out = io.StringIO()
    for c in comments:
        out.write(f"# {c}\n")
    w = csv.writer(out, lineterminator="\n")
    w.writerow(df.columns)
    for r in rows:
        w.writerow(["" if v is None else f"{v:.{digits}f}" if digits is not None and isinstance(v, float) else v for v in r])
    write_atomic(path, out.getvalue())
    return len(rows)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with '#' lines on top."""
    return spark.read.csv(path, header=True, schema=schema, comment="#")


def markdown(df: DataFrame, title: str, caveats: list[str], most: int = 1000) -> str:
    """A small result as a Markdown table below its title and caveats."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows do not make a table to read")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"# {title}", "", *[f"> {c}" for c in caveats], "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"

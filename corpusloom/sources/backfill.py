"""Walks of message channels, page by page, that can be broken off and taken up again."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.channels import contiguous_top
from corpusloom.operators.model import messages as unique_messages
from corpusloom.sources.jsonl import write_atomic

#: Fetches one page: (channel, before) to rows with ``msg_id`` and what else a message has, all below ``before`` if given.
Fetch = Callable[[str, int | None], list[dict]]


class ChannelFolder:
    """Pages as JSON lines, one folder a channel, and beside them each channel's cursor and completion marker.

    A page is there whole or not at all. Pages that are fetched again repeat rows; messages() keeps the first of each
    (channel, msg_id). State is kept where the walk runs, on the driver.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        os.makedirs(path, exist_ok=True)

    def _at(self, channel: str) -> str:
        return f"{self.path}/channel={quote(channel, safe='')}"

    def state(self, channel: str) -> dict:
        try:
            with open(f"{self._at(channel)}/_state.json", encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return {"cursor": None, "complete": False}

    def keep(self, channel: str, **changes) -> None:
        os.makedirs(self._at(channel), exist_ok=True)
        write_atomic(f"{self._at(channel)}/_state.json", json.dumps(self.state(channel) | changes))

    def add(self, channel: str, rows: list[dict]) -> None:
        os.makedirs(self._at(channel), exist_ok=True)
        lines = "".join(json.dumps({"channel": channel, **r}, ensure_ascii=False) + "\n" for r in rows)
        write_atomic(f"{self._at(channel)}/page-{uuid.uuid4().hex}.json", lines)

    def stored(self) -> DataFrame:
        """All rows of all pages; reading by the folder's schema needs no listing of values."""
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "page-*.json").json(self.path)

    def messages(self) -> DataFrame:
        """The first fetch of each message."""
        return unique_messages(self.stored())

    def top(self, channel: str) -> int | None:
        """The last id of the unbroken block from the channel's least id, None without messages."""
        row = contiguous_top(self.stored().filter(F.col("channel") == channel)).first()
        return row["contiguous_top"] if row else None


def walk(folder: ChannelFolder, channel: str, fetch: Fetch, incremental: bool = False, max_pages: int | None = None, force: bool = False) -> dict:
    """Fetch a channel backwards, newest page first; what came of it: status, pages, new rows and why it failed.

    A backfill begins at the stored cursor, moves it after each page, and marks the channel when it comes to the end; a
    marked channel is skipped unless ``force``. An incremental walk begins at the newest page and goes back until it meets
    the unbroken block of stored messages, not merely until a page brings nothing new; a channel without messages has to be
    backfilled first. A page that does not go further back than the one before, and more than ``max_pages``, end the walk
    as failed, with all that was fetched kept. What ``fetch`` raises as OSError ends it likewise.
    """
    def said(status: str, why: str | None = None) -> dict:
        return {"channel": channel, "status": status, "pages": pages, "fetched": fetched, "failure": why}

    pages = fetched = 0
    state = folder.state(channel)
    before = None if incremental or force else state["cursor"]
    if not incremental and state["complete"] and before is None and not force:
        return said("skipped")
    top = folder.top(channel) if incremental else None
    if incremental and top is None:
        return said("failed", "no history: run a backfill first")
    while True:
        if max_pages is not None and pages >= max_pages:
            return said("failed", f"page budget exhausted ({max_pages})")
        try:
            rows = fetch(channel, before)
        except OSError as e:
            return said("failed", str(e))
        pages += 1
        if not rows:
            break
        folder.add(channel, rows)
        fetched += len(rows)
        oldest = min(r["msg_id"] for r in rows)
        if before is not None and oldest >= before:
            return said("failed", f"no progress: the page before {before} begins at {oldest}")
        before = oldest
        if not incremental:
            folder.keep(channel, cursor=oldest)
        if oldest <= 1 or (incremental and oldest <= top):
            break
    if not incremental:
        folder.keep(channel, cursor=None, complete=True)
    return said("complete")

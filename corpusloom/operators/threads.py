"""Threads as trees: order, height, layout, and nested payloads."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.hierarchy import paths
from corpusloom.operators.ranks import rank_within
from corpusloom.operators.skew import skew_join

#: The layout's width of a leaf, height of a level, and upper margin.
LEAF_WIDTH, LEVEL, MARGIN = 28, 48, 33


def children(p: DataFrame) -> DataFrame:
    """(zuri, child, place): the children of each post and their place by time; siblings of one time go by URI."""
    kids = p.filter("zparenturi IS NOT NULL").select(F.col("zparenturi").alias("zuri"), F.col("zuri").alias("child"), F.coalesce("created", F.lit(float("-inf"))).alias("_at"))
    return rank_within(kids, ["zuri"], ["_at", "child"], "place").drop("_at")


def thread(p: DataFrame, root: str) -> DataFrame:
    """A thread by its stored root, in order of time."""
    return p.filter(F.col("zrooturi") == root).orderBy(F.asc_nulls_first("created"), "zuri").select("zuri", "zparenturi", "created", "zdepth")


def heights(p: DataFrame) -> DataFrame:
    """T4: the height of each stored thread: its greatest stored depth and one."""
    return p.filter("zrooturi IS NOT NULL").groupBy("zrooturi").agg((F.coalesce(F.max("zdepth"), F.lit(0)) + 1).alias("height"), F.count("*").alias("n_posts"))


def flat_order(edges: DataFrame, key: str, parent: str, created: str) -> DataFrame:
    """Depth-first position of each post in its tree; siblings by (created, key). Cycles have no position.

    Nodes go by their time and key in one string while paths are doubled, so that a path is its own sort key and no path is
    ever taken apart. ``edges`` has one row for each key.
    """
    own = F.format_string("%020.3f|%s", F.coalesce(F.col(created), F.lit(0.0)) + F.lit(1e12), F.col(key))
    tagged = edges.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(parent).alias("p"), own.alias("id"))
    met = skew_join(tagged, tagged.select(F.col("k").alias("p"), F.col("id").alias("pid")), ["p"], "left")
    found = paths(met.select("id", "pid"), "id", "pid").filter("depth >= 0")
    placed = rank_within(found.select("node", "root", "depth", F.array_join("path", "\x01").alias("line")), ["root"], ["line"], "position")
    bare = lambda c: F.expr(f"substring({c}, locate('|', {c}) + 1)").alias(c)
    return placed.select(bare("node"), bare("root"), "depth", "position")


def of_class(flat: DataFrame, classes: DataFrame, wanted: str) -> DataFrame:
    """the posts of a flat order whose class is ``wanted``, at their place in the whole order.

    The filter comes after the walk: a post of another class hides itself and none of its children. classes: (node, class).
    """
    return flat.join(classes.filter(F.col("class") == wanted).select("node"), "node", "left_semi")


def layout(flat: DataFrame, edges: DataFrame, key: str, parent: str) -> DataFrame:
    """T5: x and y of each post: leaves LEAF_WIDTH apart in depth-first order, parents centred, LEVEL a depth."""
    inner = edges.select(F.col(parent).alias("node")).filter("node IS NOT NULL").distinct()
    ends = flat.join(inner, "node", "left_anti")
    leaf = rank_within(ends.select("node", "root", "position"), ["root"], ["position"], "leaf")
    spans = paths(edges.select(F.col(key).alias("k"), F.col(parent).alias("p")), "k", "p").filter("depth >= 0").select(F.col("node").alias("leaf_node"), F.explode("path").alias("node"))
    at = leaf.select(F.col("node").alias("leaf_node"), ((F.col("leaf") - F.lit(0.5)) * LEAF_WIDTH).alias("x"))
    ends = spans.join(at, "leaf_node").groupBy("node").agg(((F.min("x") + F.max("x")) / 2).alias("x"))
    return flat.join(ends, "node").select("node", "root", "x", (F.col("depth") * LEVEL + MARGIN).cast("double").alias("y"))


def flattened(payloads: DataFrame, column: str) -> DataFrame:
    """Nested thread payloads (JSON text) to rows (root, uri, parent, depth); depth counts from 0 below the root.

    The root itself is not stored again; nodes that are no posts contribute nothing, nor what hangs below them. Broken
    JSON gives no rows. The walk keeps its own stack, so any depth is fine.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf[column]:
                try:
                    top = json.loads(text)
                except (TypeError, ValueError):
                    continue
                post = top.get("post") if isinstance(top, dict) else None
                if not isinstance(post, dict) or not post.get("uri"):
                    continue
                stack = [(x, post["uri"], 0) for x in reversed(top.get("replies") or [])]
                while stack:
                    node, parent, depth = stack.pop()
                    own = node.get("post") if isinstance(node, dict) else None
                    if not isinstance(own, dict) or not own.get("uri"):
                        continue
                    rows.append((post["uri"], own["uri"], parent, depth))
                    stack += [(x, own["uri"], depth + 1) for x in reversed(node.get("replies") or [])]
            yield pd.DataFrame(rows, columns=["root", "uri", "parent", "depth"])

    return payloads.select(column).mapInPandas(walk, "root string, uri string, parent string, depth long")

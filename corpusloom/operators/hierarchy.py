"""Parent-child rows of unknown depth to full hierarchies, by pointer doubling.

Every node starts with a pointer to its parent. In each round an unresolved node looks up the node its pointer names
and takes over that node's pointer, so that the distance jumped doubles; it is resolved once it reaches a root. Among
unresolved nodes that lie above a root the shallowest is resolved in every round, so a round that resolves none proves
that all the rest lie in or below a cycle. Rounds: the logarithm of the greatest depth, and one more with cycles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.skew import digest, lookup_join, skew_join
from corpusloom.session import broadcast_if_small, durable

CYCLE = "cycle"


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def resolve(edges: DataFrame, key: str, parent: str, with_path: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """Resolved and unresolved nodes of ``edges`` by key digest, and the number of rounds.

    Resolved rows have (k1, k2, a1, a2, d): node, its root and the depth; with ``with_path`` also ``seg``, the keys from
    the root to the node. Unresolved rows (in or below a cycle) have the same columns, with a pointer into the cycle.
    """
    cols = [*digest(F.col(key), "k"), F.when(F.col(parent).isNotNull(), F.struct(*digest(F.col(parent), "a"))).alias("p")]
    if with_path:
        cols.append(F.col(key).alias("seg"))
    keyed = edges.filter(F.col(key).isNotNull()).select(*cols)
    named = keyed.groupBy("k1", "k2").agg(F.min("p").alias("p"), *([F.array(F.min("seg")).alias("seg")] if with_path else []))
    given = durable(named.select("k1", "k2", F.col("p.a1").alias("a1"), F.col("p.a2").alias("a2"), *(["seg"] if with_path else [])), "nodes")
    n_nodes = given.count()

    sought = given.filter("a1 IS NOT NULL").select("a1", "a2").distinct()
    absent = durable(sought.join(given.select(F.col("k1").alias("a1"), F.col("k2").alias("a2")), ["a1", "a2"], "left_anti"), "absent")
    n_absent = absent.count()
    lost = absent.withColumn("lost", F.lit(True))
    extra = ["seg"] if with_path else []
    pointed = lookup_join(given.filter("a1 IS NOT NULL"), absent.withColumn("ok", F.lit(True)), ["a1", "a2"], "left", n_absent, n_nodes)
    begun = _union([given.filter("a1 IS NULL").withColumn("ok", F.lit(True)), pointed.withColumn("ok", F.coalesce("ok", F.lit(False)))])
    own = [F.when(F.col("ok"), F.col(f"k{i}")).otherwise(F.col(f"a{i}")).alias(f"a{i}") for i in (1, 2)]
    start = durable(begun.select("k1", "k2", *own, F.when(F.col("ok"), 0).otherwise(1).cast("long").alias("d"), "ok", *extra), "start")
    done, active = [start.filter("ok").drop("ok")], start.filter("NOT ok").drop("ok")
    n_active, size = _extent(active, with_path)
    rounds = 0
    while n_active:
        rounds += 1
        flagged = _union([x.withColumn("ok", F.lit(True)) for x in done] + [active.withColumn("ok", F.lit(False))])
        look = flagged.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"), F.col("d").alias("e"), "ok", *([F.col("seg").alias("above")] if with_path else []))
        small = broadcast_if_small(active, n_active, size=size)
        met = look.join(small, ["a1", "a2"]) if small is not active else skew_join(active, look, ["a1", "a2"], "inner", n_active)
        step = durable(
            met.select("k1", "k2", F.col("b1").alias("a1"), F.col("b2").alias("a2"), (F.col("d") + F.col("e")).alias("d"), "ok", *([F.concat("above", "seg").alias("seg")] if with_path else [])),
            f"round{rounds}",
        )
        rest = step.filter("NOT ok").drop("ok")
        n_left, size = _extent(rest, with_path)
        if n_left == n_active:
            break
        done.append(step.filter("ok").drop("ok"))
        active, n_active = rest, n_left
    return _union(done), active, rounds


def _extent(active: DataFrame, with_path: bool) -> tuple[int, int]:
    """Rows of ``active`` and the bytes of their paths."""
    width = F.sum(F.octet_length(F.array_join("seg", "")) + 16 * F.size("seg")) if with_path else F.lit(0)
    row = active.agg(F.count("*"), width).first()
    return row[0], row[1] or 0


def _named(edges: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """``found`` with the key itself, one row for each."""
    keys = edges.filter(F.col(key).isNotNull()).select(F.col(key).alias("node"), *digest(F.col(key), "k"))
    return keys.join(found, ["k1", "k2"]).dropDuplicates(["k1", "k2"])


def roots_and_depths(edges: DataFrame, key: str, parent: str) -> DataFrame:
    """(``node``, ``root``, ``depth``): one row for each distinct ``key`` of ``edges``.

    ``key`` and ``parent`` hold normalised values; a NULL parent, or one that is no key, makes a root (depth 0, its own
    root). Nodes in a cycle or below one have root 'cycle' and depth -1; a node that names itself is a cycle. Rows with
    a NULL key are no nodes. A key delivered more than once counts once, with the parent of the least digest where the
    deliveries disagree and one that names a parent before one that names none. Empty input gives no rows; other
    columns of ``edges`` are not read.
    """
    done, cyclic, _ = resolve(edges, key, parent)
    done = done.withColumn("cyclic", F.lit(False))
    found = _named(edges, key, done.unionByName(cyclic.withColumn("cyclic", F.lit(True))))
    tops = done.filter("d = 0").select("k1", "k2")
    n_tops = tops.count()
    names = edges.filter(F.col(key).isNotNull()).select(F.col(key).alias("root"), *digest(F.col(key), "k"))
    top_names = names.join(broadcast_if_small(tops, n_tops), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).withColumnsRenamed({"k1": "a1", "k2": "a2"})
    below = lookup_join(found.filter("NOT cyclic AND d > 0").select("node", "a1", "a2", "d"), top_names, ["a1", "a2"], "inner", n_tops)
    rest = found.filter("cyclic OR d = 0").select(
        "node", F.when(F.col("cyclic"), F.lit(CYCLE)).otherwise(F.col("node")).alias("root"), F.when(F.col("cyclic"), -1).otherwise(F.col("d")).cast("long").alias("depth")
    )
    return below.select("node", "root", F.col("d").alias("depth")).unionByName(rest)


def paths(edges: DataFrame, key: str, parent: str) -> DataFrame:
    """(``node``, ``root``, ``depth``, ``path``): as roots_and_depths, with the keys from the root down to the node.

    The path of a node in or below a cycle is NULL. A path is as long as the node is deep.
    """
    done, cyclic, _ = resolve(edges, key, parent, with_path=True)
    open_ended = _named(edges, key, cyclic.select("k1", "k2")).select("node", F.lit(CYCLE).alias("root"), F.lit(-1).cast("long").alias("depth"), F.lit(None).cast("array<string>").alias("path"))
    return done.select(F.element_at("seg", -1).alias("node"), F.element_at("seg", 1).alias("root"), F.col("d").alias("depth"), F.col("seg").alias("path")).unionByName(open_ended)


def descendants(found: DataFrame) -> DataFrame:
    """(``node``, ``descendant``, ``distance``) for each node above another; ``found`` is the result of paths().

    As many rows as the depths add up to, made from each path alone, without a join.
    """
    up = found.filter("depth > 0").select(F.col("node").alias("descendant"), "depth", F.posexplode(F.slice("path", 1, F.col("depth").cast("int"))).alias("at", "node"))
    return up.select("node", "descendant", (F.col("depth") - F.col("at")).alias("distance"))

"""What changed between full snapshots, by invertible Bloom lookup tables.

The rows of a delivery are spread over hash buckets; each bucket becomes a table of cells that hold a count and the XOR
of key hashes, row hashes and check hashes. Such cells combine on the map side, so what is shuffled depends on the
number of cells and not of rows. The tables of two deliveries subtract to one of only the differing rows, which is
peeled: a cell with a single row gives it away and frees other cells. How many cells a bucket starts with follows from
how much the rows of one stratum of hashes differ. Buckets that do not peel are built again with more cells; what still
resists after ROUNDS is compared row by row. A row is known by two independent hashes, of its key and of key and value
under another seed; recovered rows get their keys back before they are classified.
"""

from __future__ import annotations

import math
import struct

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.uri import normal_uri, strip
from corpusloom.session import broadcast_if_small, durable

#: Rows of a delivery in a bucket, sub-tables, the growth of failed buckets.
BUCKET_ROWS, TABLES, GROWTH, ROUNDS = 20_000, 3, 4, 4
#: One of STRATA rows is compared to estimate how many differ; a bucket starts with CELLS_PER_ROW cells for each of those.
STRATA, CELLS_PER_ROW = 64, 1.5

PEELED = "pair int, bucket int, h long, v long, side int, ok boolean"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _xx(a: int, b: int) -> int:
    """Spark's xxhash64 of two longs."""
    return xxhash.xxh64_intdigest(struct.pack("<q", b), seed=xxhash.xxh64_intdigest(struct.pack("<q", a), seed=42))


def _place(h: int, v: int, t: int, cells: int) -> int:
    return _signed(_xx(h ^ v, t)) % cells


def peel(cells: pd.DataFrame, m: int) -> tuple[list[tuple[int, int, int]], bool]:
    """(key hash, row hash, side) of every row in the subtracted ``cells``, and whether the table was emptied.

    Side is 1 for rows of the later delivery and -1 for those of the earlier one.
    """
    at = {(int(t), int(c)): [int(n), int(h), int(v), int(k)] for t, c, n, h, v, k in cells[["t", "cell", "n", "hs", "vs", "ks"]].itertuples(index=False)}
    ready, found = list(at), []
    while ready:
        cell = at.get(ready.pop())
        if not cell or abs(cell[0]) != 1 or _signed(_xx(cell[1], cell[2])) != cell[3]:
            continue
        side, h, v, k = cell
        found.append((h, v, side))
        for t in range(TABLES):
            place = (t, _place(h, v, t, m))
            other = at.setdefault(place, [0, 0, 0, 0])
            other[0] -= side
            other[1] ^= h
            other[2] ^= v
            other[3] ^= k
            ready.append(place)
        if len(found) > 4 * m * TABLES:
            return [], False
    return found, all(not any(c) for c in at.values())


def _peeler(m: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pair, bucket = int(pdf["pair"].iloc[0]), int(pdf["bucket"].iloc[0])
        found, ok = peel(pdf, m)
        rows = [(pair, bucket, h, v, s, True) for h, v, s in found] if ok else [(pair, bucket, 0, 0, 0, False)]
        return pd.DataFrame(rows, columns=["pair", "bucket", "h", "v", "side", "ok"]).astype({"pair": "int32", "bucket": "int32", "h": "int64", "v": "int64", "side": "int32", "ok": "bool"})

    return run


def _cells(base: DataFrame, sides: DataFrame, m: int) -> DataFrame:
    """The subtracted, non-empty cells of each pair and bucket."""
    places = F.array(*[F.struct(F.lit(t).alias("t"), F.pmod(F.xxhash64(F.col("h").bitwiseXOR(F.col("v")), F.lit(t).cast("long")), F.lit(m)).alias("cell")) for t in range(TABLES)])
    one = base.select("delivery", "bucket", "h", "v", F.xxhash64("h", "v").alias("k"), F.explode(places).alias("p")).select("delivery", "bucket", "h", "v", "k", "p.t", "p.cell")
    sums = [F.count("*").alias("n"), F.bit_xor("h").alias("hs"), F.bit_xor("v").alias("vs"), F.bit_xor("k").alias("ks")]
    held = one.groupBy("delivery", "bucket", "t", "cell").agg(*sums)
    both = held.join(F.broadcast(sides), "delivery")
    diff = both.groupBy("pair", "bucket", "t", "cell").agg(F.sum(F.col("n") * F.col("side")).alias("n"), *[F.bit_xor(c).alias(c) for c in ("hs", "vs", "ks")])
    return diff.filter("n <> 0 OR hs <> 0 OR vs <> 0 OR ks <> 0")


def latest_rows(snapshots: DataFrame, delivery: str, key: str, value: str, loaded: str) -> DataFrame:
    """(delivery, key, value): of each key in a delivery the row loaded last; of ties the greatest value."""
    rows = snapshots.filter(F.col(key).isNotNull() & F.col(delivery).isNotNull())
    last = rows.groupBy(F.col(delivery).alias("delivery"), F.col(key).alias("key")).agg(F.max(F.struct(F.col(loaded), F.col(value).alias("value"))).alias("last"))
    return last.select("delivery", "key", F.col("last.value").alias("value"))


def _differing(base: DataFrame, sides: DataFrame) -> DataFrame:
    """(pair, bucket, h, v, side): the rows that only one of two deliveries has, by comparing all of ``base``."""
    signed = base.join(F.broadcast(sides), "delivery")
    return signed.groupBy("pair", "bucket", "h", "v").agg(F.sum("side").cast("int").alias("side")).filter("side <> 0")


def first_cells(base: DataFrame, sides: DataFrame, buckets: int) -> int:
    """Cells of a sub-table with which nearly all buckets peel, from the differences within one stratum of row hashes.

    The estimate is for the pair of deliveries that differ most, raised by the chance errors of the stratum and of a bucket.
    """
    stratum = base.filter(F.pmod(F.xxhash64(F.col("h").bitwiseXOR(F.col("v")), F.lit(9)), F.lit(STRATA)) == 0)
    most = _differing(stratum, sides).groupBy("pair").count().agg(F.max("count")).first()[0] or 0
    each = STRATA * (most + 2 * math.sqrt(most) + 2) / buckets
    return math.ceil(CELLS_PER_ROW * (each + 3 * math.sqrt(each)) / TABLES)


def snapshot_changes(snapshots: DataFrame, delivery: str, key: str, value: str, loaded: str, cells: int | None = None) -> DataFrame:
    """(``delivery``, ``key``, ``change``): what was 'added', 'removed' or 'changed' from each delivery to the next.

    ``key`` and ``value`` hold normalised values. NULL is a value like others; rows with a NULL key or delivery are left
    out. Of repeated keys in a delivery the one loaded last counts. Deliveries follow each other by their own order; the
    first has no changes. Fewer than two deliveries, or no rows, give no changes. Other columns are not read. ``cells``, of
    each sub-table of a bucket to begin with, are estimated where not given.
    """
    spark = snapshots.sparkSession
    dates = [r[0] for r in snapshots.select(delivery).distinct().filter(F.col(delivery).isNotNull()).orderBy(delivery).collect()]
    kind = snapshots.schema[delivery].dataType.simpleString()
    out = f"delivery {kind}, key string, change string"
    if len(dates) < 2:
        return spark.createDataFrame([], out)
    rows = latest_rows(snapshots, delivery, key, value, loaded)
    buckets = max(1, -(-snapshots.count() // (len(dates) * BUCKET_ROWS)))
    hashed = rows.select("delivery", "key", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(13), "key", F.coalesce("value", F.lit("\0null"))).alias("v"))
    # the keys are written along, so that rows are shuffled once; what only needs hashes does not read them
    base = durable(hashed.withColumn("bucket", F.pmod(F.xxhash64(F.col("h"), F.lit(5)), F.lit(buckets)).cast("int")), "rows")
    side_rows = [(d, i, 1) for i, d in enumerate(dates) if i] + [(d, i + 1, -1) for i, d in enumerate(dates[:-1])]
    sides = spark.createDataFrame(side_rows, f"delivery {kind}, pair int, side int")
    digests = durable(_digests(base, sides), "digests")

    parts, todo, source = [], None, base
    m = cells or first_cells(base, sides, buckets)
    for again in range(ROUNDS):
        diff = _cells(source, sides, m)
        if todo is not None:
            diff = diff.join(todo, ["pair", "bucket"], "left_semi")
        peeled = durable(diff.groupBy("pair", "bucket").applyInPandas(_peeler(m), PEELED), f"peeled{again}")
        checked = durable(_checked(peeled, digests, todo), f"checked{again}")
        parts.append(peeled.filter("ok").join(checked.filter("same"), ["pair", "bucket"], "left_semi").select("pair", "h", "v", "side"))
        left = checked.filter("NOT same").select("pair", "bucket")
        n_left = left.count()
        if not n_left:
            break
        todo = broadcast_if_small(left, n_left)
        source = base.join(todo.select("bucket"), "bucket", "left_semi")
        m *= GROWTH
    else:
        parts.append(_differing(source, sides).join(todo, ["pair", "bucket"], "left_semi").select("pair", "h", "v", "side"))
    recovered = parts[0]
    for part in parts[1:]:
        recovered = recovered.unionByName(part)
    order = spark.createDataFrame(list(enumerate(dates)), f"at int, delivery {kind}")
    wanted = durable(recovered.withColumn("at", F.when(F.col("side") > 0, F.col("pair")).otherwise(F.col("pair") - 1)).join(F.broadcast(order), "at").drop("at"), "recovered")
    named = base.select("delivery", "key", "h", "v").join(broadcast_if_small(wanted, wanted.count()), ["delivery", "h", "v"])
    change = F.when(F.min("side") > 0, "added").when(F.max("side") < 0, "removed").otherwise("changed")
    later = order.withColumnsRenamed({"at": "pair"})
    return named.groupBy("pair", "key").agg(change.alias("change")).join(F.broadcast(later), "pair").select("delivery", "key", "change")


_OWN = (1 << 40) - 1


def _own() -> Column:
    """A hash of a row that the cells do not hold."""
    return F.xxhash64(F.col("v"), F.col("h"), F.lit(3)).bitwiseAND(F.lit(_OWN))


def _digests(base: DataFrame, sides: DataFrame) -> DataFrame:
    """(pair, bucket, digest): by how much the sums of the rows' own hashes differ; one partial sum a bucket is shuffled."""
    sums = base.groupBy("delivery", "bucket").agg(F.sum(_own()).alias("c")).join(F.broadcast(sides), "delivery")
    return sums.groupBy("pair", "bucket").agg(F.sum(F.col("c") * F.col("side")).alias("digest"))


def _checked(peeled: DataFrame, digests: DataFrame, todo: DataFrame | None) -> DataFrame:
    """(pair, bucket, same): whether the peeled rows have the digest by which the two deliveries differ."""
    true = digests if todo is None else digests.join(todo, ["pair", "bucket"], "left_semi")
    got = peeled.groupBy("pair", "bucket").agg(F.sum(F.when(F.col("ok"), _own() * F.col("side")).otherwise(F.lit(0))).alias("got"), F.min("ok").alias("ok"))
    both = true.join(got, ["pair", "bucket"], "left")
    return both.select("pair", "bucket", (F.coalesce("ok", F.lit(True)) & (F.coalesce("got", F.lit(0)) == F.col("digest"))).alias("same"))


def status(c):
    """A status as it is compared: without outer blanks, in lower case; NULL stays NULL."""
    return F.lower(strip(c))


def post_snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """snapshot_changes of the root-post deliveries: URIs in plain spelling, statuses without case and outer blanks."""
    plain = snapshots.select("snapshot_date", normal_uri(F.col("zuri")).alias("uri"), status(F.col("zreplytreestatus")).alias("status"), "exported_at")
    return snapshot_changes(plain, "snapshot_date", "uri", "status", "exported_at")

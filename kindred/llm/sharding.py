"""Shards of near-equal bytes by Karmarkar-Karp differencing of indivisible groups.

Groups (equal texts) fall into `parcels` by a hash of their text; a group heavy enough to unbalance a parcel becomes an item of
its own. So the items are at most 2 * parcels, whatever the number of rows, and their differencing is done on the driver:
the two partial partitions of largest spread are combined, oppositely ordered, until one is left.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import written


def difference(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item. A partial partition is a list of `shards` (sum, items), largest sum first; ties go by age."""
    if not sizes:
        return []
    heap = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [(size, (i, None, None))] + [(0, None)] * (shards - 1)))
    heapq.heapify(heap)
    age = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = sorted(((x + y, (None, s, t) if s and t else s or t) for (x, s), (y, t) in zip(a, reversed(b), strict=True)), key=lambda z: -z[0])
        low = both[-1][0]
        both = [(x - low, s) for x, s in both]
        heapq.heappush(heap, (-both[0][0], age, both))
        age += 1
    out = [0] * len(sizes)
    for shard, (_, items) in enumerate(heap[0][2]):
        todo = [items] if items else []
        while todo:
            item, left, right = todo.pop()
            if item is not None:
                out[item] = shard
            todo += [x for x in (left, right) if x]
    return out


def group_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def plan(rows: DataFrame, shards: int, parcels: int) -> DataFrame:
    """A small table (parcel, heavy, shard): heavy is the group's hash, or null for the rest of the parcel.

    rows has size and g, the group's hash. At most `parcels` groups have a share of 1 / parcels of all bytes or more.
    """
    parcel = F.pmod("g", F.lit(parcels)).cast("int").alias("parcel")
    sums = rows.groupBy(parcel).agg(F.sum("size").alias("z")).toPandas()
    limit = int(sums.z.sum()) // parcels + 1
    large = [int(x) for x in sums.parcel[sums.z >= limit]]
    # only parcels that can hold a heavy group are grouped by text
    heavy = rows.select("g", "size", parcel).where(F.col("parcel").isin(large)).groupBy("parcel", "g").agg(F.sum("size").alias("z")).where(F.col("z") >= limit).toPandas()
    left = dict(zip(sums.parcel.tolist(), sums.z.tolist(), strict=True))
    for p, z in zip(heavy.parcel.tolist(), heavy.z.tolist(), strict=True):
        left[p] -= z
    items = [(p, g, z) for p, g, z in zip(heavy.parcel.tolist(), heavy.g.tolist(), heavy.z.tolist(), strict=True)] + [(p, None, z) for p, z in sorted(left.items())]
    items.sort(key=lambda x: (-x[2], x[0], x[1] or 0))
    where = difference([z for _, _, z in items], shards)
    return rows.sparkSession.createDataFrame([(p, g, s) for (p, g, _), s in zip(items, where, strict=True)], "parcel int, heavy long, shard int")


def sharded(docs: DataFrame, shards: int = 16, parcels: int = 4096, rows_per_bucket: int = 50_000) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Equal texts are one group and share a shard, so a group of more than 1 / shards of all bytes makes its shard larger by as much.
    A null text has no bytes, as an empty one, and is in its group; its checksum is 0. Slots run from 0 without a gap in each
    shard; they are numbered by bucket, so that no task holds a whole shard. Repeated rows have slots of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), group_of(F.col("text")).alias("g"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "sizes")
    places = plan(rows, shards, parcels)  # at most 2 * parcels rows
    own = F.broadcast(places.where("heavy is not null").select("heavy", F.col("shard").alias("own_shard")))
    rest = F.broadcast(places.where("heavy is null").select("parcel", "shard"))
    placed = rows.withColumn("parcel", F.pmod("g", F.lit(parcels)).cast("int")).join(own, F.col("g") == F.col("heavy"), "left").join(rest, "parcel", "left")
    buckets = max(1, -(-rows.count() // rows_per_bucket)) * 8
    placed = placed.select("doc_id", "size", "text_crc32", F.coalesce("own_shard", "shard").alias("shard"), "row", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int").alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = placed.withColumn("k", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("row"))).join(first, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

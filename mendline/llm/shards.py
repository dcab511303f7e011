"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form a group. Groups, largest first, each enter the shard with the tightest remaining capacity that
still holds them, found in a list kept in order; the capacity is the smallest one, by bisection, for which the wanted
number of shards is enough.

Only large groups, above 1/`LARGE` of all bytes, are items of their own; there are fewer than `LARGE` of them. The others are
gathered in `BUNDLES` bundles by their texts' digest, and a bundle is one item. So the packing sees at most
LARGE + BUNDLES + PIECES * shards items whatever the input, and the table of their shards is broadcast. A group above a shard's even
share of the bytes can't be held by one shard while sizes stay near equal: its rows are dealt out in pieces by identifier.

Rows are numbered within a shard without gathering a shard in one task: by parts of bounded number, from running counts of the parts.

Null text has no bytes and forms a group with the empty one. Rows with equal identifiers and texts are numbered each on its own,
their order among each other being arbitrary. Extra columns are dropped. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window, functions as F

from mendline.sources.io import stored

LARGE, BUNDLES, PIECES = 4096, 16_384, 256
#: Parts in which the rows of a shard are numbered.
PARTS = 512


def best_fit(items: list[tuple[int, int]], capacity: int) -> list[tuple[int, int]]:
    """(item, bin) for items of (size, item), largest first; a new bin is opened where no open one has room."""
    rest: list[tuple[int, int]] = []  # remaining capacity and bin, ascending
    out = []
    opened = 0
    for size, item in sorted(items, key=lambda x: (-x[0], x[1])):
        at = bisect_left(rest, (size, -1))
        if at < len(rest):
            left, number = rest.pop(at)
        else:
            left, number = max(capacity, size), opened
            opened += 1
        insort(rest, (left - size, number))
        out.append((item, number))
    return out


def pack_into(items: list[tuple[int, int]], shards: int) -> list[tuple[int, int]]:
    """Best fit with the smallest capacity found for which at most `shards` bins are opened."""
    total, largest = sum(s for s, _ in items), max((s for s, _ in items), default=0)
    low, high = max(largest, -(-total // shards)), max(largest, total)
    best = best_fit(items, high)
    while low < high:
        middle = (low + high) // 2
        found = best_fit(items, middle)
        if max((b for _, b in found), default=0) < shards:
            best, high = found, middle
        else:
            low = middle + 1
    return best


def shard(df: DataFrame, shards: int, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row; size is the text's bytes plus one."""
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = df.select(F.col(id_col), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
                     F.unhex(F.sha2(raw, 256)).alias("sha"))
    rows = stored(rows, "shard-rows")
    groups = stored(rows.groupBy("sha").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    # Fewer than LARGE groups; those above an even share of a shard, fewer than `shards`, in PIECES pieces each.
    large = (groups.where(F.col("bytes") * LARGE > total)
             .select("sha", F.when(F.col("bytes") * shards > total, PIECES).otherwise(1).alias("pieces")))
    bundle = F.pmod(F.xxhash64("sha"), F.lit(BUNDLES)).cast("int")
    item = F.when(F.col("pieces").isNull(), F.lit(None).cast("binary")).otherwise(F.col("sha"))
    part = F.when(F.col("pieces").isNull(), bundle).otherwise(F.pmod(F.xxhash64(id_col), F.col("pieces")).cast("int"))
    itemised = rows.join(F.broadcast(large), "sha", "left").select(
        id_col, "size", "text_crc32", item.alias("item"), part.alias("item_part"))
    # At most LARGE + BUNDLES + PIECES * shards rows.
    sizes = itemised.groupBy("item", "item_part").agg(F.sum("size").alias("bytes")).orderBy("item", "item_part").collect()
    placed = pack_into([(r.bytes, i) for i, r in enumerate(sizes)], shards)
    spark = df.sparkSession
    where = spark.createDataFrame([(sizes[i].item, sizes[i].item_part, b) for i, b in placed], "w_item binary, w_part int, shard int")
    sharded = itemised.join(F.broadcast(where), F.col("item").eqNullSafe(F.col("w_item")) & (F.col("item_part") == F.col("w_part")))
    return numbered(sharded.select(id_col, "size", "text_crc32", "shard"), id_col)


def numbered(rows: DataFrame, id_col: str) -> DataFrame:
    """Add slot: gapless from 0 within each shard."""
    rows = stored(rows.withColumn("nth", F.pmod(F.xxhash64(id_col), F.lit(PARTS)).cast("int")), "shard-placed")
    before = Window.partitionBy("shard").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    # At most PARTS rows a shard.
    starts = rows.groupBy("shard", "nth").count().select(
        "shard", "nth", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "nth").orderBy(F.col(id_col).asc_nulls_last())
    return (rows.withColumn("at", F.row_number().over(within) - 1).join(F.broadcast(starts), ["shard", "nth"])
            .withColumn("slot", (F.col("first") + F.col("at")).cast("long")).drop("nth", "at", "first"))

"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Rows with equal text form a group that stays whole.  Groups above ``total / (shards *
FINE)`` bytes are single items (so there are at most ``shards * FINE``); all smaller groups are
dealt by hash into ``GRAINS`` grains, each one item.  The number of items is therefore bounded
whatever the size of the table, and the items are what is differenced on the driver: the two
partial partitions with the largest spread are combined, the largest part of one with the
smallest of the other, until one is left.  Item sums are made, and shards are given to the rows,
by aggregations and joins.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.session import materialize

SHARDS = 16
FINE, GRAINS = 256, 8192
#: Rows numbered by one sort, about.
SLOT_ROWS = 2000


def difference(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item by largest differencing."""
    if not sizes:
        return []
    # a partial partition: parts as (sum, tree of items), largest first; trees are item or pair
    heap = []
    for item, size in enumerate(sizes):
        parts = [(size, item)] + [(0, None)] * (shards - 1)
        heapq.heappush(heap, (-size, item, parts))
    order = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        parts = [
            (x + y, t if u is None else u if t is None else (t, u)) for (x, t), (y, u) in zip(a, reversed(b))
        ]
        parts.sort(key=lambda p: -p[0])
        least = parts[-1][0]
        parts = [(x - least, t) for x, t in parts]
        heapq.heappush(heap, (-parts[0][0], order, parts))
        order += 1
    out = [0] * len(sizes)
    for shard, (_, tree) in enumerate(heap[0][2]):
        todo = [] if tree is None else [tree]
        while todo:
            t = todo.pop()
            if isinstance(t, tuple):
                todo += t
            else:
                out[t] = shard
    return out


RESULT = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def assign(docs: DataFrame, shards: int = SHARDS, name: str = "shards") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row per row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 1; a null text has no bytes and is in the group of
    the empty text.  The law is ``bytes``; ``grown_shard`` is null.  Slots number a shard's rows
    from 0 in an order fixed by id and text.  A group larger than a shard's share stays whole, as
    groups are indivisible.  Further columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(
        docs.select(
            "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"),
        ),
        f"{name}-rows",
    )
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    groups = materialize(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes")), f"{name}-groups")
    limit = (total or 0) // (shards * FINE)
    large = [(r["h1"], r["h2"], r["bytes"]) for r in groups.where(F.col("bytes") > limit).orderBy("h1", "h2").collect()]
    grain = F.pmod(F.col("h1"), F.lit(GRAINS))
    small = groups.where(F.col("bytes") <= limit).groupBy(grain.alias("grain")).agg(F.sum("bytes").alias("bytes")).orderBy("grain").collect()
    shard_of = difference([g[2] for g in large] + [r["bytes"] for r in small], shards)
    of_large = spark.createDataFrame([(a, b, s) for (a, b, _), s in zip(large, shard_of)], "h1 bigint, h2 bigint, own int")
    of_grain = spark.createDataFrame([(r["grain"], s) for r, s in zip(small, shard_of[len(large) :])], "grain bigint, dealt int")
    placed = (
        rows.join(F.broadcast(of_large), ["h1", "h2"], "left")  # at most shards * FINE rows
        .withColumn("grain", grain).join(F.broadcast(of_grain), "grain", "left")  # at most GRAINS rows
        .withColumn("shard", F.coalesce("own", "dealt"))
        .withColumn("lane", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(max(1, count // (shards * SLOT_ROWS)))))
        .select("doc_id", "size", "text_crc32", "shard", "lane")
    )
    placed = materialize(placed, f"{name}-placed")
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = placed.groupBy("shard", "lane").agg(F.count("*").alias("n")).select("shard", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "lane").orderBy("doc_id", "text_crc32", "size"))
    return placed.withColumn("k", within).join(lanes, ["shard", "lane"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("k") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

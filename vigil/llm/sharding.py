"""Byte-balanced shards by Karmarkar-Karp differencing over indivisible groups.

Equal texts are one group and stay together.  Groups above 1/``packets`` of all
bytes are items of their own; the rest are bundled by hash into ``packets``
items, so the differencing sees at most 2 x ``packets`` items whatever the
corpus size.  It keeps a heap of partial partitions (a byte sum and a set of
items per shard) and repeatedly merges the two with the largest spread, the
heaviest shard of one with the lightest of the other.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import crc32_of, read_table, saved, text_of

SHARDS = 24
PACKETS = 8192
#: Rows that one window task numbers within an item.
UNIT_ROWS = 4000
#: Bytes of a row beside its text.
ROW_BYTES = 8


def karmarkar_karp(sizes: np.ndarray, ways: int) -> np.ndarray:
    """The part (0 to ways-1) of each item; ties go by item order, so the result is a function of ``sizes``."""
    n = len(sizes)
    part = np.zeros(n, np.int32)
    if not n:
        return part
    # A partial partition: sums (ascending, least is 0) and, per part, the root of a linked list of items.
    head, tail, after = np.arange(n), np.arange(n), np.full(n, -1)
    heap = []
    for i, size in enumerate(sizes.tolist()):
        heap.append((-size, i, [0] * (ways - 1) + [size], [-1] * (ways - 1) + [i]))
    heapq.heapify(heap)
    stamp = n
    while len(heap) > 1:
        _, _, sums_a, sets_a = heapq.heappop(heap)
        _, _, sums_b, sets_b = heapq.heappop(heap)
        merged = []
        for sa, ra, sb, rb in zip(sums_a, sets_a, reversed(sums_b), reversed(sets_b)):
            if ra < 0:
                ra = rb
            elif rb >= 0:
                after[tail[ra]] = rb
                tail[ra] = tail[rb]
            merged.append((sa + sb, ra))
        merged.sort(key=lambda x: x[0])
        least = merged[0][0]
        heapq.heappush(heap, (least - merged[-1][0], stamp, [s - least for s, _ in merged], [r for _, r in merged]))
        stamp += 1
    for k, root in enumerate(heap[0][3]):
        while root >= 0:
            part[root] = k
            root = after[root]
    return part


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
                    packets: int = PACKETS) -> DataFrame:
    """One row per input row: (id, size, text_crc32, shard, slot).

    ``size`` is the UTF-8 length of the text (NULL: none) plus 8.  Equal texts,
    NULL counting as empty, share a shard; sums of ``size`` per shard are near
    equal unless one group is larger than a shard's share, which it then gets
    alone.  Slots number a shard's rows from 0 without gaps, by item and then
    id.  Repeated rows get slots of their own; other columns are ignored; an
    empty table gives an empty result.
    """
    text = text_of(text_col)
    rows = saved(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
                             crc32_of(text).alias("text_crc32"), F.sha2(text, 256).alias("sha")), "sizes")
    groups = rows.groupBy("sha").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    # At most `packets` groups can exceed total / packets: a table of proven size.
    large = groups.filter(F.col("bytes") * packets > F.lit(total)).select("sha", F.concat(F.lit("g"), "sha").alias("own"))
    packet = F.concat(F.lit("p"), F.pmod(F.xxhash64("sha"), F.lit(packets)).cast("string"))
    placed = saved(rows.join(F.broadcast(large), "sha", "left")
                   .select("id", "size", "text_crc32", F.coalesce("own", packet).alias("item")), "items")
    items = placed.groupBy("item").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))

    def divide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "item"], ascending=[False, True], ignore_index=True)
        pdf["shard"] = karmarkar_karp(pdf["bytes"].to_numpy(), shards)
        before = pdf.sort_values(["shard", "item"])
        pdf["first_slot"] = before.groupby("shard")["n"].cumsum() - before["n"]
        return pdf[["item", "shard", "first_slot", "n"]]

    # One group of at most 2 x packets rows.
    plan = saved(items.groupBy(F.lit(1).alias("all")).applyInPandas(
        lambda pdf: divide(pdf), "item string, shard int, first_slot long, n long"), "shard-plan")
    # An item can hold a third of all rows: it is numbered in units, whose counts give each unit its first slot.  Rows that
    # repeat an id and a text are one counted row, in parts of at most UNIT_ROWS, until they get their slots.
    same = placed.groupBy("id", "size", "text_crc32", "item").agg(F.count("*").alias("copies"))
    parts = same.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / UNIT_ROWS)))) \
        .withColumn("rows", F.least(F.lit(UNIT_ROWS), F.col("copies") - F.col("part") * UNIT_ROWS)).drop("copies")
    spread = parts.join(F.broadcast(plan), "item").withColumn(
        "unit", F.pmod(F.xxhash64("id", "text_crc32", "part"), F.ceil(F.col("n") / UNIT_ROWS)))
    units = spread.groupBy("item", "unit").agg(F.sum("rows").alias("unit_rows"))
    earlier = Window.partitionBy("item").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    starts = units.withColumn("unit_start", F.coalesce(F.sum("unit_rows").over(earlier), F.lit(0))).drop("unit_rows")
    within = Window.partitionBy("item", "unit").orderBy("id", "text_crc32", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("first_slot") + F.col("unit_start") + F.col("at")
    return (spread.withColumn("at", F.coalesce(F.sum("rows").over(within), F.lit(0))).join(starts, ["item", "unit"])
            .select("id", "size", "text_crc32", "shard", F.explode(F.sequence(first, first + F.col("rows") - 1)).alias("slot")))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all ``documents`` into shards 0 to 23 under the law ``bytes``."""
    out = shard_documents(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))

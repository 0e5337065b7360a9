"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Documents of equal text are one group. Groups are dealt into buckets by their hash; in each bucket
differencing repeatedly takes the two partial partitions of largest spread and combines them,
largest sum with smallest, until one partition of the bucket into ``shards`` parts is left. The
buckets' partitions, each only ``shards`` sums, are combined the same way: up to ``AT_ONCE`` of them in one
place, more in bundles of ``AT_ONCE``, then their bundles, until one is left. That places every part of
every bucket in a shard.
A group too large to be balanced just fills its shard. Texts are never moved: only digests, sizes
and ids are.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumidex.llm.common import id_back, id_key
from lumidex.session import cut

SHARDS = 8
#: Groups that one task differences at most, about; there are at least LEAST_BUCKETS buckets.
GROUPS_IN_BUCKET = 100_000
LEAST_BUCKETS = 256
#: Partial partitions that are combined in one place.
AT_ONCE = 4096
#: Rows that one task numbers, about.
ROWS_IN_RUN = 50_000


def difference(partials: list[list[int]]) -> list[list[int]]:
    """Combines partial partitions (each ``k`` sums) into one; for each of them, the part that each of its sums goes to.

    Ties of spread go by position, so the outcome is fixed by the input.
    """
    if not partials:
        return []
    k = len(partials[0])
    heap, nodes = [], []
    for i, sums in enumerate(partials):
        order = sorted(range(k), key=lambda j: (-sums[j], j))
        ranked = [sums[j] for j in order]
        nodes.append((None, None, order))
        heap.append((ranked[-1] - ranked[0], i, ranked))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        raw = [x[j] + y[k - 1 - j] for j in range(k)]
        order = sorted(range(k), key=lambda j: (-raw[j], j))
        ranked = [raw[j] for j in order]
        nodes.append((a, b, order))
        heapq.heappush(heap, (ranked[-1] - ranked[0], len(nodes) - 1, ranked))
    out: list[list[int]] = [[] for _ in partials]
    waiting = [(len(nodes) - 1, list(range(k)))]
    while waiting:
        node, part = waiting.pop()
        a, b, order = nodes[node]
        placed = [0] * k
        for rank, j in enumerate(order):
            placed[j] = part[rank]
        if a is None:
            out[node] = placed
        else:
            waiting.append((a, placed))
            waiting.append((b, placed[::-1]))
    return out


def partition_sizes(sizes: list[int], shards: int) -> list[int]:
    """The part of each size, by differencing."""
    return [placed[0] for placed in difference([[s, *[0] * (shards - 1)] for s in sizes])]


def _groups_to_shards(groups: DataFrame, n: int, shards: int) -> DataFrame:
    """``g0, g1, shard`` of groups with ``bytes``."""
    buckets = max(LEAST_BUCKETS, math.ceil(n / GROUPS_IN_BUCKET))

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "g0", "g1"], ascending=[False, True, True], ignore_index=True)
        return pdf.assign(part=partition_sizes(pdf["bytes"].tolist(), shards))

    dealt = groups.withColumn("bucket", F.pmod("g0", F.lit(buckets)).cast("int"))
    parts = cut(dealt.groupBy("bucket").applyInPandas(bucket, "g0 long, g1 long, bytes long, bucket int, part int"))
    sums = parts.groupBy("bucket").agg(*[F.sum(F.when(F.col("part") == j, F.col("bytes")).otherwise(0)).alias(f"s{j}") for j in range(shards)])
    to_shard = _combined(sums.withColumnRenamed("bucket", "unit"), shards).select(F.col("unit").alias("bucket"), F.posexplode("places").alias("part", "shard"))
    return parts.join(to_shard, ["bucket", "part"]).select("g0", "g1", "shard")


def _combined(sums: DataFrame, shards: int) -> DataFrame:
    """``unit, places``: the shard of each part of each unit's partition (sums ``s0``, ``s1``, ...), all units combined by differencing."""
    names = [f"s{j}" for j in range(shards)]
    sums = cut(sums)
    n = sums.count()

    def placed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit", ignore_index=True)
        to = difference(pdf[names].to_numpy().tolist())
        return pd.DataFrame({"unit": pdf["unit"], "bundle": pdf["bundle"], "places": to})

    bundles = max(1, math.ceil(n / AT_ONCE))
    dealt = sums.withColumn("bundle", F.pmod("unit", F.lit(bundles)).cast("int"))
    places = dealt.groupBy("bundle").applyInPandas(placed, "unit int, bundle int, places array<int>")
    if bundles == 1:
        return places.select("unit", "places")
    places = cut(places)
    each = dealt.select("unit", "bundle", F.posexplode(F.array(*names)).alias("part", "bytes")).join(places.select("unit", F.posexplode("places").alias("part", "to")), ["unit", "part"])
    above = each.groupBy("bundle").agg(*[F.sum(F.when(F.col("to") == j, F.col("bytes")).otherwise(0)).alias(f"s{j}") for j in range(shards)])
    whole = _combined(above.withColumnRenamed("bundle", "unit"), shards).select(F.col("unit").alias("bundle"), F.col("places").alias("_whole"))
    return places.join(whole, "bundle").select("unit", F.transform("places", lambda p: F.col("_whole")[p]).alias("places"))


def assign_shards(df: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row for each row: ``key`` (its id, ``NO_ID`` for null), ``size``, ``text_crc32``, ``shard``, ``slot``.

    ``size`` is the text's UTF-8 bytes plus 1. A null text counts as empty and stands in one group
    with empty texts. Slots number the rows of a shard from 0 without gaps, in an order fixed by
    ids and digests; rows that repeat both are interchangeable. No row gives no shard.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        id_key(df, id_col).alias("key"),
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.xxhash64(whole).alias("g0"),
        F.xxhash64(F.lit(1), whole).alias("g1"),
    )
    rows = cut(rows)
    groups = cut(rows.groupBy("g0", "g1").agg(F.sum("size").alias("bytes")))
    placed = cut(rows.join(_groups_to_shards(groups, groups.count(), shards), ["g0", "g1"]))
    runs = max(64, math.ceil(rows.count() / ROWS_IN_RUN))
    placed = placed.withColumn("run", F.pmod(F.xxhash64("key", "g0", "g1"), F.lit(runs)).cast("int"))
    counts = placed.groupBy("shard", "run").count()
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("shard", "run").orderBy("key", "g0", "g1")
    numbered = placed.withColumn("nth", F.row_number().over(order) - 1).join(offsets, ["shard", "run"])
    return numbered.select("key", "size", "text_crc32", "shard", (F.col("offset") + F.col("nth")).cast("long").alias("slot"))


def shard_report(df: DataFrame) -> DataFrame:
    """The fixed result of the registered query."""
    return assign_shards(df).select(
        id_back(df, "doc_id", "key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )

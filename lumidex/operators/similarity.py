"""Pairs of photos within a Hamming radius of their perceptual hashes, and their verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumidex.functions import hashing
from lumidex.session import cut
from lumidex.settings import Settings

SEGMENTS, WIDTH = 4, 16
#: Up to so many rows (of under 100 bytes) one side is broadcast and every pair is tested; beyond, candidates meet by segment.
#: A table that is compared with itself may have so many times that: neither side is larger then.
BROADCAST_ROWS = 20_000
WITH_ITSELF = 5
#: Flips of a segment that are looked under at most; beyond (a radius over 15) sides are compared in tiles of so many rows.
MASKS = 1000
TILE_ROWS = 8192
#: Codes in a leaf of a metric tree, and queries that meet a leaf at once.
LEAF = 128
BLOCK = 4096


def flip_masks(radius: int, width: int = WIDTH) -> list[int]:
    """All masks of up to ``radius`` of ``width`` bits."""
    return [sum(1 << b for b in chosen) for n in range(radius + 1) for chosen in combinations(range(width), n)]


def hashed(df: DataFrame, hash_: str = "phash") -> DataFrame:
    """``id, bits``: rows with a well-formed hash, as two halves."""
    return df.select("id", hashing.halves(F.col(hash_)).alias("bits")).where("bits is not null")


def hamming_pairs(probe: DataFrame, build: DataFrame, radius: int, rows: int | None = None, ordered: bool = True, outright: int | None = None) -> DataFrame:
    """``a, b, distance`` of ``probe`` and ``build`` rows (``id, bits``) at most ``radius`` apart; ``a < b`` if ``ordered``, as for a table with itself.

    Up to ``outright`` rows (``BROADCAST_ROWS``, and for a table with itself ``WITH_ITSELF`` times that) are compared outright
    against a broadcast side. Larger tables meet by segment: of
    four 16-bit segments one differs in at most ``radius // 4`` bits, so each probe row looks under
    its segments with up to that many bits flipped, and finds the partners exactly. Where more
    than ``MASKS`` flips would be looked under, that costs more than comparing tiles: both sides are packed
    into tiles of a bounded size, and every two tiles meet once, where a metric tree over the one is searched for the other.
    """
    radius = min(64, max(0, radius))
    rows = build.count() if rows is None else rows
    outright = BROADCAST_ROWS * (WITH_ITSELF if ordered else 1) if outright is None else outright
    p, b = probe.select(F.col("id").alias("a"), F.col("bits").alias("pa")), build.select(F.col("id").alias("b"), F.col("bits").alias("pb"))
    distance = hashing.hamming(F.col("pa"), F.col("pb"))
    near = (F.col("a") < F.col("b")) & (distance <= radius) if ordered else distance <= radius
    if rows <= outright:
        if ordered:  # a small table is one partition, while comparing it with itself is work for all cores
            p = p.repartition(2 * probe.sparkSession.sparkContext.defaultParallelism)
        return p.join(F.broadcast(b), near).select("a", "b", distance.alias("distance"))
    flips = sum(comb(WIDTH, n) for n in range(radius // SEGMENTS + 1))
    if radius // SEGMENTS >= WIDTH or flips > MASKS:
        return _tile_pairs(probe, build, radius, ordered)
    segments = lambda bits: F.array(*[F.shiftright(F.col(f"{bits}.{half}"), by).bitwiseAND(F.lit(0xFFFF)).cast("int") for half in ("hi", "lo") for by in (16, 0)])
    masks = F.array(*[F.lit(m) for m in flip_masks(radius // SEGMENTS)])
    looked = p.select("a", "pa", F.posexplode(segments("pa")).alias("k", "seg")).select("a", "pa", "k", F.explode(F.transform(masks, lambda m: F.col("seg").bitwiseXOR(m))).alias("seg"))
    placed = b.select("b", "pb", F.posexplode(segments("pb")).alias("k", "seg"))
    met = looked.join(placed, ["k", "seg"]).where(near)
    return met.select("a", "b", distance.alias("distance")).distinct()


class Tree:
    """A metric tree over 64-bit codes: a node's codes are split by their distance to its first one, down to leaves that are compared outright."""

    def __init__(self, codes: np.ndarray, leaf: int = LEAF):
        self.codes, self.leaf = codes, leaf
        self.nodes: list[tuple[np.ndarray, list[tuple[int, int]]]] = []  # places of the codes compared here, (distance, node) of what hangs below
        waiting = [(np.arange(len(codes)), -1, 0)]
        while waiting:
            places, parent, edge = waiting.pop()
            node = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][1].append((edge, node))
            if len(places) <= leaf:
                self.nodes.append((places, []))
                continue
            apart = np.bitwise_count(codes[places] ^ codes[places[0]])
            self.nodes.append((places[apart == 0], []))
            waiting += [(places[apart == d], node, int(d)) for d in np.unique(apart) if d]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of codes and of queries at most the radius apart, and their distances."""
        waiting = [(0, np.arange(len(queries)))] if len(self.codes) else []
        while waiting:
            node, at = waiting.pop()
            places, below = self.nodes[node]
            if below:
                apart = np.bitwise_count(queries[at] ^ self.codes[places[0]]).astype(np.int16)
                near = np.flatnonzero(apart <= radius)
                yield np.repeat(places, len(near)), np.tile(at[near], len(places)), np.tile(apart[near], len(places))
                waiting += [(child, follow) for edge, child in below if len(follow := at[np.abs(apart - edge) <= radius])]
            else:
                for lo in range(0, len(at), BLOCK):
                    apart = np.bitwise_count(self.codes[places][:, None] ^ queries[at[lo : lo + BLOCK]][None, :])
                    i, j = np.nonzero(apart <= radius)
                    yield places[i], at[lo : lo + BLOCK][j], apart[i, j].astype(np.int16)


def _tiles(rows: DataFrame, n: int) -> DataFrame:
    """``tile, ids, codes``: rows (``id, bits``) packed into tiles of about ``TILE_ROWS``, 16 bytes a row."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, ends in _runs(batches, "tile"):
            spans = list(zip(ends, ends[1:]))
            cut_ = lambda c: [pdf[c].to_numpy()[lo:hi].tobytes() for lo, hi in spans]
            yield pd.DataFrame({"tile": [int(pdf["tile"].iloc[lo]) for lo, _ in spans], "ids": cut_("id"), "codes": cut_("code")})

    parts = max(1, ceil(n / TILE_ROWS))
    code = F.shiftleft(F.col("bits.hi").cast("long"), 32).bitwiseOR(F.col("bits.lo").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("tile"), F.col("id").cast("long").alias("id"), code.alias("code"))
    return cut(dealt.repartition("tile").sortWithinPartitions("tile").mapInPandas(pack, "tile int, ids binary, codes binary"))


def _runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Frames of whole runs of a key, with the places where runs start and the end; rows are sorted by it."""
    held = None
    for pdf in batches:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        turns = np.flatnonzero(np.diff(held[key].to_numpy())) + 1
        if len(turns):
            yield held.iloc[: turns[-1]], [0, *turns.tolist()]
            held = held.iloc[turns[-1] :].reset_index(drop=True)
    if held is not None and len(held):
        turns = np.flatnonzero(np.diff(held[key].to_numpy())) + 1
        yield held, [0, *turns.tolist(), len(held)]


def _tile_pairs(probe: DataFrame, build: DataFrame, radius: int, ordered: bool) -> DataFrame:
    """Every two tiles meet in one row: a tile of ``probe`` goes, packed, to those of ``build`` that are searched for it.

    Of a table with itself two tiles meet once, and which of them is searched changes, so that all are searched about as often.
    """
    spark, schema, same = probe.sparkSession, "a long, b long, distance int", probe is build
    asked = _tiles(probe, probe.count())
    trees = asked if same else _tiles(build, build.count())
    most = trees.agg(F.max("tile")).first()[0]
    if most is None:
        return spark.createDataFrame([], schema)
    asked = asked.select(F.col("tile").alias("ask"), F.col("ids").alias("a_ids"), F.col("codes").alias("a_codes"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("tile"))
    if same:
        low_first = F.pmod(F.col("ask") + F.col("tile"), F.lit(2)) == 0
        asked = asked.where((F.col("ask") == F.col("tile")) | F.when(low_first, F.col("ask") < F.col("tile")).otherwise(F.col("ask") > F.col("tile")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    met = asked.repartition(parts, "tile").join(trees.select("tile", F.col("ids").alias("b_ids"), F.col("codes").alias("b_codes")).hint("shuffle_hash"), "tile")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for one, a_ids, a_codes, b_ids, b_codes in zip(pdf["ask"] == pdf["tile"], pdf["a_ids"], pdf["a_codes"], pdf["b_ids"], pdf["b_codes"]):
                a, b = np.frombuffer(a_ids, np.int64), np.frombuffer(b_ids, np.int64)
                for at, asker, apart in Tree(np.frombuffer(b_codes, np.uint64)).within(np.frombuffer(a_codes, np.uint64), radius):
                    x, y = a[asker], b[at]
                    if ordered and same and not one:
                        x, y = np.minimum(x, y), np.maximum(x, y)
                    kept = x < y if ordered else np.ones(len(x), bool)
                    yield pd.DataFrame({"a": x[kept], "b": y[kept], "distance": apart[kept].astype(np.int32)})

    return met.select("ask", "tile", "a_ids", "a_codes", "b_ids", "b_codes").mapInPandas(search, schema)


def similar_pairs(df: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``a, b, distance``: pairs of ok photos that agree in pHash, dHash and colour.

    Photos equal in all three stand for one another: only one of each such set is compared, and the
    others are linked to it, as far as the set agrees with itself (a missing dHash or colour does not).
    """
    s = settings or Settings()
    rows = df.where("status = 'ok' AND phash != ''").select("id", "phash", "dhash", "color_sig")
    key = ["phash", "dhash", "color_sig"]
    least = cut(rows.groupBy(*key).agg(F.min("id").alias("rep")))  # a join with it can then split a hot key
    named = least.select("rep", *[F.col(k).alias(f"_{k}") for k in key])
    same = rows.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]).select("id", "rep", "dhash", "color_sig")
    agrees = (hashing.hamming(hashing.halves(F.col("dhash")), hashing.halves(F.col("dhash"))) <= s.dhash_threshold) & (hashing.color_distance(F.col("color_sig"), F.col("color_sig")) <= s.color_threshold)
    linked = same.where((F.col("id") != F.col("rep")) & agrees).select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance"))
    reps = least.select(F.col("rep").alias("id"), *key)
    codes = hashed(reps)
    pairs = hamming_pairs(codes, codes, s.phash_threshold)
    return verified(pairs, reps, s).unionByName(linked)


def verified(pairs: DataFrame, photos: DataFrame, settings: Settings) -> DataFrame:
    """The pairs whose dHash and colour agree as well."""
    facts = lambda i: photos.select(F.col("id").alias(i), hashing.halves(F.col("dhash")).alias(f"d{i}"), F.col("color_sig").alias(f"c{i}"))
    both = pairs.join(facts("a"), "a").join(facts("b"), "b")
    near = hashing.hamming(F.col("da"), F.col("db")) <= settings.dhash_threshold
    return both.where(near & (hashing.color_distance(F.col("ca"), F.col("cb")) <= settings.color_threshold)).select("a", "b", "distance")


def rotated_pairs(df: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``a, b, distance``: as ``similar_pairs``, where either photo may be turned by quarters (column ``rotations``).

    The distance is the least over the upright hash of one and all turns of the other; dHash and
    colour are compared as they are.
    """
    s = settings or Settings()
    rows = df.where("status = 'ok' AND phash != ''")
    turned = rows.select("id", F.explode(F.array_distinct(F.concat(F.array("phash"), F.coalesce("rotations", F.array().cast("array<string>"))))).alias("turn")).select("id", hashing.halves(F.col("turn")).alias("bits"))
    upright = hashed(rows)
    found = hamming_pairs(upright, turned, s.phash_threshold).unionByName(hamming_pairs(turned, upright, s.phash_threshold))
    return verified(found.groupBy("a", "b").agg(F.min("distance").alias("distance")), rows, s)


def exact_links(df: DataFrame) -> DataFrame:
    """``a, b``: each photo of equal bytes linked to the first, never pair by pair."""
    rows = df.where("status = 'ok' AND phash != '' AND sha256 != ''").select("id", "sha256")
    first = cut(rows.groupBy("sha256").agg(F.min("id").alias("a")))
    return rows.join(first, "sha256").where("id != a").select("a", F.col("id").alias("b"))

"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming radius through BK-trees.

Every distinct fingerprint is put in shards, so that any two fingerprints within the radius meet
in at least one: 64 bits are cut into ``blocks`` runs, and since at most ``radius`` of them can
differ, some ``blocks - radius`` runs agree. A shard is one choice of runs with their value. Its
BK-tree (children keyed by the integer Hamming distance to their parent) is searched for all
fingerprints of the shard, following only edges ``e`` with ``|e - d| <= radius``. The number of
blocks follows the number of fingerprints, so that the mean shard stays small at any size.

A shard of more than ``TREE_NODES`` fingerprints is cut into parts of about that many, and every two
parts meet: the tree of the one is searched for the other. So a task holds two parts at most, and
nothing is capped. (A tree is not broadcast to all executors, as its size has no bound; it goes to the tasks
that search it.) A task emits links to one member of each local cluster, never all pairs; the
clusters are then joined by distributed connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumidex.llm.common import NO_ID, groups_of, id_back, id_key, short_batches
from lumidex.operators.components import connected_components
from lumidex.session import cut

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Nodes of one tree, about; larger shards are cut into several. The links found do not depend on it.
TREE_NODES = 8192
#: Mean fingerprints in a shard that the choice of blocks aims at.
SHARD_MEAN = 64


def text_fingerprint(text: str | None, words_in_shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of a whole text; 0 if it has no word (null, empty, white space only)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= words_in_shingle:
        return digest(joined, seed)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    hashes = np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[words_in_shingle:])), np.uint64, len(words) - words_in_shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in range(64) if 2 * int(counts[i]) > len(hashes))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint as a signed long. A null text counts as empty."""
    short_batches(df.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([text_fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return df.withColumn(out, of(F.col(text)))


class BKTree:
    """A metric tree over 64-bit codes, searched for many codes at once."""

    def __init__(self, codes: np.ndarray):
        self.codes: list[np.uint64] = []
        self.children: list[list[tuple[int, int]]] = []
        waiting: list[tuple[np.ndarray, int, int]] = [(codes, -1, 0)]
        while waiting:
            members, parent, edge = waiting.pop()
            node = len(self.codes)
            self.codes.append(members[0])
            self.children.append([])
            if parent >= 0:
                self.children[parent].append((edge, node))
            rest = members[1:]
            if len(rest):
                apart = np.bitwise_count(rest ^ members[0])
                for d in np.unique(apart):
                    if d:
                        waiting.append((rest[apart == d], node, int(d)))

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.uint64, np.ndarray]]:
        """For each node that has any, the places in ``queries`` of the codes within the radius."""
        waiting = [(0, np.arange(len(queries)))]
        while waiting:
            node, at = waiting.pop()
            apart = np.bitwise_count(queries[at] ^ self.codes[node]).astype(np.int16)
            near = at[apart <= radius]
            if len(near):
                yield self.codes[node], near
            for edge, child in self.children[node]:
                follow = at[np.abs(apart - edge) <= radius]
                if len(follow):
                    waiting.append((child, follow))


class BKForest:
    """The metric trees of many shards at once, over codes of any number of 64-bit words (``words``: one array each).

    Rows of a shard follow each other. All trees grow and are searched level by level, so that small shards cost no
    steps of their own; children, edges and the rule to follow them are those of ``BKTree``.
    """

    def __init__(self, shard: np.ndarray, words: list[np.ndarray]):
        n = len(shard)
        self.words = words
        self.edge = np.zeros(n, np.int16)
        parent = np.full(n, -1, np.int64)
        self.root = np.zeros(n, np.int64)
        left, group = np.arange(n), shard
        while len(left):
            new = np.concatenate([[True], group[1:] != group[:-1]])
            node = left[new][np.cumsum(new) - 1]
            if len(left) == n:
                self.root = node
            left, node = left[~new], node[~new]
            apart = self.apart(left, node)
            parent[left], self.edge[left] = node, apart  # the last one set is that of its parent
            group = node * (64 * len(words) + 1) + apart
            order = np.argsort(group, kind="stable")
            left, group = left[order], group[order]
        self.children = np.argsort(parent, kind="stable")[np.count_nonzero(parent < 0) :]
        self.count = np.bincount(parent[parent >= 0], minlength=n)
        self.start = np.cumsum(self.count) - self.count

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int16) for w in self.words)

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(query, node)`` rows within the radius, for queries that are rows of the forest, each in the tree of its shard."""
        at, node = queries, self.root[queries]
        while len(at):
            apart = self.apart(at, node)
            near = (apart <= radius) & (at != node)
            yield at[near], node[near]
            many = self.count[node]
            inner = many > 0
            at, node, apart, many = at[inner], node[inner], apart[inner], many[inner]
            first = np.cumsum(many) - many
            child = self.children[np.repeat(self.start[node] - first, many) + np.arange(many.sum())]
            follow = np.abs(self.edge[child] - np.repeat(apart, many)) <= radius
            at, node = np.repeat(at, many)[follow], child[follow]


def shard_links(tree: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(code, representative)`` that join what the links between tree and queries join, at most one for each code.

    Each array holds distinct codes in order.
    """
    codes = np.union1d(tree, queries)
    label = np.arange(len(codes))
    place = np.searchsorted(codes, queries)
    for code, near in BKTree(tree).within(queries, radius):
        own = label[np.searchsorted(codes, code)]
        found = np.unique(label[place[near]])
        if len(found) > 1 or found[0] != own:
            found = np.union1d(found, [own])
            label[np.isin(label, found[1:])] = found[0]
    moved = np.flatnonzero(label != np.arange(len(codes)))
    return codes[moved], codes[label[moved]]


def block_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks, as signed longs: two codes within the radius agree under one of them at least."""
    blocks = radius + 1
    while blocks < 2 * radius and n / 2 ** (64 * (blocks - radius) / blocks) > SHARD_MEAN:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    runs = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(runs, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(codes: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints (column ``fp``) that join every two within the radius."""
    spark = codes.sparkSession
    masks = block_masks(n, radius)
    shards = codes.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("run"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)])).alias("s")
    ).select("fp", "s.run", "s.bits")
    large = cut(shards.groupBy("run", "bits").count().where(F.col("count") > TREE_NODES).select("run", "bits", F.ceil(F.col("count") / TREE_NODES).cast("int").alias("parts")))
    keys = ["run", "bits", "tree", "ask"]
    dealt = (
        shards.join(large, ["run", "bits"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("run", "bits", F.least("own", "with").alias("tree"), F.greatest("own", "with").alias("ask"), "own", "fp")
    )
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(parts, *keys).sortWithinPartitions(*keys, "own", "fp")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, ends in groups_of(batches, keys):
            code, own = pdf["fp"].to_numpy().view(np.uint64), pdf["own"].to_numpy()
            first = pdf[["tree", "ask"]].to_numpy()[ends[:-1]].tolist()
            a, b = [], []
            for lo, hi, (tree, ask) in zip(ends, ends[1:], first):
                if hi - lo > 1:
                    nodes = np.sort(code[lo:hi][own[lo:hi] == tree])
                    queries = nodes if tree == ask else np.sort(code[lo:hi][own[lo:hi] == ask])
                    if len(nodes) and len(queries):
                        x, y = shard_links(nodes, queries, radius)
                        a.append(x)
                        b.append(y)
            if a:
                yield pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    return dealt.mapInPandas(search, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row for each row: ``key`` (its id, ``NO_ID`` for null), ``text_key``, ``fp`` and ``component``.

    ``component`` is the least key reachable over links. Null and empty texts have fingerprint
    zero and link like any other; a null id sorts before every other; repeated rows are kept and
    share a component. Other columns of the input are not read.
    """
    marked = cut(fingerprints(df.select(id_key(df, id_col).alias("key"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text")), "text", "fp").select("key", "text_key", "fp"))
    codes = cut(marked.groupBy("fp").agg(F.min("key").alias("least")))
    found = connected_components(links(codes.select("fp"), codes.count(), radius))
    named = found.join(codes, found.node == codes.fp).select("fp", "root", "least")
    of_root = named.groupBy("root").agg(F.min("least").alias("component"))
    linked = named.join(of_root, "root").select("fp", "component")
    # materialised, so that the join below has exchanges on both sides and a hot fingerprint can be split
    every = cut(codes.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component")))
    return marked.join(every, "fp").select("key", "text_key", "fp", "component")


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The input's rows with one document of each near-duplicate group: the one with the least id.

    Ties on the id go to the least text hash, and of repeated rows one stays. Columns are unchanged.
    """
    found = near_duplicates(df, id_col, text, radius)
    best = found.groupBy("component").agg(F.min(F.struct("key", "text_key")).alias("best"))
    best = best.select("best.key", "best.text_key")
    rows = df.select(F.struct(*df.columns).alias("row"), id_key(df, id_col).alias("key"), F.xxhash64(text).alias("text_key"))
    return rows.join(best, ["key", "text_key"], "left_semi").dropDuplicates(["key", "text_key"]).select("row.*")


def near_duplicate_report(df: DataFrame) -> DataFrame:
    """The fixed result of the registered query."""
    return near_duplicates(df).select(
        id_back(df, "doc_id", "key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), id_back(df, "doc_id", "component").alias("component_id")
    )


__all__ = ["BKForest", "BKTree", "NO_ID", "fingerprints", "keep_one", "links", "near_duplicate_report", "near_duplicates", "text_fingerprint"]

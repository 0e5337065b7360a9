"""Approximate nearest neighbours by cosine over shifted space-filling curves.

Equal vectors are one point, named by its least id. Each of ``CURVES`` curves projects the unit
vectors on a few random directions, shifts the grid at random and orders the points by their
Hilbert index. Spark sorts each curve by range and numbers it; only ids move with the curves. A
query's candidates are the points up to ``window`` places before and after its own on any curve.

The window is measured, not given: for a bounded sample of queries (``SAMPLE``) the true neighbours
are found by one pass over all vectors, and the window is what brings ``SHARE_FOUND`` of them within
reach on some curve. Vectors with structure need a few hundred places; vectors without any need a
share of all points, and then the work grows with the square of their number (see README).

Vectors move once: they are cut into blocks of neighbours on the first curve, each point with its
place on every curve. A query goes to the blocks that hold candidates of it, as a table of which blocks
stand in which stretch of each curve tells. A task holds one block and a bounded part of its
queries, reranks by the exact cosine in double precision and passes on a few best.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumidex.llm.common import give_back, short_batches
from lumidex.session import cut, shared_folder

CURVES = 8
DIRECTIONS = 4
BITS = 12
#: Queries whose neighbours are looked up among all vectors to measure the window; the share of these neighbours that it has to reach; its least width.
SAMPLE = 256
SHARE_FOUND = 0.97
LEAST_WINDOW = 256
#: Numbers in the vectors of one block, queries of it that one task takes (in blocks), and queries that it compares at a time.
BLOCK_NUMBERS = 1 << 19
QUERY_BLOCKS = 2
AT_ONCE = 256
SEED = 5


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer cells (rows) of ``bits`` bits in each of their dimensions.

    The transposed form of Skilling (2004): undo the excess work of each bit plane, then Gray-encode.
    """
    axes = cells.astype(np.int64).T.copy()
    plane = 1 << (bits - 1)
    while plane > 1:
        low = plane - 1
        for i in range(len(axes)):
            inverted = (axes[i] & plane) != 0
            swap = np.where(inverted, 0, (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(inverted, low, swap)
            if i:
                axes[i] ^= swap
        plane >>= 1
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    flip = np.zeros_like(axes[0])
    plane = 1 << (bits - 1)
    while plane > 1:
        flip ^= np.where((axes[-1] & plane) != 0, plane - 1, 0)
        plane >>= 1
    axes ^= flip
    out = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            out = (out << 1) | ((axis >> bit) & 1)
    return out


@lru_cache(maxsize=64)
def _frames(dim: int, curves: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The directions and the shift of each curve."""
    rng, m = np.random.default_rng((seed, dim)), min(DIRECTIONS, dim)
    return [(np.linalg.qr(rng.standard_normal((dim, m)))[0], rng.random(m) / 2) for _ in range(curves)]


def curve_keys(unit: np.ndarray, curves: int = CURVES, seed: int = SEED) -> np.ndarray:
    """The Hilbert index of each unit vector (row) on each curve (column)."""
    n, dim = unit.shape
    keys = np.empty((n, curves), np.int64)
    for c, (directions, shift) in enumerate(_frames(dim, curves, seed)):
        spread = unit @ directions * math.sqrt(dim)
        # a logistic stand-in for the normal distribution function evens the cells out
        even = 1 / (1 + np.exp(-1.702 * spread))
        cells = ((even + shift) / 1.5 * (1 << BITS)).astype(np.int64)
        keys[:, c] = hilbert_index(np.clip(cells, 0, (1 << BITS) - 1), BITS)
    return keys


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, vec``: vectors that take part. Null, empty or zero vectors and such with null or non-finite components do not, nor rows without an id.

    Of rows that repeat an id the one with the least vector counts.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    vec = F.col(vector)
    fine = vec.isNotNull() & F.col(id_col).isNotNull() & F.coalesce(F.forall(vec, finite) & F.exists(vec, lambda x: x != 0), F.lit(False))
    rows = df.where(fine).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    repeated = cut(rows.groupBy("id").count().where("count > 1").select("id"))
    if repeated.isEmpty():
        return rows
    return rows.join(repeated, "id", "left_anti").unionByName(rows.join(repeated, "id", "left_semi").groupBy("id").agg(F.min("vec").alias("vec")))


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Unit vectors of one length in double precision; scaled by the largest component first, so that no square overflows."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(pdf: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    """The rows of each length of vector, with their unit vectors."""
    for dim, part in pdf.groupby(pdf["vec"].map(len)):
        yield int(dim), part, unit_rows(part["vec"])


class _Tables:
    """Parquet tables in the folder that the cluster shares, which cut lineage and take little room; removed when the result stands."""

    def __init__(self, spark: SparkSession):
        self.spark, self.place = spark, f"{shared_folder(spark).rstrip('/')}/neighbours-{uuid.uuid4().hex}"

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.place}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.place}/{name}")

    def remove(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.place)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _keys(rows: DataFrame, curves: int) -> DataFrame:
    """``id, v0, v1, dim, keys``: two digests of each vector, its length, its index on every curve."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            for pdf in batches:
                for dim, part, unit in _by_length(pdf):
                    yield pd.DataFrame({"id": part["id"], "v0": part["v0"], "v1": part["v1"], "dim": dim, "keys": list(curve_keys(unit, curves))})
        finally:
            give_back()

    digested = rows.select("id", "vec", F.xxhash64("vec").alias("v0"), F.xxhash64(F.lit(1), "vec").alias("v1"))
    return digested.mapInPandas(keys, "id long, v0 long, v1 long, dim int, keys array<long>")


def _ranked(tables: _Tables, keyed: DataFrame) -> DataFrame:
    """``point, dim, ranks``: every point's place on every curve. Vectors of another length have curves of their own."""
    each = keyed.select("dim", F.posexplode("keys").alias("curve", "key"), F.col("id").alias("point"))
    # equal keys are dealt anew on each curve, so that the windows of nearly equal vectors differ
    order = ["dim", "curve", "key", "turn", "point"]
    placed = each.withColumn("turn", F.xxhash64("curve", "point")).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = tables.stored(placed.select("dim", "curve", "point", F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("nth")), "placed")
    runs = placed.groupBy("dim", "curve", "run").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    before = Window.partitionBy("dim", "curve").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut(runs.select("dim", "curve", "run", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    numbered = placed.join(runs, ["dim", "curve", "run"]).select("point", "dim", "curve", (F.col("offset") + F.col("nth") - F.col("first")).alias("rank"))
    ranks = numbered.groupBy("point", "dim").agg(F.sort_array(F.collect_list(F.struct("curve", "rank"))).alias("each"))
    return tables.stored(ranks.select("point", "dim", F.transform("each", lambda x: x["rank"]).alias("ranks")), "ranks")


def nearest_of(queries: pd.DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``query, id``: the true ``k`` nearest of a bounded table of queries (``id, vec``), by one pass over all rows."""
    sample = [(dim, part["id"].to_numpy(), unit) for dim, part, unit in _by_length(queries)]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {dim: (np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)) for dim, ids, _ in sample}
        for pdf in batches:
            there = {dim: (part["id"].to_numpy(), unit) for dim, part, unit in _by_length(pdf)} if len(pdf) else {}
            for dim, ids, unit in sample:
                if dim in there:
                    other, x = there[dim]
                    score = unit @ x.T
                    score[ids[:, None] == other[None, :]] = -np.inf
                    score = np.hstack([best[dim][0], score])
                    names = np.hstack([best[dim][1], np.broadcast_to(other, (len(ids), len(other)))])
                    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    best[dim] = np.take_along_axis(score, top, 1), np.take_along_axis(names, top, 1)
        for dim, ids, _ in sample:
            score, names = best[dim]
            seen = np.isfinite(score.ravel())
            yield pd.DataFrame({"query": np.repeat(ids, k)[seen], "id": names.ravel()[seen], "score": score.ravel()[seen]})

    found = rows.mapInPandas(scan, "query long, id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("query", "id")


def _window(rows: DataFrame, named: DataFrame, ranks: DataFrame, every: int, k: int) -> int:
    """The places on either side that bring ``SHARE_FOUND`` of the sampled queries' true neighbours within reach."""
    chosen = rows.where(F.col("id") % every == 0).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    if not len(chosen):
        return LEAST_WINDOW
    pairs = cut(nearest_of(chosen, rows, k))
    at = lambda name: named.join(ranks, "point").select(F.col("id").alias(name), F.col("ranks").alias(f"r_{name}"))
    apart = F.array_min(F.zip_with("r_query", "r_id", lambda a, b: F.abs(a - b)))
    gaps = [r.gap for r in pairs.join(at("query"), "query").join(at("id"), "id").select(apart.alias("gap")).collect()]
    return max([LEAST_WINDOW, *([math.ceil(np.quantile(gaps, SHARE_FOUND))] if gaps else [])])


def neighbours(df: DataFrame, every: int, k: int, id_col: str = "vec_id", vector: str = "embedding", curves: int = CURVES, window: int | None = None, block: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found for each query: rows whose id is divisible by ``every``.

    Ties go to the smaller id. Fewer than ``k`` candidates give fewer rows, an empty table none.
    Vectors of different lengths are no candidates of one another. ``window`` is measured unless
    given, ``block`` (points of a block) follows from the longest vector.
    """
    short_batches(df.sparkSession)
    tables = _Tables(df.sparkSession)
    rows = valid_vectors(df, id_col, vector)
    keyed = tables.stored(_keys(rows, curves), "keys")
    least = cut(keyed.groupBy("v0", "v1").agg(F.min("id").alias("point")))
    named = cut(keyed.select("id", "v0", "v1").join(least, ["v0", "v1"]).select("id", "point"))
    ranks = _ranked(tables, keyed.join(least.select(F.col("point").alias("id")), "id", "left_semi"))
    window = _window(rows, named, ranks, every, k) if window is None else window
    block = max(1, BLOCK_NUMBERS // (ranks.agg(F.max("dim")).first()[0] or 1)) if block is None else block

    nth = F.row_number().over(Window.partitionBy("point").orderBy("id"))
    ids = named.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("point").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    queries = named.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "point")
    points = rows.join(ranks, rows["id"] == ranks["point"]).select("point", "dim", "ranks", "vec").withColumn("block", F.floor(F.element_at("ranks", 1) / block))

    # which blocks hold points of which stretch of a curve, and so which blocks a query has candidates in
    stretch = lambda r: F.floor(r / max(1, window))
    each = ranks.withColumn("block", F.floor(F.element_at("ranks", 1) / block)).select("dim", "block", F.posexplode("ranks").alias("curve", "rank"))
    held = each.select("dim", "curve", stretch(F.col("rank")).alias("stretch"), "block").distinct()
    asked = ranks.join(queries.select("point").distinct(), "point", "left_semi")
    near = asked.select("point", "dim", F.posexplode("ranks").alias("curve", "rank"))
    near = near.select("point", "dim", "curve", F.explode(F.sequence(F.greatest(stretch(F.col("rank")) - 1, F.lit(0)), stretch(F.col("rank")) + 1)).alias("stretch"))
    routes = near.join(held, ["dim", "curve", "stretch"]).select("point", "block").distinct()

    # queries of a block are dealt to parts of a bounded size, and the block goes to each of them
    routes = tables.stored(routes, "routes")
    parts = routes.groupBy("block", F.lit(0).alias("_")).count().select("block", F.ceil(F.col("count") / (QUERY_BLOCKS * block)).cast("int").alias("parts"))
    parts = cut(parts)
    inside = points.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("dim", "block", "part", "point", "ranks", "vec", F.lit(False).alias("asks"))
    dealt = routes.join(parts, "block").select("point", F.col("block").alias("to"), F.pmod(F.xxhash64("point"), F.col("parts")).cast("int").alias("part"))
    sent = points.drop("block").join(dealt, "point").select("dim", F.col("to").alias("block"), "part", "point", "ranks", "vec", F.lit(True).alias("asks"))

    def rerank(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(dtype=bool)
        q, c = pdf[asks], pdf[~asks].sort_values("point")
        out = [pd.DataFrame({"point": np.array([], np.int64), "other": np.array([], np.int64), "score": np.array([], np.float64)})]
        if len(q) and len(c):
            y, places, names = unit_rows(c["vec"]), np.stack(c["ranks"].to_numpy()).T, c["point"].to_numpy()
            for lo in range(0, len(q), AT_ONCE):
                some = q.iloc[lo : lo + AT_ONCE]
                x, own = unit_rows(some["vec"]), np.stack(some["ranks"].to_numpy()).T
                reached = np.zeros((len(x), len(y)), bool)
                for mine, theirs in zip(own, places):
                    reached |= np.abs(mine[:, None] - theirs[None, :]) <= window
                score = np.where(reached, x @ y.T, -np.inf)
                keep = min(k + 1, len(c))
                least_ = np.partition(score, len(y) - keep, axis=1)[:, len(y) - keep]
                at, cols = np.nonzero((score >= least_[:, None]) & reached)
                exact = (x[at] * y[cols]).sum(axis=1)
                order = np.lexsort((cols, -exact, at))
                at, cols, exact = at[order], cols[order], exact[order]
                fine = np.arange(len(at)) - np.searchsorted(at, at) < keep
                out.append(pd.DataFrame({"point": some["point"].to_numpy()[at[fine]], "other": names[cols[fine]], "score": np.clip(exact[fine], -1, 1)}))
        return pd.concat(out)

    found = inside.unionByName(sent).groupBy("dim", "block", "part").applyInPandas(rerank, "point long, other long, score double")
    nearest = Window.partitionBy("point").orderBy(F.desc("score"), "other")
    found = cut(found.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k + 1).drop("nth"))
    tables.remove()
    answers = found.join(ids, found.other == ids.point).select(found.point, "score", "ids")
    answers = queries.join(answers, "point").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbour_report(df: DataFrame) -> DataFrame:
    """The fixed result of the registered query."""
    return neighbours(df, every=50, k=5)

"""Filters, sorts, limits and ranks over the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumidex.functions import text
from lumidex.functions.numbers import rounded
from lumidex.session import cut


def _orders() -> dict[str, list[Column]]:
    pixels = F.col("width").cast("long") * F.col("height").cast("long")
    name, path = text.folded(F.col("filename")), text.folded(F.col("path"))
    return {
        "score": [F.desc("score"), name.asc()],
        "score_asc": [F.asc("score"), name.asc()],
        "name": [name.asc()],
        "name_desc": [name.desc()],
        "date": [F.desc_nulls_last("taken_at"), F.desc("mtime")],
        "date_asc": [F.asc_nulls_first("taken_at"), F.asc("mtime")],
        "size": [F.desc("size")],
        "size_asc": [F.asc("size")],
        "resolution": [pixels.desc()],
        "folder": [path.asc()],
    }


def sort_keys(sort: str) -> list[Column]:
    """The keys of a named order, the id last; an unknown name sorts by score."""
    orders = _orders()
    return [*orders.get(sort, orders["score"]), F.asc("id")]


def select_photos(
    df: DataFrame, only_ok: bool = True, search: str = "", mark: str | None = None, min_score: float | None = None, max_score: float | None = None, flag: str | None = None, sort: str | None = "score", limit: int = 0
) -> DataFrame:
    """The one dynamic selection of the index. Bounds are inclusive; a limit of 0 or less is none; ``sort=None`` leaves the order open."""
    if only_ok:
        df = df.where("status = 'ok'")
    if search:
        df = df.where(text.like(F.col("path"), search) | text.like(F.col("camera"), search))
    if mark is not None:
        df = df.where(F.col("mark") == mark)
    if min_score is not None:
        df = df.where(F.col("score") >= min_score)
    if max_score is not None:
        df = df.where(F.col("score") <= max_score)
    if flag is not None:
        df = df.where(F.array_contains("flags", flag))
    if sort is not None:
        df = df.orderBy(*sort_keys(sort))
    return df.limit(limit) if limit > 0 else df


def numbered(df: DataFrame, keys: list[Column], out: str, kind: str = "int") -> DataFrame:
    """Numbers the rows from 1 in the order of ``keys``: sorted partitions, each with the count of those before it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges come from samples: stored, so that the counts and the rows see the same ones
    placed = cut(df.repartitionByRange(parts, *keys).withColumn("_run", F.spark_partition_id()))
    counts = placed.groupBy("_run").count()
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_run").orderBy(*keys))
    return placed.withColumn("_nth", within).join(offsets, "_run").withColumn(out, (F.col("_before") + F.col("_nth")).cast(kind)).drop("_run", "_nth", "_before")


def numbered_within(df: DataFrame, key: str, order: list[Column], out: str) -> DataFrame:
    """Numbers the rows of each key from 0 in an order, as a long. Rows are numbered by sorted ranges of all keys together, so a hot key is spread out."""
    every = cut(numbered(df, [F.asc(key), *order], out, "bigint"))
    first = cut(every.groupBy(F.col(key).alias("_key")).agg(F.min(out).alias("_first")))  # the join can then split a hot key
    return every.join(first, every[key].eqNullSafe(first["_key"])).withColumn(out, F.col(out) - F.col("_first")).drop("_key", "_first")


def with_rank(df: DataFrame, sort: str = "score", top: int | None = None, out: str = "rank") -> DataFrame:
    """Numbers the rows from 1 in a named order, all of them or the first ``top``.

    A top is taken first, from each partition, so that one task numbers ``top`` rows only.
    """
    keys = sort_keys(sort)
    if top is not None:
        return df.orderBy(*keys).limit(max(0, top)).withColumn(out, F.row_number().over(Window.orderBy(*keys)))
    return numbered(df, keys, out)


def percentiles(df: DataFrame, score: str = "score", out: str = "percentile") -> DataFrame:
    """Adds the share of rows with a lower score, in percent to one digit half up.

    Counted per distinct score and summed by range of scores, so no task holds all rows.
    """
    counts = df.groupBy(F.col(score).alias("_score")).count()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(counts.repartitionByRange(parts, "_score").withColumn("_run", F.spark_partition_id()))
    runs = placed.groupBy("_run").agg(F.sum("count").alias("_n"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = runs.select("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(everything).alias("_total"))
    below = F.coalesce(F.sum("count").over(Window.partitionBy("_run").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = placed.withColumn("_below", below).join(runs, "_run").select("_score", rounded(100.0 * (F.col("_below") + F.col("_before")) / F.col("_total"), 1).alias(out))
    return df.join(table, df[score] == table["_score"]).drop("_score")


def above_score(df: DataFrame, least: float) -> DataFrame:
    return df.where(F.col("score") >= least).orderBy(F.desc("score"), F.asc("id"))


def statistics(df: DataFrame) -> DataFrame:
    """One row: photos, bytes, mean score, megapixels of status ok, and the rows of other status."""
    ok = F.col("status") == "ok"
    pixels = F.col("width").cast("long") * F.col("height").cast("long")
    return df.agg(
        F.count_if(ok).alias("total"),
        F.coalesce(F.sum(F.when(ok, F.col("size"))), F.lit(0)).alias("bytes"),
        F.coalesce(F.avg(F.when(ok, F.col("score"))), F.lit(0.0)).alias("mean_score"),
        (F.coalesce(F.sum(F.when(ok, pixels)), F.lit(0)) / 1e6).alias("megapixels"),
        F.count_if(~ok).alias("errors"),
    )


def marks(df: DataFrame) -> DataFrame:
    """Rows by mark, of all statuses."""
    return df.groupBy("mark").agg(F.count("*").alias("n"))

"""Maintenance of the index: upserts, bulk changes, deletions and the incremental difference to what is on disk.

All of these return the new state of the index as a DataFrame; ``sources.photo_index.write_index``
makes it the next version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumidex.functions import quality
from lumidex.session import cut
from lumidex.settings import Weights

#: What a scan never overwrites.
KEPT = ("id", "mark", "rating")


def upsert(index: DataFrame, facts: DataFrame) -> DataFrame:
    """The index with new facts by path: known paths keep id, mark and rating, new ones get ids after the largest.

    ``facts`` has the index's columns but for the kept ones (a missing one becomes null); of rows
    that repeat a path one counts whole: the one scanned last (``indexed_at``), then the one modified
    last, then the largest in all its columns. Rows without a path are left out.
    """
    fresh = [c for c in index.columns if c not in KEPT and c in facts.columns]
    last = [F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))) if c in facts.columns else F.lit(0.0) for c in ("indexed_at", "mtime")]
    order = F.struct(*last, F.to_json(F.struct(*[c for c in fresh if c != "path"])))
    facts = facts.where("path IS NOT NULL").groupBy("path").agg(F.max_by(F.struct(*fresh), order).alias("_row")).select("_row.*")
    renamed = facts.select(F.col("path").alias("_path"), *[F.col(c).alias(f"_new_{c}") for c in fresh if c != "path"])
    both = index.join(renamed, index["path"] == renamed["_path"], "full_outer")
    changed = F.col("_path").isNotNull()
    columns = []
    for c in index.columns:
        if c == "path":
            columns.append(F.coalesce("path", "_path").alias("path"))
        elif c in KEPT or c not in fresh:
            columns.append(F.col(c))
        else:
            columns.append(F.when(changed, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
    rows = both.select(*columns)
    most = index.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    known, new = rows.where("id IS NOT NULL"), rows.where("id IS NULL")
    numbered = _numbered(new.drop("id"), "path", most).withColumns({"mark": F.lit("none"), "rating": F.lit(0)})
    return known.unionByName(numbered.select(*index.columns))


def _numbered(df: DataFrame, by: str, after: int) -> DataFrame:
    """Adds ``id``, counting on from ``after`` in order of ``by``: sorted ranges, each with the rows before it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(parts, by).withColumn("_run", F.spark_partition_id()))
    runs = placed.groupBy("_run").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_run", before.alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_run").orderBy(by))
    return placed.withColumn("_nth", nth).join(runs, "_run").withColumn("id", F.lit(after) + F.col("_before") + F.col("_nth")).drop("_run", "_nth", "_before")


def set_scores(index: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores by id (``id, score``); rows without a new one keep theirs."""
    return index.join(scores.select("id", F.col("score").alias("_score")), "id", "left").withColumn("score", F.coalesce("_score", "score")).select(*index.columns)


def rescored(index: DataFrame, weights: Weights) -> DataFrame:
    """All ok rows with stored metrics scored anew; no other row changes and nothing is measured."""
    measured = (F.col("status") == "ok") & F.col("metrics").isNotNull()
    return index.withColumn("score", F.when(measured, quality.rescore(F.col("metrics"), weights)).otherwise(F.col("score")))


def set_mark(index: DataFrame, ids: DataFrame, mark: str) -> DataFrame:
    """Marks the rows whose id is in ``ids``."""
    return index.join(ids.select("id", F.lit(True).alias("_chosen")).distinct(), "id", "left").withColumn("mark", F.when(F.col("_chosen"), mark).otherwise(F.col("mark"))).select(*index.columns)


def toggle_mark(index: DataFrame, photo_id: int, mark: str) -> DataFrame:
    """Sets the mark of one row, or clears it where it is set already."""
    other = F.when(F.col("mark") == mark, "none").otherwise(mark)
    return index.withColumn("mark", F.when(F.col("id") == photo_id, other).otherwise(F.col("mark")))


def clear_marks(index: DataFrame) -> DataFrame:
    return index.withColumn("mark", F.lit("none"))


def set_rating(index: DataFrame, photo_id: int, rating: int) -> DataFrame:
    """Ratings are held to 0 to 5."""
    return index.withColumn("rating", F.when(F.col("id") == photo_id, max(0, min(5, rating))).otherwise(F.col("rating")).cast("int"))


def rename_path(index: DataFrame, old: str, new: str) -> DataFrame:
    here = F.col("path") == old
    return index.withColumn("filename", F.when(here, new.rsplit("/", 1)[-1]).otherwise(F.col("filename"))).withColumn("path", F.when(here, new).otherwise(F.col("path")))


def delete_paths(index: DataFrame, paths: DataFrame) -> DataFrame:
    """The index without the rows of ``paths``."""
    return index.join(paths.select("path"), "path", "left_anti").select(*index.columns)


def count_paths(index: DataFrame, paths: DataFrame) -> int:
    """How many rows ``delete_paths`` takes out."""
    return index.join(paths.select("path"), "path", "left_semi").count()


def by_id(index: DataFrame, photo_id: int) -> DataFrame:
    return index.where(F.col("id") == photo_id)


def by_path(index: DataFrame, path: str) -> DataFrame:
    return index.where(F.col("path") == path)


def signatures(index: DataFrame) -> DataFrame:
    """What tells an unchanged file; rows in error have none and are always tried again."""
    return index.where("status = 'ok'").select("path", "size", "mtime")


def digests(index: DataFrame) -> DataFrame:
    """``sha256, path``: of rows with equal bytes the one with the largest id."""
    return index.where("sha256 != ''").groupBy("sha256").agg(F.max_by("path", "id").alias("path"))


def scan_difference(found: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """``path, size, mtime, action`` of found files: ``skip`` if size and time are those indexed, ``update`` if the path is known, else ``add``."""
    old = index.select(F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), (F.col("status") == "ok").alias("_ok"))
    both = found.join(old, found["path"] == old["_path"], "left")
    same = F.coalesce(F.col("_ok") & (F.col("size") == F.col("_size")) & (F.abs(F.col("mtime") - F.col("_mtime")) < 1e-6), F.lit(False)) & F.lit(not force)
    return both.select("path", "size", "mtime", F.when(same, "skip").when(F.col("_path").isNotNull(), "update").otherwise("add").alias("action"))


def missing_paths(index: DataFrame, found: DataFrame, roots: list[str]) -> DataFrame:
    """``path`` of indexed files under the scanned roots that were not found; rows outside the roots are left alone.

    A file may be there and yet not found, as one that has become too small for the settings:
    ``sources.folders.absent`` tells which are gone.
    """
    under = F.lit(False)
    for root in roots:
        under = under | F.startswith(F.col("path"), F.lit(root.rstrip("/") + "/")) | (F.col("path") == root)
    return index.where(under).join(found.select("path"), "path", "left_anti").select("path")


def prune(index: DataFrame, found: DataFrame, roots: list[str], absent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The index without files under the roots that a scan did not find and of which ``absent`` says that they are gone."""
    return delete_paths(index, absent(missing_paths(index, found, roots)))


def with_meta(meta: DataFrame, key: str, value: str) -> DataFrame:
    """The key/value table with one entry set."""
    spark = meta.sparkSession
    return meta.where(F.col("key") != key).unionByName(spark.createDataFrame([(key, value)], "key string, value string"))


def seeded_meta(meta: DataFrame, seeds: DataFrame) -> DataFrame:
    """Adds entries whose key is not there yet."""
    return meta.unionByName(seeds.join(meta.select("key"), "key", "left_anti").select("key", "value"))


def meta_value(meta: DataFrame, key: str, default: str = "") -> str:
    row = meta.where(F.col("key") == key).select("value").first()
    return row[0] if row else default

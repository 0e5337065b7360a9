"""Duplicate groups: components of equal bytes and verified similarity, with their keepers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumidex.functions import hashing
from lumidex.functions.numbers import rounded
from lumidex.operators.components import connected_components
from lumidex.operators.ranking import numbered
from lumidex.operators.similarity import exact_links, rotated_pairs, similar_pairs
from lumidex.settings import Settings


GROUP_SCHEMA = "group_index int, root bigint, kind string, best_id bigint, tightness double, n bigint, wasted bigint"
MEMBER_SCHEMA = "group_index int, kind string, id bigint, place int, is_best boolean"


def label(kind: Column, n: Column) -> Column:
    """What a group is called."""
    return F.concat(F.when(kind == "exact", "Identical").otherwise("Similar"), F.lit(" - "), n.cast("string"), F.lit(" photos"))


def keeper_key(prefer_larger: bool = True) -> Column:
    """The best photo has the largest: score to two digits, then pixels, then bytes (0 unless preferred), then age, then least id."""
    pixels = F.col("width").cast("long") * F.col("height").cast("long")
    large = lambda c: c if prefer_larger else F.lit(0).cast("long")
    return F.struct(rounded(F.col("score"), 2).alias("s"), large(pixels).alias("p"), large(F.col("size")).alias("b"), (-F.col("mtime")).alias("m"), (-F.col("id")).alias("i"))


def group_members(df: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``root, id, place, first_phash`` and the photo's facts: members of groups of two or more, in order of score, name and id."""
    s = settings or Settings()
    edges = (rotated_pairs if s.match_rotations else similar_pairs)(df, s).select("a", "b")
    if s.group_exact:
        edges = edges.unionByName(exact_links(df))
    found = connected_components(edges).withColumnRenamed("node", "id")
    facts = df.select("id", "path", "filename", "sha256", "phash", "score", "width", "height", "size", "mtime")
    order = Window.partitionBy("root").orderBy(F.desc("score"), F.asc("filename"), F.asc("id"))
    return found.join(facts, "id").withColumn("place", F.row_number().over(order)).withColumn("first_phash", F.first("phash").over(order))


def duplicate_groups(df: DataFrame, settings: Settings | None = None, members: DataFrame | None = None) -> DataFrame:
    """One row for each group, numbered by bytes wasted, then members, then the best-placed member. ``members`` (of ``group_members``) saves searching for them again."""
    s = settings or Settings()
    members = group_members(df, s) if members is None else members
    distance = hashing.hamming(hashing.halves(F.col("first_phash")), hashing.halves(F.col("phash")))
    exact = (F.count_distinct("sha256") == 1) & (F.min("sha256") != "") if s.group_exact else F.lit(False)
    groups = members.groupBy("root").agg(
        F.count("*").alias("n"),
        F.when(exact, "exact").otherwise("similar").alias("kind"),
        F.max_by("id", keeper_key(s.prefer_larger_on_tie)).alias("best_id"),
        F.max_by("size", keeper_key(s.prefer_larger_on_tie)).alias("best_size"),
        F.sum("size").alias("bytes"),
        F.avg(F.when(F.col("place") > 1, hashing.similarity_percent(distance))).alias("likeness"),
        F.min(F.struct((-F.col("score")).alias("s"), "filename", "id")).alias("lead"),
    )
    groups = groups.withColumn("tightness", F.when(F.col("kind") == "exact", 100.0).otherwise(rounded(F.col("likeness"), 1))).withColumn("wasted", F.col("bytes") - F.col("best_size"))
    return numbered(groups, [F.desc("wasted"), F.desc("n"), F.asc("lead")], "group_index").select("group_index", "root", "kind", "best_id", "tightness", "n", "wasted")


def with_members(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Long form: a row for each photo of each group."""
    return members.join(groups.select("root", "group_index", "kind", "best_id"), "root").select("group_index", "kind", "id", "place", (F.col("id") == F.col("best_id")).alias("is_best"))


def group_statistics(groups: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return groups.agg(
        F.count("*").alias("groups"),
        zero(F.sum("n")).alias("photos_in_groups"),
        zero(F.sum(F.col("n") - 1)).alias("removable"),
        zero(F.sum("wasted")).alias("wasted_bytes"),
        F.count_if(F.col("kind") == "exact").alias("exact_groups"),
    )


def keepers_only(df: DataFrame, long: DataFrame) -> DataFrame:
    """All photos but the members of groups that are not their group's best."""
    return df.join(long.where("NOT is_best").select("id"), "id", "left_anti")


def repaired(long: DataFrame, removed: DataFrame) -> DataFrame:
    """Groups after photos are gone (``id``): those of one member or none vanish, the rest are numbered anew."""
    left = long.join(removed.select("id"), "id", "left_anti")
    counts = left.groupBy("group_index").count().where("count > 1")
    numbers = numbered(counts.select("group_index"), [F.asc("group_index")], "new_index")
    return left.join(numbers, "group_index").drop("group_index").withColumnRenamed("new_index", "group_index")


def marked_for_review(df: DataFrame, long: DataFrame) -> DataFrame:
    """The review action that keeps each group's best: the others are marked ``delete``, the best ``none``."""
    fate = long.select("id", F.when(F.col("is_best"), "none").otherwise("delete").alias("_mark"))
    return df.join(fate, "id", "left").withColumn("mark", F.coalesce("_mark", "mark")).drop("_mark")

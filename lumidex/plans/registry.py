"""All registered queries of the photo index, over a collection derived from the test tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex import workflows
from lumidex.functions import hashing, kernels, quality, text
from lumidex.functions.numbers import mean, rounded
from lumidex.operators import groups, index, ranking, similarity, transfer
from lumidex.plans import photo_sql
from lumidex.session import cut
from lumidex.settings import METRICS, Settings
from lumidex.sources.photo_index import analysed_index, photo_facts, photo_index, rounded_raw

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, Query] = {}


def query(f: Query) -> Query:
    _FOUND[f.__name__] = f
    return f


def _ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photo_index(spark, sf_dir).where("status = 'ok'")


def _ranking(sort: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ranked = ranking.with_rank(_ok(spark, sf_dir), sort)
        extra = ["score", text.grade(F.col("score")).alias("grade")] if sort == "score" else []
        return ranked.select("id", "filename", *extra, "rank")

    return run


for _sort in photo_sql.ORDERS:
    _FOUND[f"rank_{_sort}"] = _ranking(_sort)


@query
def search_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.select_photos(photo_index(spark, sf_dir), search="SRC1/", sort=None).select("id", "path")


@query
def search_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.select_photos(photo_index(spark, sf_dir), search="y_a", sort=None).select("id", "camera")


@query
def filter_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.select_photos(photo_index(spark, sf_dir), flag="noisy", sort=None).select("id", F.array_join("flags", ",").alias("flags"))


@query
def filter_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.select_photos(photo_index(spark, sf_dir), min_score=66, max_score=74, sort=None).select("id", "score")


@query
def filter_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.select_photos(photo_index(spark, sf_dir), mark="keep", sort=None).select("id", "mark")


@query
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.select_photos(photo_index(spark, sf_dir), limit=25).select("id", "score")


@query
def above_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.above_score(photo_index(spark, sf_dir), 75).select("id", "score")


@query
def lookup_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.by_id(photo_index(spark, sf_dir), 44).select("id", "path", "status")


@query
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.signatures(photo_index(spark, sf_dir))


@query
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.digests(photo_index(spark, sf_dir))


@query
def stats_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.statistics(photo_index(spark, sf_dir)).withColumn("mean_score", rounded(F.col("mean_score"), 4))


@query
def stats_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.marks(photo_index(spark, sf_dir))


@query
def stats_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photo_index(spark, sf_dir).agg(F.count("*").alias("photos"), F.count_if(F.col("status") == "ok").alias("usable"))


@query
def percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.percentiles(_ok(spark, sf_dir).select("id", "score")).select("id", "percentile")


@query
def grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("score")
    return _ok(spark, sf_dir).groupBy(text.grade(score).alias("grade"), text.band(score).alias("band")).agg(F.count("*").alias("n"))


def _hash(name: str) -> Query:
    return lambda spark, sf_dir: photo_index(spark, sf_dir).select("id", name)


for _name in ("ahash", "dhash", "phash"):
    _FOUND[_name] = _hash(_name)


@query
def color_sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ok(spark, sf_dir).select("id", F.array_join(F.transform("color_sig", lambda v: v.cast("string")), ",").alias("color_sig"))


@query
def luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photo_facts(spark, sf_dir).select("id", rounded(mean(quality.luma(F.col("red"), F.col("green"), F.col("blue")))).alias("luma"))


@query
def rotated_dhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photo_facts(spark, sf_dir).select("id", hashing.turned(F.col("gray"), 1).alias("turned")).select("id", hashing.dhash(F.col("turned")).alias("dhash_90"))


@query
def rotated_phash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photo_facts(spark, sf_dir).select("id", *[hashing.phash(hashing.turned(F.col("gray"), q)).alias(f"phash_{90 * q}") for q in (1, 2, 3)])


@query
def rotated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh photo also stands turned by a quarter; the other checks are left open."""
    base = photo_facts(spark, sf_dir).where("status = 'ok' AND id <= 1000000").select("id", "gray")
    turned = base.where("id % 7 = 0").select((F.col("id") + 5_000_000).alias("id"), hashing.turned(F.col("gray"), 1).alias("gray"))
    rows = base.unionByName(turned).select("id", F.lit("ok").alias("status"), hashing.phash(F.col("gray")).alias("phash"), F.lit("0" * 16).alias("dhash"), F.array_repeat(F.lit(0), 48).alias("color_sig"), hashing.rotations(F.col("gray")).alias("rotations"))
    return similarity.rotated_pairs(cut(rows), Settings(match_rotations=True, phash_threshold=6))


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ok photos' hashes, materialised once for the several uses of a join."""
    return cut(_ok(spark, sf_dir).select("id", "path", "filename", "sha256", "phash", "dhash", "color_sig", "score", "width", "height", "size", "mtime", "status"))


def _pairs(radius: int, outright: int | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = similarity.hashed(_hashes(spark, sf_dir))
        return similarity.hamming_pairs(rows, rows, radius, outright=outright)

    return run


for _radius in (10, 15):
    _FOUND[f"hamming_pairs_t{_radius}"] = _pairs(_radius)
#: The ways of larger tables: segments, and tiles searched by a metric tree.
_FOUND["hamming_pairs_segments"] = _pairs(10, outright=0)
_FOUND["hamming_pairs_t18"] = _pairs(18, outright=0)


@query
def color_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = _hashes(spark, sf_dir)
    rows = similarity.hashed(photos)
    pairs = similarity.hamming_pairs(rows, rows, 15)
    facts = lambda i: photos.select(F.col("id").alias(i), hashing.halves(F.col("dhash")).alias(f"d{i}"), F.col("color_sig").alias(f"c{i}"))
    both = pairs.join(facts("a"), "a").join(facts("b"), "b")
    both = both.select("a", "b", "distance", hashing.hamming(F.col("da"), F.col("db")).alias("d_distance"), hashing.color_distance(F.col("ca"), F.col("cb")).alias("c"))
    return both.where("d_distance <= 16 AND c <= 0.28").select("a", "b", "distance", "d_distance", rounded(F.col("c")).alias("c_distance"))


@query
def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ok(spark, sf_dir).groupBy("sha256").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


def _grouped(spark: SparkSession, sf_dir: str, settings: Settings = photo_sql.WIDE) -> DataFrame:
    return groups.duplicate_groups(_hashes(spark, sf_dir), settings)


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = _hashes(spark, sf_dir)
    members = cut(groups.group_members(photos, photo_sql.WIDE))
    return groups.with_members(groups.duplicate_groups(photos, photo_sql.WIDE, members), members)


@query
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir, Settings())


@query
def dup_groups_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir)


@query
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir)


@query
def group_keeper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir).select("root", "best_id")


@query
def group_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@query
def group_tightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir).select("root", "tightness")


@query
def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.group_statistics(_grouped(spark, sf_dir))


@query
def keepers_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.keepers_only(_ok(spark, sf_dir).select("id"), _long(spark, sf_dir))


@query
def repaired_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _long(spark, sf_dir)
    return groups.repaired(long, long.where("id % 4 = 1")).select("group_index", "id")


@query
def review_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.marked_for_review(photo_index(spark, sf_dir), _long(spark, sf_dir)).select("id", "mark")


@query
def analyse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes, measures and scores from the planes, every time anew."""
    return analysed_index(spark, sf_dir).select("id", "phash", "dhash", "ahash", "score", F.array_join("flags", ",").alias("flags"))


@query
def rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.rescored(photo_index(spark, sf_dir), photo_sql.OTHER_WEIGHTS).select("id", "score")


@query
def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photo_index(spark, sf_dir).select("id", "score")


@query
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ok(spark, sf_dir).select("id", *[rounded(F.col(f"metrics.{m}")).alias(m) for m in METRICS])


@query
def metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics written as JSON and read back."""
    back = _ok(spark, sf_dir).select("id", quality.metrics_from_json(quality.metrics_json(F.col("metrics"))).alias("m"))
    return back.select("id", *[rounded(F.col(f"m.{m}")).alias(m) for m in METRICS])


@query
def area_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes by box means at sizes that do not divide theirs, in numpy."""

    def resize(batches):
        for pdf in batches:
            planes = [np.array(g).reshape(8, 8) for g in pdf["gray"]]
            yield pd.DataFrame({"id": pdf["id"], "tall": [kernels.area_resize(p, 5, 3).ravel().tolist() for p in planes], "wide": [kernels.area_resize(p, 2, 7).ravel().tolist() for p in planes]})

    made = photo_facts(spark, sf_dir).select("id", "gray").mapInPandas(resize, "id long, tall array<double>, wide array<double>")
    written = lambda c: F.array_join(F.transform(c, lambda v: F.floor(v * 1e6 + 0.5).cast("string")), ",").alias(c)
    return made.select("id", written("tall"), written("wide"))


@query
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes at other sizes: smaller by the triangle and Lanczos filters, larger by the cubic one, in numpy."""
    sizes = {"smaller": (5, 3, kernels.triangle), "shrunk": (3, 4, kernels.lanczos), "larger": (11, 13, kernels.cubic)}

    def resize(batches):
        for pdf in batches:
            planes = [np.array(g).reshape(8, 8) for g in pdf["gray"]]
            yield pd.DataFrame({"id": pdf["id"], **{k: [kernels.resample(p, h, w, kernel).ravel().tolist() for p in planes] for k, (h, w, kernel) in sizes.items()}})

    made = photo_facts(spark, sf_dir).select("id", "gray").mapInPandas(resize, "id long, smaller array<double>, shrunk array<double>, larger array<double>")
    written = lambda c: F.array_join(F.transform(c, lambda v: F.floor(v * 1e6 + 0.5).cast("string")), ",").alias(c)
    return made.select("id", *[written(k) for k in sizes])


@query
def group_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir).select("root", groups.label(F.col("kind"), F.col("n")).alias("label"))


@query
def free_names_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Very many wishes for few names, of which many numbers are taken."""
    rows = photo_facts(spark, sf_dir).select("id", F.concat(F.lit("/out/"), F.col("id") % 3, F.lit(".jpg")).alias("target"))
    taken = rows.where("id % 4 = 1").select(F.concat(F.lit("/out/"), F.col("id") % 3, F.when(F.col("id") % 8 == 1, F.lit("")).otherwise(F.concat(F.lit("-"), F.col("id") % 1000)), F.lit(".jpg")).alias("path"))
    return transfer.free_names(rows, taken)


@query
def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photo_index(spark, sf_dir).select("id", F.array_join("flags", ",").alias("flags"))


def _measure(*columns: str) -> Query:
    return lambda spark, sf_dir: photo_index(spark, sf_dir).select("id", *[rounded_raw(c) for c in columns])


_MEASURES = {"entropy": "entropy", "laplacian": "laplacian_variance", "edge": "edge_strength", "noise_sigma": "noise_sigma", "grain": "grain_ratio", "colorfulness": "colorfulness"}
for _name, _column in _MEASURES.items():
    _FOUND[_name] = _measure(_column)
_FOUND["exposure"] = _measure("mean_luma", "shadow_clip", "highlight_clip", "contrast_std")


@query
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third photo found changed, every fiftieth found under a new path."""
    old = cut(photo_facts(spark, sf_dir).select("id", "path", "filename", "size", "mtime", "mark", "rating"))
    changed = old.where("id % 3 = 0").selectExpr("path", "size + 7 AS size", "mtime + 60 AS mtime")
    new = old.where("id % 50 = 1").selectExpr("concat('/photos/new/', filename) AS path", "size", "mtime")
    return index.upsert(old.drop("filename"), changed.unionByName(new))


@query
def scan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = photo_facts(spark, sf_dir).select("id", "path", "filename", "size", "mtime", "status")
    found = old.selectExpr("if(id % 11 = 0, concat('/photos/new/', filename), path) AS path", "size + if(id % 6 = 0, 1, 0) AS size", "mtime")
    return index.scan_difference(found, old)


@query
def prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of one folder that finds every other photo; of those not found every third is still there."""
    old = photo_facts(spark, sf_dir).select("id", "path")
    still = old.where("id % 6 = 0").select("path")
    return index.prune(old, old.where("id % 2 = 1"), ["/photos/src1"], lambda lost: lost.join(still, "path", "left_anti"))


@query
def mark_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = photo_facts(spark, sf_dir).select("id", "mark")
    return index.set_mark(old, old.where("id % 8 = 0"), "keep")


@query
def bulk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = photo_index(spark, sf_dir).select("id", "score")
    return index.set_scores(old, old.where("id % 4 = 0").selectExpr("id", "cast(id % 100 AS double) AS score"))


@query
def delete_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = photo_facts(spark, sf_dir).select("id", "path")
    return index.delete_paths(old, old.where("id % 9 = 4")).select("id")


def _batch_and_known(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    photos = _hashes(spark, sf_dir)
    new = (F.col("id") > 1_000_000) | (F.col("id") % 5 == 2)
    return photos.where(new).withColumn("ord", F.col("id")), photos.where(~new)


@query
def import_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, known = _batch_and_known(spark, sf_dir)
    return transfer.exact_import(batch.select("ord", "path", "sha256"), index.digests(known)).select("path", "outcome")


@query
def import_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, known = _batch_and_known(spark, sf_dir)
    return transfer.similar_import(batch, known, photo_sql.WIDE).select("id", "outcome")


@query
def import_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-alikes in the index: the one of the highest score is the match."""
    batch, known = _batch_and_known(spark, sf_dir)
    told = transfer.similar_import(batch, known, photo_sql.WIDE).where("outcome = 'similar'").select("id", "match")
    return told.join(known.select(F.col("id").alias("match")), "match", "left_semi").select("id", "match")


@query
def import_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files at the destination: those of every third photo, of which every other one has other bytes."""
    photos = photo_facts(spark, sf_dir).select("id", "sha256", transfer.destination("/library", "flat").alias("target"))
    there = photos.where("id % 3 = 0").selectExpr("target AS path", "if(id % 2 = 0, sha256, sha2(sha256, 256)) AS sha256")
    return transfer.present_at_destination(photos, there).select("id", "outcome", "match")


@query
def outside_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer.outside_library(photo_facts(spark, sf_dir).select("id", "path"), "/photos/src1/").select("id")


@query
def export_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export in folders of groups, under names that differ."""
    ranked = ranking.with_rank(_ok(spark, sf_dir))
    return transfer.export_plan(ranked, "/out/", "rank", _long(spark, sf_dir)).select("id", "target")


@query
def export_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = workflows.preview(ranking.above_score(photo_index(spark, sf_dir), 70))
    return totals.withColumns({"megapixels": rounded(F.col("megapixels")), "mean_score": rounded(F.col("mean_score"), 4)})


@query
def import_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = {"by_date": ("date", None), "by_source": ("source", "/data/photos"), "flat": ("flat", None)}
    here = photo_facts(spark, sf_dir).withColumn("path", F.concat(F.lit("/data"), "path"))
    return here.select("id", *[transfer.destination("/library", how, root).alias(name) for name, (how, root) in plans.items()])


@query
def free_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies take the names of their originals and have to give way."""
    rows = photo_facts(spark, sf_dir).select("id", F.concat(F.lit("/out/"), F.format_string("%03d.jpg", F.col("id") % 300)).alias("target"))
    return transfer.free_names(rows)


@query
def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.with_rank(_ok(spark, sf_dir))
    return ranked.select("id", *[transfer.export_name(n).alias(f"by_{n}") for n in ("rank", "score", "date")])


@query
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer.manifest(ranking.with_rank(_ok(spark, sf_dir)), _long(spark, sf_dir), "rank")


@query
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, width, height = F.col("size"), F.col("width"), F.col("height")
    return photo_facts(spark, sf_dir).select(
        "id",
        rounded(text.megapixels(width, height)).alias("megapixels"),
        text.human_size(size).alias("human_size"),
        text.folder(F.col("path")).alias("folder"),
        rounded(text.bytes_per_pixel(size, width, height), 9).alias("bytes_per_pixel"),
        text.aspect(width, height).alias("aspect"),
    )


@query
def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a photo is labelled with: camera, summary, parsed time, the key of its thumbnail."""
    told = photo_facts(spark, sf_dir).withColumn("told", F.when(F.col("id") % 4 == 0, F.date_format("taken_at", "yyyy:MM:dd HH:mm:ss")).when(F.col("id") % 4 == 1, F.date_format("taken_at", "yyyy-MM-dd HH:mm:ss")).when(F.col("id") % 4 == 2, F.date_format("taken_at", "yyyy:MM:dd")).otherwise("once"))
    return told.select(
        "id",
        text.camera_label(F.element_at(F.split("camera", "[ _]"), 1), F.col("camera")).alias("label"),
        text.summary(F.col("width"), F.col("height"), F.col("camera"), F.col("taken_at")).alias("summary"),
        F.date_format(text.parsed_time(F.col("told")), "yyyy-MM-dd HH:mm:ss").alias("parsed"),
        text.thumbnail_key(F.col("path"), 256, F.col("mtime")).alias("thumbnail"),
    )


@query
def all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photo_index(spark, sf_dir).select("path")


@query
def edited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single edits one after the other: marks cleared, one set and one set back, ratings held to their range, a file renamed."""
    rows = index.clear_marks(photo_facts(spark, sf_dir).select("id", "path", "filename", "mark", "rating"))
    rows = index.toggle_mark(index.toggle_mark(index.toggle_mark(rows, 3, "keep"), 4, "delete"), 4, "delete")
    rows = index.set_rating(index.set_rating(rows, 5, 99), 6, -3)
    name = rows.where("id = 7").select("path").first()
    return index.rename_path(rows, name[0] if name else "", "/moved/new.jpg")


def queries() -> dict[str, Query]:
    return dict(_FOUND)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in photo_sql.statements().items() if k in _FOUND}

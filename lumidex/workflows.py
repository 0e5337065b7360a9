"""Scans, imports and exports from end to end: operators and file sources put together, with what came of them."""

from __future__ import annotations

import datetime
import time
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.cancellation import Cancellation, Stopped
from lumidex.functions import text
from lumidex.operators import groups, index, ranking, transfer
from lumidex.session import counted, cut
from lumidex.settings import Settings
from lumidex.sources import files
from lumidex.sources.folders import absent, plain_path
from lumidex.sources.photo_index import read_index, update_index

#: Rows of rejects and failures that a result holds for display; their numbers count all.
SHOWN = 1000
#: Files of one batch: what a scan commits at once, and an import or export places.
BATCH_FILES = 100_000


def human_size(size: float) -> str:
    """As ``functions.text.human_size``, for one number."""
    for unit in ("B", "KB", "MB", "GB"):
        if size < 1024:
            return f"{size:.0f} {unit}" if unit == "B" or size >= 100 else f"{size:.1f} {unit}"
        size /= 1024
    return f"{size:.0f} TB" if size >= 100 else f"{size:.1f} TB"


@dataclass
class ScanResult:
    scanned: int = 0
    indexed: int = 0
    failed: int = 0
    skipped: int = 0
    removed: int = 0
    seconds: float = 0.0
    cancelled: bool = False
    errors: list[tuple[str, str]] = field(default_factory=list)

    def summary(self) -> str:
        if self.cancelled:
            return f"Scan cancelled - {self.indexed} new, {self.skipped} unchanged, {self.failed} failed"
        more = [f"{n} {what}" for n, what in ((self.removed, "gone"), (self.failed, "failed")) if n]
        told = ", ".join([f"{self.indexed} analysed", f"{self.skipped} unchanged", *more])
        return f"{self.scanned} photos: {told} in {self.seconds:.1f}s"


@dataclass
class ImportResult:
    imported: int = 0
    skipped_duplicate: int = 0
    skipped_similar: int = 0
    failed: int = 0
    moved: bool = False
    bytes_copied: int = 0
    seconds: float = 0.0
    cancelled: bool = False
    errors: list[tuple[str, str]] = field(default_factory=list)
    files: list[tuple[str, str]] = field(default_factory=list)
    rejected: list[tuple[str, str, str]] = field(default_factory=list)

    def summary(self) -> str:
        more = [f"{n} {what}" for n, what in ((self.skipped_duplicate, "already in library"), (self.skipped_similar, "near-duplicates skipped"), (self.failed, "failed")) if n]
        return ", ".join([f"Import {'cancelled' if self.cancelled else 'complete'} - {self.imported} {'moved' if self.moved else 'copied'}", *more])


@dataclass
class ExportResult:
    exported: int = 0
    failed: int = 0
    bytes_written: int = 0
    seconds: float = 0.0
    destination: str = ""
    manifest: str = ""
    cancelled: bool = False
    errors: list[tuple[str, str]] = field(default_factory=list)

    def summary(self) -> str:
        more = [f"{self.failed} failed"] if self.failed else []
        return ", ".join([f"Export {'cancelled' if self.cancelled else 'complete'} - {self.exported} photos", *more, *([human_size(self.bytes_written)] if self.bytes_written else [])])


def _shown(rows: DataFrame, n: int, *columns: str) -> list[tuple]:
    """The first rows by path, for display; no job where it is known that there are none."""
    return [tuple(r) for r in rows.orderBy("path").limit(SHOWN).select(*columns).collect()] if n else []


def _in_batches(rows: DataFrame, total: int, size: int, order: str) -> Iterator[DataFrame]:
    """The rows in runs of ``size``, in order."""
    if total <= size:
        yield rows
        return
    numbered = cut(ranking.numbered(rows, [F.asc(order)], "nth"))
    for first in range(0, total, size):
        yield numbered.where((F.col("nth") > first) & (F.col("nth") <= first + size)).drop("nth")


def scan(spark: SparkSession, root: str, folders: list[str], settings: Settings, force: bool = False, prune: bool = True, cancellation: Cancellation | None = None, batch_files: int = BATCH_FILES) -> ScanResult:
    """Indexes what is new or changed under the folders and drops what is gone.

    Files are analysed in batches, and each is a version of the index; a scan that is stopped keeps
    those that are done, drops nothing, and the next one goes on from there. A row whose file is still
    there stays, whether or not the settings would find it now.
    """
    began, stop = time.time(), cancellation or Cancellation()
    result = ScanResult(cancelled=True)
    with stop.over(spark):
        stop.step(0, 0, "Looking for photos...")
        found = cut(files.list_files(spark, folders, settings))
        todo, n = counted(index.scan_difference(found, read_index(spark, root), force), scanned=F.count("*"), skipped=F.count_if(F.col("action") == "skip"))
        result.scanned, result.skipped = n["scanned"], n["skipped"]
        total, done = result.scanned - result.skipped, 0
        for batch in _in_batches(todo.where("action != 'skip'").drop("action"), total, batch_files, "path") if total else ():
            stop.step(done, total, "Analysing photos")
            ok = F.col("status") == "ok"
            facts, n = counted(files.analyse_files(spark, batch, settings).withColumn("indexed_at", F.lit(began)), indexed=F.count_if(ok), failed=F.count_if(~ok))
            update_index(spark, root, lambda current, facts=facts: index.upsert(current, facts))
            result.indexed, result.failed, done = result.indexed + n["indexed"], result.failed + n["failed"], done + n["indexed"] + n["failed"]
            result.errors += _shown(facts.where(~ok), n["failed"], "path", "error")
        stop.step(total, total, "Looking for photos that are gone")
        if prune:
            current = read_index(spark, root)
            gone, n = counted(absent(index.missing_paths(current, found, [plain_path(f) for f in folders])), rows=F.count("*"))
            if n["rows"]:
                update_index(spark, root, lambda current: index.delete_paths(current, gone))
            result.removed = n["rows"]
        result.cancelled = False
    return replace(result, seconds=time.time() - began)


def preview(photos: DataFrame) -> DataFrame:
    """What a selection would come to before it is exported or deleted: photos, bytes, megapixels, mean score."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return photos.agg(F.count("*").alias("photos"), zero(F.sum("size")).alias("bytes"), zero(F.sum(text.megapixels(F.col("width"), F.col("height")))).alias("megapixels"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"))


def import_photos(spark: SparkSession, root: str, sources: list[str], settings: Settings, dry_run: bool = False, cancellation: Cancellation | None = None, batch_files: int = BATCH_FILES) -> ImportResult:
    """Copies or moves what is under the sources into the library, but for duplicates of the index, of earlier files and of files at their destination.

    Files go in order of source, then path. With ``import_skip_similar`` look-alikes stay out too,
    and files that cannot be decoded fail; without it no picture is decoded. Nothing is written in a
    dry run. An import that is stopped tells what it has placed.
    """
    began, stop = time.time(), cancellation or Cancellation()
    result = ImportResult(moved=settings.import_mode == "move", cancelled=True)
    with stop.over(spark):
        stop.step(0, 0, "Looking for photos to import...")
        plan, total = _import_plan(spark, root, sources, settings, dry_run, result)
        for placed in _placed(plan, total, settings.import_mode, 0, dry_run, stop, batch_files, "Importing photos"):
            placed, n = counted(placed, rows=F.count("*"), fine=F.count_if(F.col("error") == ""), bytes=F.sum(F.when(F.col("error") == "", F.col("bytes"))))
            result.imported, result.bytes_copied = result.imported + n["fine"], result.bytes_copied + n["bytes"]
            result.failed += n["rows"] - n["fine"]
            result.files += _shown(placed.where("error = ''"), n["fine"], "path", "target")
            result.errors += _shown(placed.where("error != ''"), n["rows"] - n["fine"], "path", "error")
        result.cancelled = stop.asked
    return replace(result, seconds=time.time() - began)


def _import_plan(spark: SparkSession, root: str, sources: list[str], settings: Settings, dry_run: bool, result: ImportResult) -> tuple[DataFrame | None, int]:
    """``path, target, ord, size`` of what is to be placed, and how many that are; what is turned away goes into the result."""
    sources = [plain_path(s) for s in sources]
    library = plain_path(settings.library_root)
    photos = cut(read_index(spark, root))
    found, n = counted(transfer.outside_library(files.list_files(spark, sources, settings), library), rows=F.count("*"))
    if not n["rows"]:
        return None, 0
    source = F.lit(len(sources))
    for i in range(len(sources) - 1, -1, -1):
        source = F.when(F.startswith(F.col("path"), F.lit(sources[i] + "/")) | (F.col("path") == sources[i]), i).otherwise(source)

    def failed(rows: DataFrame, n: int) -> None:
        result.failed += n
        result.errors += _shown(rows, n, "path", "error")

    read = files.read_facts(found).select("path", "sha256", F.col("capture.taken_at").alias("taken_at"), F.col("unread").alias("error"))
    batch = found.join(read, "path").withColumn("source", source).withColumn("ord", F.struct("source", "path"))
    batch, n = counted(batch, unread=F.count_if(F.col("error") != ""))
    failed(batch.where("error != ''"), n["unread"])
    batch = batch.where("error = ''").drop("error")
    turned_away = F.col("outcome") != "import"
    if settings.import_skip_exact:
        batch, n = counted(transfer.exact_import(batch, index.digests(photos)), away=F.count_if(turned_away))
        result.skipped_duplicate += n["away"]
        result.rejected += _shown(batch.where(turned_away).withColumn("why", F.lit("identical file")), n["away"], "path", "why", "match")
        batch = batch.where("outcome = 'import'").drop("outcome", "match")
    if settings.import_skip_similar:
        looks = files.analyse_files(spark, batch.select("path", "size", "mtime"), settings).select("path", "phash", "dhash", "color_sig", "rotations", "status", "error")
        batch, n = counted(batch.join(looks, "path"), broken=F.count_if(F.col("status") != "ok"))
        failed(batch.where("status != 'ok'"), n["broken"])
        most = photos.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        numbered = cut(ranking.numbered(batch.where("status = 'ok'").drop("error"), [F.asc("ord")], "nth").withColumn("id", (F.col("nth") + most).cast("long")).drop("nth"))
        fates, n = counted(transfer.similar_import(numbered, photos, settings), away=F.count_if(turned_away))
        result.skipped_similar += n["away"]
        names = photos.select(F.col("id").alias("match"), F.col("path").alias("like")).unionByName(numbered.select(F.col("id").alias("match"), F.col("path").alias("like")))
        result.rejected += _shown(fates.where(turned_away).join(names, "match", "left").withColumn("why", F.lit("looks the same as")), n["away"], "path", "why", "like")
        batch = fates.where("outcome = 'import'").drop("outcome", "match", "id")
    target = F.lit(None).cast("string")
    for i in range(len(sources) - 1, -1, -1):
        target = F.when(F.col("source") == i, transfer.destination(library, settings.import_organise, sources[i])).otherwise(target)
    batch = cut(batch.withColumn("target", F.coalesce(target, transfer.destination(library, "flat"))))
    standing = cut(files.list_files(spark, [library], replace(settings, min_file_bytes=0)))
    if settings.import_skip_exact and not dry_run:
        there = files.digests(spark, standing.join(batch.select(F.col("target").alias("path")), "path", "left_semi"))
        batch, n = counted(transfer.present_at_destination(batch, there), away=F.count_if(turned_away))
        result.skipped_duplicate += n["away"]
        result.rejected += _shown(batch.where(turned_away).withColumn("why", F.lit("identical file")), n["away"], "path", "why", "match")
        batch = batch.where("outcome = 'import'").drop("outcome", "match")
    plan, n = counted(transfer.free_names(batch.select("path", "target", "ord", "size"), standing.select("path").unionByName(photos.select("path")), order="ord"), rows=F.count("*"))
    return plan, n["rows"]


def _placed(plan: DataFrame | None, total: int, mode: str, max_edge: int, dry_run: bool, stop: Cancellation, size: int, message: str) -> Iterator[DataFrame]:
    """What came of each batch of a plan, as ``files.place_files`` tells it. Of a batch that is stopped it is what stands at the targets; nothing follows it."""
    done = 0
    for batch in _in_batches(plan, total, size, "ord") if total else ():
        try:
            stop.step(done, total, message)
        except Stopped:
            return
        if dry_run:
            yield batch.select("path", "target", F.col("size").alias("bytes"), F.lit("").alias("error"))
        else:
            batch = cut(batch)
            try:
                placed = files.place_files(batch, mode, max_edge)
            except Exception:
                if not stop.asked:
                    raise
                yield files.placed_so_far(batch)
                return
            yield placed
        done += size


def export_photos(spark: SparkSession, ranked: DataFrame, target: str, settings: Settings, long: DataFrame | None = None, cancellation: Cancellation | None = None, batch_files: int = BATCH_FILES) -> ExportResult:
    """Places a ranking (with ``rank``) under the target, in folders of groups if asked for, with a manifest of what was placed, also where it is stopped before the end."""
    began, stop = time.time(), cancellation or Cancellation()
    target = plain_path(target)
    result = ExportResult(destination=target, cancelled=True)
    done = None
    with stop.over(spark):
        plan = transfer.export_plan(ranked, target, settings.export_naming, long if settings.export_group_folders else None)
        plan, n = counted(plan.join(ranked.select("id", F.col("rank").alias("ord")), "id"), rows=F.count("*"))
        for placed in _placed(plan, n["rows"], settings.export_mode, settings.export_max_edge, False, stop, batch_files, "Exporting photos"):
            placed, n = counted(placed, rows=F.count("*"), fine=F.count_if(F.col("error") == ""), bytes=F.sum(F.when(F.col("error") == "", F.col("bytes"))))
            result.exported, result.bytes_written = result.exported + n["fine"], result.bytes_written + n["bytes"]
            result.failed += n["rows"] - n["fine"]
            result.errors += _shown(placed.where("error != ''"), n["rows"] - n["fine"], "path", "error")
            fine = placed.where("error = ''").select("path", "target")
            done = fine if done is None else done.unionByName(fine)
        result.cancelled = stop.asked
    if result.exported and settings.export_manifest != "none":
        named = ranked.join(plan.select("id", "path").join(done, "path").select("id", "target"), "id")
        rows = transfer.manifest(named, long, settings.export_naming, "target")
        stamp = datetime.datetime.now()
        path = f"{target}/export-{stamp:%Y%m%d-%H%M%S}.{settings.export_manifest}"
        if settings.export_manifest == "json":
            files.write_manifest_json(rows, path, settings.export_naming, settings.export_mode, stamp.isoformat(timespec="seconds"))
        else:
            files.write_manifest_csv(rows, path)
        result.manifest = path
    return replace(result, seconds=time.time() - began)


def long_groups(photos: DataFrame, settings: Settings, cancellation: Cancellation | None = None) -> tuple[DataFrame, DataFrame]:
    """The groups and their members, from one search; none of either if the search is stopped."""
    stop = cancellation or Cancellation()
    spark = photos.sparkSession
    with stop.over(spark):
        stop.step(0, 0, "Comparing photos")
        members = cut(groups.group_members(photos, settings))
        found = cut(groups.duplicate_groups(photos, settings, members))
        return found, cut(groups.with_members(found, members))
    return spark.createDataFrame([], groups.GROUP_SCHEMA), spark.createDataFrame([], groups.MEMBER_SCHEMA)

"""Files in and out: digests, decoding and placement.

Decoding uses Spark's image source, so it reads what that reads (JPEG, PNG, GIF, BMP). There is no
HEIC, WebP or AVIF, and of the formats only PNG is written, without an imaging library, which this environment does
not have.
"""

from __future__ import annotations

import contextlib
import filecmp
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.functions import kernels, quality, text
from lumidex.session import cut, shared_folder
from lumidex.settings import Settings
from lumidex.sources import exif
from lumidex.sources.folders import entry, is_store, list_files, read_facts, suffix
from lumidex.sources.manifests import write_manifest_csv, write_manifest_json

#: Pictures that are decoded by one read of Spark's image source: so many paths come to the driver at once.
PICTURES = 20_000
#: Types of a file's facts after analysis; the index adds ids, marks and ratings.
_ANALYSED = (
    "path string, sha256 string, width int, height int, phash string, dhash string, ahash string, color_sig array<int>, rotations array<string>, "
    "raw_metrics map<string,double>, status string, error string"
)


def count_files(spark: SparkSession, roots: list[str], settings: Settings | None = None) -> int:
    return list_files(spark, roots, settings).count()


def digests(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """``path, sha256`` of the files in ``paths`` that can be read; no other file is opened."""
    return read_facts(paths, facts=False).where("unread = ''").select("path", "sha256")


def _set_aside(names: list[str], folder: str) -> dict[str, str]:
    """Copies of files whose names Spark's sources pass over, under names that they read: by copy, the path."""
    os.makedirs(folder, exist_ok=True)
    out = {}
    for n, path in enumerate(names):
        with contextlib.suppress(OSError):
            out[shutil.copyfile(path, os.path.join(folder, f"{n}{suffix(path)}"))] = path
    return out


def _verbatim(path: str) -> str:
    """The path as a pattern that matches nothing else."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _pictures(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """``path, height, width, channels, data`` of the pictures at ``paths``, decoded by Spark's image source, which is given these paths alone.

    Paths come to the driver ``PICTURES`` at a time, as a source wants them. Files that cannot be decoded or are gone give no row. The source passes
    over names that begin with ``_`` or ``.``: such files are copied to the shared folder under other names.
    """
    # the source writes paths as URIs, in which a plus is no space
    plain = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    seen = lambda c: F.coalesce(F.try_element_at(c, F.col("path")), F.col("path"))
    out = spark.createDataFrame([], "path string, height int, width int, channels int, data binary")
    names = (r.path for r in paths.select("path").distinct().toLocalIterator())
    while some := list(islice(names, PICTURES)):
        passed = [n for n in some if os.path.basename(n)[:1] in ("_", ".") and not is_store(n)]
        aside = _set_aside(passed, f"{shared_folder(spark)}/aside-{uuid.uuid4().hex}") if passed else {}
        wanted = [*(n for n in some if n not in aside.values()), *aside]
        source = spark.read.format("image").option("dropInvalid", True).option("ignoreMissingFiles", True)
        try:
            read = source.load(list(map(_verbatim, wanted)))
        except AnalysisException:  # some have gone meanwhile
            there = [n for n in wanted if entry(n) is not None]
            if not there:
                continue
            read = source.load(list(map(_verbatim, there)))
        rows = read.select(plain(F.col("image.origin")).alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
        if aside:
            rows = rows.withColumn("path", seen(F.create_map(*[F.lit(x) for pair in aside.items() for x in pair])))
        out = out.unionByName(rows)
    return out


def analyse_files(spark: SparkSession, paths: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Facts of the files in ``paths`` (``path, size, mtime``), ready for ``operators.index.upsert``.

    Only these files are opened: once by tasks for digest and capture facts and once, decoded, for hashes and
    measures, in Arrow batches of a few pictures, which are turned upright first. A file that cannot be read or decoded
    becomes a row of status ``error``.
    """
    s = settings or Settings()
    paths = cut(paths)
    if paths.isEmpty():
        return spark.createDataFrame([], _ANALYSED)
    facts = cut(read_facts(paths))
    pictures = _pictures(spark, facts.where("unread = ''")).join(facts.select("path", F.col("capture.orientation").alias("orientation")), "path")
    measured = pictures.mapInPandas(_analyse_batch, _ANALYSED.replace("sha256 string, ", ""))
    rows = paths.join(facts, "path", "left").join(measured, "path", "left")
    rows = rows.withColumns({"camera": text.camera_label(F.col("capture.make"), F.col("capture.model")), "iso": F.col("capture.iso"), "taken_at": F.col("capture.taken_at")}).drop("capture")
    raw = F.struct(*[F.coalesce(F.col("raw_metrics")[k], F.lit(0.0)).alias(k) for k in ("edge_strength", "laplacian_variance", "mean_luma", "shadow_clip", "highlight_clip", "contrast_std", "colorfulness", "noise_sigma", "grain_ratio", "megapixels", "entropy")])
    rows = rows.withColumn("_raw", raw)
    rows = rows.withColumn("metrics", F.struct(*[c.alias(k) for k, c in quality.metrics(F.col("_raw")).items()]))
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    return rows.withColumns(
        {
            "filename": text.basename(F.col("path")),
            "format": F.upper(F.regexp_extract("path", r"\.([^./]+)$", 1)),
            "flags": F.when(ok, quality.flags(F.col("_raw"), F.col("metrics"), F.col("iso"))).otherwise(F.array().cast("array<string>")),
            "score": F.when(ok, quality.score(F.col("metrics"), F.col("iso"), s.weights)).otherwise(0.0),
            "metrics": F.when(ok, F.col("metrics")),
            "status": F.when(ok, "ok").otherwise("error"),
            "error": F.when(ok, "").otherwise(F.coalesce(F.nullif(F.col("unread"), F.lit("")), "error", F.lit("cannot be decoded"))),
        }
    ).drop("_raw", "unread")


def _analyse_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame([_analyse_one(*r) for r in zip(pdf["path"], pdf["height"], pdf["width"], pdf["channels"], pdf["data"], pdf["orientation"])], columns=["path", "width", "height", "phash", "dhash", "ahash", "color_sig", "rotations", "raw_metrics", "status", "error"])


def _analyse_one(path: str, height: int, width: int, channels: int, data: bytes, orientation: float | None = None) -> tuple:
    blank = ("", "", "", None, None, None)
    if height is None or height <= 0 or width <= 0 or channels not in (1, 3, 4):
        return (path, 0, 0, *blank, "error", "cannot be decoded")
    rgb = _pixels(height, width, channels, data, orientation)
    height, width = rgb.shape[:2]
    rgb = kernels.scaled(rgb) / 255.0
    gray = kernels.luminance(rgb)
    f = kernels.fingerprint(gray, rgb)
    return (path, width, height, f["phash"], f["dhash"], f["ahash"], f["color_sig"], f["rotations"], kernels.measure(gray, rgb, width * height / 1e6), "ok", "")


def _pixels(height: int, width: int, channels: int, data: bytes, orientation: float | None) -> np.ndarray:
    """Upright red, green and blue of a decoded picture, 0 to 255."""
    pixels = np.frombuffer(bytes(data), np.uint8).reshape(int(height), int(width), int(channels))
    # the image source stores blue, green, red (and opacity)
    rgb = np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[..., 2::-1]
    mirrored, quarters = exif.upright_steps(None if orientation is None or orientation != orientation else int(orientation))
    return np.ascontiguousarray(np.rot90(rgb[:, ::-1] if mirrored else rgb, quarters))


def place_files(plan: DataFrame, mode: str = "copy", max_edge: int = 0) -> DataFrame:
    """Carries out a plan (``path, target``) by copy, move or symlink: ``path, target, bytes, error``, one row for each, error empty where it went well.

    Tasks place files side by side, as targets differ; run again after a lost executor, a file that
    is there already counts as placed. Nothing is written over. With ``max_edge`` copies are written anew, upright, with no edge longer than that, as
    PNG; other formats want an encoder that is not there and fail, and a link cannot be resized at all.
    """
    if max_edge > 0 and mode != "symlink":
        return _place_resized(plan, mode, max_edge)
    refused = "cannot resize when exporting as symbolic links" if max_edge > 0 else ""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, t, *((0, refused) if refused else _place_one(p, t, mode))) for p, t in zip(pdf["path"], pdf["target"])]
            yield pd.DataFrame(rows, columns=["path", "target", "bytes", "error"])

    return cut(plan.select("path", "target").mapInPandas(place, "path string, target string, bytes long, error string"))


def placed_so_far(plan: DataFrame) -> DataFrame:
    """What of a plan stands at its target, as ``place_files`` tells it: after a run that was stopped, whose rows are not known."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, t, os.stat(t).st_size, "") for p, t in zip(pdf["path"], pdf["target"]) if os.path.lexists(t) and os.path.exists(t)]
            yield pd.DataFrame(rows, columns=["path", "target", "bytes", "error"])

    return cut(plan.select("path", "target").mapInPandas(look, "path string, target string, bytes long, error string"))


def _place_resized(plan: DataFrame, mode: str, max_edge: int) -> DataFrame:
    spark, schema = plan.sparkSession, "path string, target string, bytes long, error string"
    plan = cut(plan.select("path", "target").withColumn("png", text.extension(F.col("target")) == ".png"))
    facts = cut(read_facts(plan.where("png").select("path").distinct()).where("unread = ''").select("path", F.col("capture.orientation").alias("orientation")))
    pictures = _pictures(spark, facts).join(facts, "path")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, t, png, height, width, channels, data, orientation in zip(*(pdf[c] for c in ("path", "target", "png", "height", "width", "channels", "data", "orientation"))):
                if not png:
                    rows.append((p, t, 0, "only PNG files can be written anew"))
                elif data is None:
                    rows.append((p, t, 0, "cannot be decoded" if os.path.exists(p) else f"No such file: {p}"))
                else:
                    rows.append((p, t, *_written(p, t, mode, _pixels(height, width, channels, data, orientation), max_edge)))
            yield pd.DataFrame(rows, columns=["path", "target", "bytes", "error"])

    return cut(plan.join(pictures, "path", "left").mapInPandas(place, schema))


def _written(path: str, target: str, mode: str, rgb: np.ndarray, max_edge: int) -> tuple[int, str]:
    try:
        made = kernels.png(kernels.within(rgb, max_edge))
        to = Path(target)
        to.parent.mkdir(parents=True, exist_ok=True)
        if to.exists() and to.read_bytes() != made:
            return 0, "something else stands at the target"
        half = to.with_name(f".{to.name}.{uuid.uuid4().hex}")
        half.write_bytes(made)
        os.replace(half, to)
        if mode == "move":
            with contextlib.suppress(FileNotFoundError):
                os.remove(path)
        return len(made), ""
    except OSError as e:
        return 0, str(e)


def _place_one(path: str, target: str, mode: str) -> tuple[int, str]:
    to = Path(target)
    try:
        to.parent.mkdir(parents=True, exist_ok=True)
        if mode == "symlink":
            source = os.path.realpath(path)
            if not (to.is_symlink() and os.readlink(to) == source):
                to.symlink_to(source)
        elif to.exists():
            if mode == "move" and not Path(path).exists():
                return to.stat().st_size, ""
            if mode == "move" or not filecmp.cmp(path, to, shallow=False):
                return 0, "something else stands at the target"
        else:
            # beside the target first, so that half a file never has its name
            half = to.with_name(f".{to.name}.{uuid.uuid4().hex}")
            shutil.copy2(path, half)
            os.replace(half, to)
            if mode == "move":
                os.remove(path)
        return to.stat().st_size, ""
    except OSError as e:
        return 0, str(e)


def delete_files(paths: DataFrame) -> tuple[int, list[tuple[str, str]]]:
    """Unlinks files; returns how many went and what failed. A file that is gone already counts as neither."""

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fates = []
            for p in pdf["path"]:
                try:
                    Path(p).unlink()
                    fates.append((p, ""))
                except FileNotFoundError:
                    fates.append((p, None))
                except OSError as e:
                    fates.append((p, str(e)))
            yield pd.DataFrame(fates, columns=["path", "error"])

    fates = cut(paths.select("path").mapInPandas(remove, "path string, error string"))
    failed = [(r.path, r.error) for r in fates.where("error != ''").collect()]
    return fates.where("error = ''").count(), failed


__all__ = ["analyse_files", "count_files", "delete_files", "digests", "list_files", "place_files", "placed_so_far", "read_facts", "write_manifest_csv", "write_manifest_json"]

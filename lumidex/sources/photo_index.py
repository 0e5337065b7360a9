"""The photo index: its schema, its files, and a derived collection over the test tables.

The index is a directory of versions, each a Parquet table; a new version is written beside the
old ones and becomes current when its commit file is there, so readers never see a half. A commit
file appears whole, under the number after the version that the writer has read, or not at all if that number is
taken: of two writers that start from one version the second is told so, and starts again from the
first one's version (``update_index``). The file also tells which batch of each stream is in the index.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.functions import hashing, quality, text
from lumidex.functions.numbers import rounded
from lumidex.session import cut
from lumidex.settings import METRICS, Weights

_METRIC_STRUCT = "struct<" + ",".join(f"{m}:double" for m in METRICS) + ">"
SCHEMA = (
    "id bigint, path string, filename string, size bigint, mtime double, sha256 string, width int, height int, format string, "
    "taken_at timestamp_ntz, camera string, iso int, phash string, dhash string, ahash string, color_sig array<int>, rotations array<string>, "
    f"score double, metrics {_METRIC_STRUCT}, raw_metrics map<string,double>, flags array<string>, mark string, rating int, "
    "thumbnail string, indexed_at double, status string, error string"
)
MARKS = ("none", "keep", "delete")


def empty_index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


class Conflict(RuntimeError):
    """Another writer has made a new version meanwhile."""


def read_index(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The current version, or that one; an empty index if there is none."""
    version = current_version(spark, root) if version is None else version
    return spark.read.schema(SCHEMA).parquet(_commit(spark, root, version)["data"]) if version else empty_index(spark)


def current_version(spark: SparkSession, root: str) -> int:
    """The number of the last finished version, 0 if there is none."""
    return max(_numbers(spark, root)[0], default=0)


def write_index(df: DataFrame, root: str, base: int | None = None, batch: tuple[str, int] | None = None) -> int:
    """Writes the next version and returns its number; what is being read stays as it is.

    ``base`` is the version that ``df`` was made from: if it is not the current one any more, that is
    a ``Conflict`` and nothing changes. Without it the version goes on top of whatever is there. ``batch``
    names a stream and the number of its batch that is in ``df``. Numbers go above those of unfinished
    versions too: what a crashed write has left is never written over or read, and does not stand in
    the way.
    """
    spark = df.sparkSession
    data = f"{root}/data-{uuid.uuid4().hex}"
    if base is not None and base != current_version(spark, root):
        raise Conflict(f"version {base} is not the current one")
    df.write.parquet(data)
    while True:
        done, every = _numbers(spark, root)
        current, number = max(done, default=0), max(every, default=0) + 1
        if base is not None and base != current:
            break
        batches = _commit(spark, root, current).get("batches", {}) | (dict([batch]) if batch else {})
        if _appears(spark, f"{root}/v{number:08d}.json", json.dumps({"data": os.path.basename(data), "batches": batches})):
            return number
    _path(spark, data)[0].delete(_path(spark, data)[1], True)
    raise Conflict(f"version {base} is not the current one")


def update_index(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None, tries: int = 20) -> int:
    """Makes the next version from the current one by ``change``, again from the new one as long as other writers come first; so no writer's change is lost.

    A batch of a stream that is in the index already changes nothing.
    """
    for _ in range(tries):
        base = current_version(spark, root)
        if batch is not None and batch[1] <= _commit(spark, root, base).get("batches", {}).get(batch[0], -1):
            return base
        try:
            return write_index(change(read_index(spark, root, base)), root, base, batch)
        except Conflict:
            continue
    raise Conflict(f"{tries} tries, and other writers came first each time")


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _numbers(spark: SparkSession, root: str) -> tuple[list[int], list[int]]:
    """Numbers of finished versions, and of all that something is left of. Without a commit file a version is a folder that is finished by Spark's marker."""
    fs, path = _path(spark, root)
    if not fs.exists(path):
        return [], []
    names = {s.getPath().getName() for s in fs.listStatus(path)}
    every = {int(n[1:9]): n for n in sorted(names) if n[:1] == "v" and n[1:9].isdigit() and n[9:] in ("", ".json")}
    done = [k for k, n in every.items() if n.endswith(".json") or fs.exists(_path(spark, f"{root}/{n}/_SUCCESS")[1])]
    return sorted(done), sorted(every)


def _commit(spark: SparkSession, root: str, version: int) -> dict:
    """What a version's commit file tells, its data with their place."""
    if not version:
        return {}
    name = f"{root}/v{version:08d}"
    fs, path = _path(spark, name + ".json")
    if not fs.exists(path):
        return {"data": name}
    held = fs.open(path)
    try:
        told = json.loads(bytes(held.readAllBytes()))
    finally:
        held.close()
    return told | {"data": f"{root}/{told['data']}"}


def _appears(spark: SparkSession, name: str, said: str) -> bool:
    """Whether a file with that content now stands under the name, where none stood: whole, and for one writer only.

    On a local file system by a hard link, else by a rename, which a store like HDFS refuses if the name is taken.
    """
    fs, path = _path(spark, name)
    beside = f"{os.path.dirname(name)}/.{uuid.uuid4().hex}"
    if fs.getScheme() == "file":
        plain = lambda n: _path(spark, n)[1].toUri().getPath()
        os.makedirs(os.path.dirname(plain(name)), exist_ok=True)
        with open(plain(beside), "w", encoding="utf-8") as f:
            f.write(said)
        try:
            os.link(plain(beside), plain(name))
        except FileExistsError:
            return False
        finally:
            os.remove(plain(beside))
        return True
    out = fs.create(_path(spark, beside)[1], False)
    out.write(bytearray(said.encode()))
    out.close()
    if not fs.exists(path) and fs.rename(_path(spark, beside)[1], path):
        return True
    fs.delete(_path(spark, beside)[1], False)
    return False


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, gray, red, green, blue, body, n_chars, lang, source``: embeddings read as 8 x 8 gray planes, with edited copies.

    Every tenth row has a brighter copy (number + 1,000,000), every fifteenth one with a few cells
    changed (+ 2,000,000); copies differ in their bytes.
    """
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("vec_id"), "text", "n_chars", "lang", "source")
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    base = e.join(d, "vec_id").select("vec_id", F.transform("embedding", lambda v: unit(0.5 + v.cast("double"))).alias("gray"), F.col("text").alias("body"), "n_chars", "lang", "source")
    changed = {1: (10, F.transform("gray", lambda v: unit(v * 1.02))), 2: (15, F.transform("gray", lambda v, i: F.when(i % 23 == 7, unit(v + 0.05)).otherwise(v)))}
    every = base
    for n, (step, gray) in changed.items():
        copy = base.where(F.col("vec_id") % step == 0)
        every = every.unionByName(copy.select((F.col("vec_id") + n * 1_000_000).alias("vec_id"), gray.alias("gray"), F.concat("body", F.lit(f"#{n}")).alias("body"), (F.col("n_chars") + 2).alias("n_chars"), "lang", "source"))
    return every.select("vec_id", "gray", F.col("gray").alias("red"), F.reverse("gray").alias("green"), F.transform("gray", lambda v: 1 - v).alias("blue"), "body", "n_chars", "lang", "source")


def _facts() -> dict[str, Column]:
    v = F.col("vec_id")
    ext = F.when(v % 3 == 0, ".jpg").when(v % 3 == 1, ".png").otherwise(".JPG")
    camera = F.when(v % 5 == 0, "").when(v % 5 == 1, "Canon EOS R5").when(v % 5 == 2, "NIKON Z 6").when(v % 5 == 3, "Sony_A7").otherwise("Pixel 9")
    name = F.concat(F.lit("IMG_"), F.lpad(v.cast("string"), 7, "0"), ext)
    return {
        "id": v + 1,
        "path": F.concat(F.lit("/photos/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), name),
        "filename": name,
        "size": F.col("n_chars"),
        "mtime": (F.lit(1_600_000_000) + (v % 10_000) * 3600).cast("double") + 0.5,
        "sha256": F.sha2("body", 256),
        "width": (640 + v * 37 % 4000).cast("int"),
        "height": (480 + v * 53 % 3000).cast("int"),
        "format": F.when(v % 3 == 1, "PNG").otherwise("JPEG"),
        "taken_at": F.when(v % 7 != 0, text.from_epoch(F.lit(1_577_836_800) + (v % 10_000) * 18_000)),
        "camera": camera,
        "iso": F.when(v % 4 != 0, (F.lit(100) * F.pow(F.lit(2), v % 7)).cast("int")),
        "mark": F.when(v % 9 == 0, "delete").when(v % 9 == 1, "keep").otherwise("none"),
        "rating": (v % 6).cast("int"),
        "status": F.when(v % 23 == 22, "error").otherwise("ok"),
    }


def analysed(df: DataFrame, weights: Weights | None = None) -> DataFrame:
    """Adds hashes, measures, metrics, flags and score to rows with planes, ``width``, ``height`` and ``iso``. No shuffle.

    Hashes and measures are stored before they are scored, so that no plan repeats them; the planes
    are left behind.
    """
    gray, rgb = F.col("gray"), (F.col("red"), F.col("green"), F.col("blue"))
    raw = quality.raw_metrics(gray, *rgb, text.megapixels(F.col("width"), F.col("height")))
    rows = df.withColumns({"phash": hashing.phash(gray), "dhash": hashing.dhash(gray), "ahash": hashing.ahash(gray), "color_sig": hashing.color_signature(*rgb), "raw": F.struct(*[c.alias(k) for k, c in raw.items()])})
    rows = cut(rows.drop("gray", "red", "green", "blue"))
    rows = rows.withColumn("metrics", F.struct(*[c.alias(k) for k, c in quality.metrics(F.col("raw")).items()]))
    return rows.withColumns({"flags": quality.flags(F.col("raw"), F.col("metrics"), F.col("iso")), "score": quality.score(F.col("metrics"), F.col("iso"), weights)})


def photo_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived collection without hashes and measures."""
    rows = planes(spark, sf_dir)
    return rows.select(*[c.alias(k) for k, c in _facts().items()], "gray", "red", "green", "blue")


_STORED: dict[tuple, DataFrame] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """What tells the tables' files: names, lengths and times of change."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in ("embeddings", "documents"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            out += sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path))
    return tuple(out)


def photo_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived collection, analysed once for each session and state of the tables' files, and stored, as an index is.

    Queries read stored hashes, measures and scores; no plan holds the analysis itself.
    """
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir))
    if key not in _STORED:
        _STORED[key] = cut(analysed_index(spark, sf_dir))
    return _STORED[key]


def analysed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis itself. Rows of status ``error`` have no hashes and score 0.

    The tables are few files, while the analysis costs far more than moving a plane: rows are dealt
    to all cores first.
    """
    rows = analysed(photo_facts(spark, sf_dir).repartition(2 * spark.sparkContext.defaultParallelism, "id"))
    ok = F.col("status") == "ok"
    return rows.select(
        "id", "path", "filename", "size", "mtime", "sha256", "width", "height", "format", "taken_at", "camera", "iso", "mark", "rating", "status",
        *[F.when(ok, F.col(h)).otherwise("").alias(h) for h in ("phash", "dhash", "ahash")],
        F.when(ok, F.col("color_sig")).alias("color_sig"),
        F.when(ok, F.col("score")).otherwise(0.0).alias("score"),
        F.when(ok, F.col("metrics")).alias("metrics"),
        F.when(ok, F.col("flags")).otherwise(F.array().cast("array<string>")).alias("flags"),
        F.col("raw"),
    )


def rounded_raw(name: str) -> Column:
    return rounded(F.col(f"raw.{name}")).alias(name)

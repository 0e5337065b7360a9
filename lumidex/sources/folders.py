"""Folders listed and files opened by tasks: nothing is read but what is asked for.

A listing goes in rounds. A task walks down from its folders, breadth first, and leaves out folders
that are pruned before it enters them; past ``ENTRIES`` entries it hands back what it has not
entered, which the next round deals to all cores. So one huge folder tree spreads out, and a small one takes one round.

Paths are local ones or URIs of stores that pyarrow knows (``s3://``, ``hdfs://``, ``gs://``). A
physical file is told by its device and number, on stores by its path.
"""

from __future__ import annotations

import contextlib
import hashlib
import mmap
import os
import re
import stat
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.session import cut
from lumidex.settings import Settings
from lumidex.sources import exif

# Folders that hold no photos of their own.
SKIPPED_FOLDERS = (".git", ".svn", ".hg", "__pycache__", "node_modules", ".thumbnails", ".cache", ".Trash", ".Trash-1000", "$RECYCLE.BIN", "System Volume Information", ".dtrash")
#: Entries that a task looks at in one round of a listing, about.
ENTRIES = 20_000
#: Bytes that are read at once for a digest.
CHUNK = 1 << 20
_LISTED = "path string, size long, mtime double, file string"


class Entry(NamedTuple):
    path: str
    name: str
    folder: bool
    linked: bool
    size: int
    mtime: float
    file: str


def is_store(path: str) -> bool:
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]+://", path) is not None and not path.startswith("file:")


def plain_path(path: str) -> str:
    """A local path as it stands in the index: absolute, without ``file:`` and ``~``."""
    if is_store(path):
        return path.rstrip("/")
    return os.path.abspath(os.path.expanduser(re.sub("^file:/*", "/", path)))


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str, str]:
    """The file system, the path in it, and what stands before that in the URI."""
    system, inside = pyarrow.fs.FileSystem.from_uri(path)
    return system, inside, path[: len(path) - len(inside)] if path.endswith(inside) else ""


def _described(path: str, name: str, linked: bool, found: os.stat_result) -> Entry:
    return Entry(path, name, stat.S_ISDIR(found.st_mode), linked, found.st_size, found.st_mtime, f"{found.st_dev} {found.st_ino}")


def _from_store(info: pyarrow.fs.FileInfo, before: str) -> Entry:
    changed = info.mtime.timestamp() if info.mtime is not None else 0.0
    return Entry(before + info.path, info.base_name, info.type == pyarrow.fs.FileType.Directory, False, info.size or 0, changed, f"path {info.path}")


def entry(path: str) -> Entry | None:
    """What stands at a path, a link followed; None if nothing can be seen there."""
    try:
        if not is_store(path):
            return _described(path, os.path.basename(path), os.path.islink(path), os.stat(path))
        system, inside, before = _store(path)
        info = system.get_file_info(inside)
        return None if info.type == pyarrow.fs.FileType.NotFound else _from_store(info, before)
    except (OSError, ValueError, pa.ArrowException):
        return None


def entries(folder: str) -> Iterator[Entry]:
    """What a folder holds, links followed. What cannot be seen is passed over."""
    try:
        if is_store(folder):
            system, inside, before = _store(folder)
            for info in system.get_file_info(pyarrow.fs.FileSelector(inside)):
                yield _from_store(info, before)
            return
        with os.scandir(folder) as held:
            for x in held:
                with contextlib.suppress(OSError):
                    yield _described(x.path, x.name, x.is_symlink(), x.stat())
    except (OSError, pa.ArrowException):
        return


def suffix(name: str) -> str:
    """The suffix with its dot, in lower case; a name that only begins with a dot has none."""
    return os.path.splitext(name)[1].lower()


def walk(start: list[str], settings: Settings, most: int = ENTRIES) -> Iterator[tuple[Entry, bool]]:
    """Picture files below the folders, and, past ``most`` entries, the folders not entered yet; the flag tells these apart."""
    waiting, seen, looked = deque(start), set(), 0
    while waiting:
        folder = waiting.popleft()
        if looked >= most:
            yield Entry(folder, "", True, False, 0, 0.0, ""), True
            continue
        for e in entries(folder):
            looked += 1
            hidden = e.name.startswith(".") and not settings.include_hidden
            if hidden:
                continue
            if e.folder:
                if e.name in SKIPPED_FOLDERS or e.linked and not settings.follow_symlinks or e.file in seen:
                    continue
                seen.add(e.file)
                waiting.append(e.path)
            elif _wanted(e, settings):
                yield e, False


def _wanted(e: Entry, settings: Settings) -> bool:
    return suffix(e.name) in settings.extensions and e.size >= settings.min_file_bytes


def list_files(spark: SparkSession, roots: list[str], settings: Settings | None = None) -> DataFrame:
    """``path, size, mtime`` of picture files under the roots; a file may be a root itself, and roots that do not exist are passed over.

    Folders that hold no photos, and hidden ones unless ``include_hidden`` is set, are not entered;
    the roots themselves may have any name. A physical file is given once, by its first path, even if
    roots overlap or several names are linked to it. Links to files stand for what they point to; unless
    ``follow_symlinks`` is set, folders that are links are not entered, and with it none twice.
    """
    s = settings or Settings()
    found = [e for e in map(entry, dict.fromkeys(map(plain_path, roots))) if e is not None]
    alone = [(e.path, e.size, e.mtime, e.file) for e in found if not e.folder and _wanted(e, s)]
    every = spark.createDataFrame(alone, _LISTED)
    todo = spark.createDataFrame([(e.path,) for e in found if e.folder], "folder string")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start = [f for pdf in batches for f in pdf["folder"]]
        held = []
        for e, later in walk(start, s):
            held.append((None, None, None, None, e.path) if later else (e.path, e.size, e.mtime, e.file, None))
            if len(held) == 10_000:
                yield _rows(held)
                held = []
        yield _rows(held)

    done, parts = None, spark.sparkContext.defaultParallelism
    while not todo.isEmpty():
        seen = cut(todo.repartition(parts).mapInPandas(look, f"{_LISTED}, folder string"))
        every = every.unionByName(seen.where("folder IS NULL").drop("folder"))
        later = seen.where("folder IS NOT NULL").select("folder").distinct()
        if s.follow_symlinks:  # a link may lead back to what is listed already
            real = cut(later.mapInPandas(_real, "folder string, real string").groupBy("real").agg(F.min("folder").alias("folder")))
            later = real if done is None else real.join(done, "real", "left_anti")
            done = real.select("real") if done is None else cut(done.unionByName(real.select("real")).distinct())
            later = later.select("folder")
        todo = later
    return every.groupBy("file").agg(F.min(F.struct("path", "size", "mtime")).alias("first")).select("first.*")


def _rows(held: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(held, columns=["path", "size", "mtime", "file", "folder"])
    return out.astype({"size": "Int64", "mtime": "float64"})


def _real(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(real=[f if is_store(f) else os.path.realpath(f) for f in pdf["folder"]])


def absent(paths: DataFrame) -> DataFrame:
    """Those of ``path`` where nothing stands any more, looked up by tasks."""

    def gone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[entry(p) is None for p in pdf["path"]]]

    return paths.select("path").mapInPandas(gone, "path string")


@contextlib.contextmanager
def _opened(path: str) -> Iterator:
    """A file's bytes, mapped into memory where it is a local one."""
    if is_store(path):
        system, inside, _ = _store(path)
        with system.open_input_file(inside) as f:
            yield f.read()
    elif os.path.getsize(path):
        with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as held:
            yield held
    else:
        yield b""


def _digest(data) -> str:
    digest, view = hashlib.sha256(), memoryview(data)
    try:
        for at in range(0, len(view), CHUNK):
            digest.update(view[at : at + CHUNK])
    finally:
        view.release()
    return digest.hexdigest()


def read_facts(paths: DataFrame, facts: bool = True) -> DataFrame:
    """``path, sha256, capture, unread`` of each path: the digest, capture facts if asked for, and why a file could not be read (else empty).

    Each task opens the files of its own rows and no other, one at a time. Repeated paths give one row each; a null path cannot be read.
    """
    schema = pa.schema([("path", pa.string()), ("sha256", pa.string()), ("capture", exif.ARROW), ("unread", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                row = {"path": path, "sha256": None, "capture": None, "unread": ""}
                try:
                    with _opened(path) as data:
                        row |= {"sha256": _digest(data), "capture": exif.capture_facts(data) if facts else None}
                except (OSError, TypeError, ValueError, pa.ArrowException) as e:
                    row["unread"] = str(e) or type(e).__name__
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)

    spread = paths.select("path").repartition(2 * paths.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(read, f"path string, sha256 string, capture {exif.FACTS}, unread string")

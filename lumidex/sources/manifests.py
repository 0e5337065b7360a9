"""Manifests as a data sink: one CSV or JSON file, written in parts by tasks and joined in order of rank when all are done.

A part has a name of its own for each attempt of a task, and the commit is told those of attempts that counted, so a
task that runs twice adds nothing twice. What is joined are bytes, file to file; the whole gets the target's name at last, so a reader never sees
half a manifest. The target's folder is one that tasks and driver share, as the files are that it tells of.
"""

from __future__ import annotations

import csv
import io
import json
import os
import shutil
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: What stands before the rows, between two of them and after them; a JSON document's head wants the count.
_BETWEEN = {"csv": "", "json": ", "}
_TAIL = {"csv": "", "json": "]}"}


@dataclass
class Part(WriterCommitMessage):
    path: str
    first: int | None
    rows: int


def csv_line(cells: Iterable) -> str:
    held = io.StringIO(newline="")
    csv.writer(held).writerow(cells)
    return held.getvalue()


class ManifestSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lumidex_manifest"

    def writer(self, schema: StructType, overwrite: bool) -> ManifestWriter:
        return ManifestWriter(self.options["target"], self.options["kind"], self.options.get("head", "{}"), schema.fieldNames())


class ManifestWriter(DataSourceWriter):
    def __init__(self, target: str, kind: str, head: str, columns: list[str]):
        self.target, self.kind, self.head, self.columns = target, kind, json.loads(head), columns
        self.folder = f"{target}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Part:
        os.makedirs(self.folder, exist_ok=True)
        part = Part(os.path.join(self.folder, uuid.uuid4().hex), None, 0)
        with open(part.path, "w", encoding="utf-8", newline="") as f:
            for row in iterator:
                part.first = row["rank"] if part.first is None else part.first
                line = csv_line(row) if self.kind == "csv" else json.dumps(dict(zip(self.columns, row)), default=str)
                f.write(_BETWEEN[self.kind] * (part.rows > 0) + line)
                part.rows += 1
        return part

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.first)
        whole = f"{self.target}.{uuid.uuid4().hex}"
        with open(whole, "w", encoding="utf-8", newline="") as out:
            out.write(csv_line(self.columns) if self.kind == "csv" else json.dumps(self.head | {"count": sum(p.rows for p in parts)})[:-1] + ', "photos": [')
            for n, part in enumerate(parts):
                out.write(_BETWEEN[self.kind] * (n > 0))
                with open(part.path, encoding="utf-8", newline="") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
            out.write(_TAIL[self.kind])
        os.replace(whole, self.target)
        shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def _write(rows: DataFrame, target: str, kind: str, head: dict) -> None:
    target = os.path.abspath(target)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    rows.sparkSession.dataSource.register(ManifestSink)
    ranked = rows.repartitionByRange("rank").sortWithinPartitions("rank")
    ranked.write.format("lumidex_manifest").option("target", target).option("kind", kind).option("head", json.dumps(head)).mode("append").save()


def write_manifest_csv(rows: DataFrame, target: str) -> None:
    """One CSV file with a header, in order of ``rank``."""
    _write(rows, target, "csv", {})


def write_manifest_json(rows: DataFrame, target: str, naming: str, mode: str, generated_at: str) -> None:
    """One document with the exported photos, in order of ``rank``."""
    _write(rows, target, "json", {"generated_by": "lumidex", "generated_at": generated_at, "count": 0, "naming": naming, "mode": mode})

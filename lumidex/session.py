"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lumidex")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where that is unset, a single machine (tests) gets a temporary folder; a cluster is an error, as
    its executors would each write to a folder of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return tempfile.mkdtemp(prefix="lumidex-")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def counted(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict[str, int]]:
    """``df`` as by ``cut``, with aggregates of its rows that are observed as they pass: no job of their own. An empty table gives 0 for each."""
    seen = Observation()
    rows = cut(df.observe(seen, *[c.alias(k) for k, c in measures.items()]))
    found = seen.get
    return rows, {k: found.get(k) or 0 for k in measures}

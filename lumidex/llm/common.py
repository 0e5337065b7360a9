"""What the text operators share: table access, row identity and Arrow batch bounds."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Stands for a null identifier wherever rows are ordered or joined by it; it sorts before every other one.
NO_ID = -(2**63)
_MARK = "\x01"
#: Rows and bytes in one Arrow batch that goes to Python: whole texts are large, so batches are short; a single longer text is a batch.
BATCH_ROWS = 500
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _whole(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, IntegralType)


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but for those names, which are compared as Spark does: without regard to case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, lengthened until no column of ``df`` has them in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_key(df: DataFrame, column: str) -> Column:
    """The identifier as a key without nulls, a null one first: whole numbers as longs, anything else as a string behind a mark.

    The least long of all (-2^63) is read as null.
    """
    if _whole(df, column):
        return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))
    return F.coalesce(F.concat(F.lit(_MARK), F.col(column).cast("string")), F.lit(""))


def id_back(df: DataFrame, column: str, key: str) -> Column:
    """The identifier that ``key`` stands for: a long or a string."""
    if _whole(df, column):
        return F.nullif(F.col(key), F.lit(NO_ID))
    return F.when(F.col(key) != "", F.substring(F.col(key), F.lit(2), F.length(key)))


def groups_of(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Frames of whole groups, with the places where groups start and the end: for batches of a partition that is sorted by ``keys``."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        key = pdf[keys].to_numpy()
        turns = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        if held and not (held[-1][keys].iloc[-1].to_numpy() == key[0]).all():
            turns = np.concatenate([[0], turns])
        if not len(turns):
            held.append(pdf)
            continue
        whole = pd.concat([*held, pdf.iloc[: turns[-1]]], ignore_index=True) if held else pdf.iloc[: turns[-1]].reset_index(drop=True)
        if len(whole):
            before = len(whole) - int(turns[-1])
            yield whole, [*dict.fromkeys([0, *(int(t) + before for t in turns)])]
        held = [pdf.iloc[turns[-1] :]]
    if held:
        whole = pd.concat(held, ignore_index=True)
        yield whole, [0, len(whole)]


def let(value: Column, use) -> Column:
    """Evaluates ``value`` once and hands it on as a variable. The result is copied, so it should be short."""
    return F.transform(F.array(value), use)[0]


def states_before(values: Column, zero: Column, step, kind: str) -> Column:
    """For each value of an array the state that ``step(state, value)`` has reached before it; ``kind`` is the state's type.

    An aggregation copies what it holds at every step, so states are gathered in runs, and these in
    runs of runs, of the cube root of the length each: no step copies many times more than it adds.
    """
    none, nones = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def gathered(v: Column, at: Column, until: Column, state: Column, widths: list[Column]) -> Column:
        """``state, out``: the state after ``v[at]`` to ``v[until - 1]``, and those before each of them."""
        if not widths:
            one = lambda a, i: F.struct(step(a["state"], v[i]).alias("state"), F.concat(a["out"], F.array(a["state"])).alias("out"))
            return F.aggregate(F.sequence(at, until - 1), F.struct(state.alias("state"), none.alias("out")), one)

        def run(acc: Column, first: Column) -> Column:
            last = gathered(v, first, F.least(first + widths[0], until), acc["last"]["state"], widths[1:])
            return F.struct(last.alias("last"), F.concat(acc["outs"], F.array(acc["last"]["out"])).alias("outs"))

        begun = F.struct(F.struct(state.alias("state"), none.alias("out")).alias("last"), nones.alias("outs"))
        done = lambda acc: F.struct(acc["last"]["state"].alias("state"), F.flatten(F.concat(acc["outs"], F.array(acc["last"]["out"]))).alias("out"))
        return F.aggregate(F.sequence(at, until - 1, widths[0]), begun, run, done)

    def whole(v: Column) -> Column:
        root = F.ceil(F.cbrt(F.size(v))).cast("int")
        return F.when(F.size(v) == 0, none).otherwise(gathered(v, F.lit(0), F.size(v), zero.cast(kind), [root * root, root])["out"])

    return let(values, whole)


def short_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch, so that a batch of long texts fits a Python worker. Lower bounds of the session stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Returns memory that a Python worker has freed to the machine, before the worker waits for its next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)

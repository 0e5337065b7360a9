"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of times that each of its documents should appear for the
source to make up its target share of the mixture's bytes. A document's count is the inverse of
the Poisson distribution with that mean, taken at a number in [0, 1) from a hash of seed, id, text,
source and, of rows that are equal in these, the row's number: the same in every run and on every
machine, and independent of other rows, whether or not ids are null or repeat. Rates over ``STEP``
are sums of several independent draws. Counted documents are exploded and placed by a hash of the
same and of the copy, which shuffles the mixture globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumidex.llm.common import without
from lumidex.session import cut

SEED = 17
#: Target weight of a source: its bytes to this power. 1 keeps the natural mixture, 0 makes all equal.
POWER = 0.5
#: Largest mean of one draw, and the counts that its table covers; beyond them lies less than 2^-52.
STEP = 16.0
TABLE = 96
#: Sources up to which the table of rates (under 1 KB a row) is broadcast; more are joined by a shuffle, with the same result.
BROADCAST_SOURCES = 20_000
#: Equal rows that one task numbers, about.
ROWS_IN_RUN = 50_000


def source_rates(df: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, source: str = "source", text: str = "text", power: float = POWER) -> DataFrame:
    """``source, rate``: weights given by source (a source without one gets none), or bytes to ``power``.

    A null source counts as the empty name, a null text as one byte as do empty ones; the mixture
    has ``epochs`` times the bytes of the input.
    """
    size = F.greatest(F.octet_length(F.coalesce(F.col(text), F.lit(""))), F.lit(1)).cast("long")
    return _rates(df.groupBy(F.coalesce(F.col(source), F.lit("")).alias("source")).agg(F.sum(size).alias("bytes")), weights, epochs, power)


def _rates(sizes: DataFrame, weights: dict[str, float] | None, epochs: float, power: float) -> DataFrame:
    sizes = cut(sizes)
    if weights is None:
        weight = F.pow(F.col("bytes").cast("double"), F.lit(power))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(given, F.col("source")), F.lit(0.0)).cast("double")
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("bytes"), F.sum("weight")).first()
    if not total[0] or not total[1]:
        return sizes.select("source", F.lit(0.0).alias("rate"))
    return sizes.select("source", (F.col("weight") / F.lit(float(total[1])) * F.lit(float(total[0]) * epochs) / F.col("bytes")).alias("rate"))


def with_tables(rates: DataFrame) -> DataFrame:
    """Adds ``draws`` and ``below``, the distribution function of one draw at 0, 1, 2, ..."""
    draws = F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int")
    rows = rates.withColumn("draws", draws).withColumn("mean", F.col("rate") / F.col("draws"))
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.exp(-F.col("mean")).alias("sum"), F.array(F.exp(-F.col("mean"))).alias("out"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + p)).alias("out"))

    return rows.withColumn("below", F.aggregate(F.sequence(F.lit(1), F.lit(TABLE - 1)), start, step, lambda acc: acc["out"])).select("source", "draws", "below")


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _numbered(rows: DataFrame, repeated: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``_nth``, which numbers the rows of each key of ``repeated`` from 0 (null: a key that stands alone).

    A hot key's rows are numbered in runs, with offsets of one row for each run: any of them can have any number.
    """
    joined = rows.join(repeated, key, "left")
    salt = F.when(F.col("_runs").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("_runs")))
    alone, several = joined.where("_runs IS NULL").drop("_runs").withColumn("_nth", F.lit(None).cast("long")), cut(joined.where("_runs IS NOT NULL").withColumn("_run", salt))
    counts = several.groupBy(*key, "_run").count()
    before = Window.partitionBy(*key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*key, "_run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*key, "_run").orderBy(F.lit(0))
    # materialised: which of equal rows has which number is settled once, also for a task that runs again
    placed = cut(several.withColumn("_in", F.row_number().over(within) - 1).join(offsets, [*key, "_run"]))
    return alone.unionByName(placed.withColumn("_nth", F.col("_before") + F.col("_in")).drop("_run", "_runs", "_before", "_in"))


def mix_sources(df: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, id_col: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED, power: float = POWER) -> DataFrame:
    """The documents repeated by their counts and shuffled; adds ``copy`` (from 0) and ``place``, which sorts the mixture.

    Within each output partition rows are in order of ``place``. A null text draws like an empty
    one and a null source like the empty name; rows that are equal in id, text and source are drawn one by one, so
    a great many of them still make up their share. Existing columns of the two names are replaced.
    """
    spark = df.sparkSession
    whole, key = F.coalesce(F.col(text), F.lit("")), ["_key", "_source"]
    named = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(whole))
    # the input's columns stand in one struct, so that none meets a helper's name
    rows = df.select(F.struct(*without(df, "copy", "place")).alias("row"), F.coalesce(F.col(source), F.lit("")).alias("_source"), named.alias("_key"))
    size = F.greatest(F.octet_length(whole), F.lit(1)).cast("long")
    known = cut(df.select(F.xxhash64(named, F.coalesce(F.col(source), F.lit(""))).alias("h"), F.coalesce(F.col(source), F.lit("")).alias("_source"), size.alias("bytes")))
    rates = cut(with_tables(_rates(known.groupBy(F.col("_source").alias("source")).agg(F.sum("bytes").alias("bytes")), weights, epochs, power)).withColumnRenamed("source", "_source"))
    # digests that stand alone name no repeated row; only the others are looked at in full
    if known.groupBy("h").count().where("count > 1").isEmpty():
        rows = rows.withColumn("_nth", F.lit(None).cast("long"))
    else:
        counts = rows.groupBy(*key).count().where("count > 1")
        rows = _numbered(rows, cut(counts.select(*key, F.ceil(F.col("count") / ROWS_IN_RUN).alias("_runs"))), key)
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rows = rows.join(rates, "_source")
    name = F.concat_ws("|", "_key", "_source", F.nullif(F.col("_nth"), F.lit(0)).cast("string"))
    one = lambda j: F.size(F.filter("below", lambda c: c < _uniform(F.lit(str(seed)), F.col("_name"), j.cast("string"))))
    counted = rows.withColumn("_name", name).withColumn("_count", F.aggregate(F.sequence(F.lit(0), F.col("draws") - 1), F.lit(0), lambda n, j: n + one(j)))
    copies = counted.where("_count > 0").select("row", "_name", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)).alias("copy"))
    placed = copies.withColumn("place", F.md5(F.concat_ws("|", F.lit(f"{seed} place"), "_name", F.col("copy").cast("string")))).drop("_name")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, "place").sortWithinPartitions("place").select("row.*", "copy", "place")


def keep_mixed(df: DataFrame) -> DataFrame:
    """The mixture with the input's columns: documents of over-weighted sources repeat, of others some are left out."""
    return mix_sources(df.select(F.struct(*df.columns).alias("row"), "doc_id", "source", "text")).select("row.*")


def mixing_sql() -> str:
    """The registered query over the view ``documents``, as DuckDB SQL."""
    return f"""
WITH sizes AS (SELECT coalesce(source, '') AS source, sum(greatest(octet_length(encode(coalesce(text, ''))), 1))::DOUBLE AS bytes FROM documents GROUP BY 1),
rates AS (SELECT source, pow(bytes, {POWER}) / sum(pow(bytes, {POWER})) OVER () * sum(bytes) OVER () / bytes AS rate FROM sizes),
draws AS (SELECT source, greatest(ceil(rate / {STEP}), 1)::INTEGER AS draws, rate / greatest(ceil(rate / {STEP}), 1) AS mean FROM rates),
chances AS (SELECT source, draws, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below
            FROM draws, range(0, {TABLE}) r(k)),
named AS (SELECT doc_id, source, text, concat_ws('|', coalesce(doc_id::VARCHAR, 'null'), md5(coalesce(text, '')), coalesce(source, '')) AS name FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY name) - 1 AS nth FROM named),
rows AS (SELECT row_number() OVER () AS r, doc_id, source, text, CASE WHEN nth = 0 THEN name ELSE name || '|' || nth END AS name FROM numbered),
units AS (SELECT r, d.source, ('0x' || substr(md5(concat_ws('|', '{SEED}', name, j::VARCHAR)), 1, 13))::BIGINT / {float(2**52)} AS u
          FROM (SELECT d.r, d.name, coalesce(d.source, '') AS source, unnest(range(0, s.draws)) AS j FROM rows d JOIN draws s ON s.source = coalesce(d.source, '')) d),
counts AS (SELECT r, sum((SELECT count(*) FROM chances c WHERE c.source = x.source AND c.below < x.u)) AS n FROM units x GROUP BY r)
SELECT doc_id, source, copy::INTEGER AS copy, md5(concat_ws('|', '{SEED} place', name, copy::VARCHAR)) AS place, text
FROM (SELECT doc_id, source, text, name, unnest(range(0, n::BIGINT)) AS copy FROM rows JOIN counts USING (r))
"""


def mixing_report(df: DataFrame) -> DataFrame:
    """The result of the registered query: the mixture itself."""
    return mix_sources(df.select("doc_id", "source", "text")).select("doc_id", "source", "copy", "place", "text")

"""Repeated line runs, found through suffix ranks by prefix doubling and deleted but for their first copy.

A document is the sequence of its lines that hold a word. Each line has an id; the rank of a
position at depth 2^t orders the suffixes that start there by their first 2^t lines, and the rank
at depth 2^(t+1) is that of the pair (rank here, rank 2^t lines on): a distributed sort of the
distinct pairs. Positions whose prefix occurs once leave, as no longer prefix of theirs can repeat.
The suffixes that share their first L lines are an interval of the suffix array with
longest-common-prefix values of L or more; it is named by two overlapping ranks, (rank at the
start, rank 2^t before the end) with 2^t <= L. An interval of two or more suffixes is a repeated
run; the suffix that comes first by (document id, line) is its first copy.

Blank lines belong to the line before them. A run counts from ``min_words`` words. A copy that
overlaps the first one in the same document is no later copy: of a line said over and over, so many
stay as make up a run that counts. A line is deleted if a later copy of some run that counts covers
it; so the first occurrence of any line stays, and what is said twice is still said once. Every run is the
union of the shortest runs that count starting or ending at its lines, and those are repeated,
clear of their first copy, when it is, so only these shortest runs, two for each line at most, are
looked up: together they cover what the maximal runs cover. Their length bounds the rounds: it is
at most ``min_words`` lines.

All of this is DataFrame expressions; sizes follow the number of repeated lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumidex.llm.common import id_key, unused, without
from lumidex.session import cut

MIN_WORDS = 40
_DOC = ["k0", "k1"]
#: Stands for the end of a document, which no line reaches.
_LAST = 2**31 - 16


def _let(value: Column, use) -> Column:
    """Evaluates ``value`` once and hands it on as a variable."""
    return F.transform(F.array(value), use)[0]


def _ranked(classes: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``rank``, a number that orders the rows by ``by``: sorted ranges, numbered within and across.

    Rows are distinct in ``by``, so a range that is computed again gets the same numbers.
    """
    placed = classes.repartitionByRange(*by).sortWithinPartitions(*by)
    return placed.withColumn("rank", F.monotonically_increasing_id())


def _lines(df: DataFrame, text: str) -> DataFrame:
    """``k0, k1, i, pos, end, words, d0, d1`` of the lines that hold a word; ``i`` counts them. A row each, so no shuffle."""
    each = F.transform(F.split(text, "\n", -1), lambda x, n: F.struct(n.alias("pos"), x.alias("line"), F.regexp_count(x, F.lit(r"\S+")).alias("words")))

    def numbered(rows: Column) -> Column:
        end = lambda n: F.coalesce(F.try_element_at(rows, n + 2)["pos"] - 1, F.lit(_LAST))
        return F.transform(rows, lambda x, n: F.struct(x["pos"].alias("pos"), end(n).alias("end"), x["words"].alias("words"), F.xxhash64(x["line"]).alias("d0"), F.xxhash64(F.lit(1), x["line"]).alias("d1")))

    found = df.select(*_DOC, F.posexplode(_let(F.filter(each, lambda x: x["words"] > 0), numbered)).alias("i", "line"))
    return found.select(*_DOC, "i", "line.*")


def _live(df: DataFrame, text: str) -> DataFrame:
    """``k0, k1, i, pos, end, words, rank`` of lines that occur more than once."""
    each = cut(_lines(df, text))
    classes = _ranked(each.groupBy("d0", "d1").count().where("count > 1").select("d0", "d1"), ["d0", "d1"])
    return cut(each.join(classes, ["d0", "d1"]).select(*_DOC, "i", "pos", "end", "words", "rank"))


def _windows(live: DataFrame, min_words: int) -> DataFrame:
    """``k0, k1, i, length, from_pos, to_pos``: the shortest runs of repeated lines with the words, from and to each line."""
    order = Window.partitionBy(*_DOC).orderBy("i")
    summed = live.withColumn("upto", F.sum("words").over(order))
    docs = summed.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("i", "pos", "end", "words", "upto"))).alias("rows"))
    most = live.agg(F.max("i")).first()[0] or 0
    bits = F.array(*[F.lit(1 << b) for b in range((most + 1).bit_length() - 1, -1, -1)])

    def first_place(rows: Column, goal: Column) -> Column:
        """How many rows have ``upto`` below the goal; the row after them reaches it."""
        step = lambda p, b: F.when((p + b <= F.size(rows)) & (F.try_element_at(rows, p + b)["upto"] < goal), p + b).otherwise(p)
        return F.aggregate(bits, F.lit(0), step)

    def run(a: Column, b: Column) -> Column:
        return F.struct(a["i"].alias("i"), (b["i"] - a["i"] + 1).alias("length"), a["pos"].alias("from_pos"), b["end"].alias("to_pos"))

    def forward(rows: Column) -> Column:
        def one(r: Column, n: Column) -> Column:
            return _let(first_place(rows, r["upto"] - r["words"] + min_words) + 1, lambda e: _let(F.try_element_at(rows, e), lambda z: F.when(z["i"] - r["i"] == e - 1 - n, run(r, z))))

        return F.transform(rows, one)

    def backward(rows: Column) -> Column:
        # the last start with words enough up to here: the last row that begins at or before ``most``
        def one(r: Column, n: Column) -> Column:
            most = r["upto"] - min_words
            start = F.when(most >= 0, first_place(rows, most + 1) + 1)
            return _let(start, lambda s: _let(F.try_element_at(rows, s), lambda a: F.when(r["i"] - a["i"] == n + 1 - s, run(a, r))))

        return F.transform(rows, one)

    found = docs.select(*_DOC, F.explode(F.array_distinct(F.array_compact(F.concat(forward(F.col("rows")), backward(F.col("rows")))))).alias("run"))
    return found.select(*_DOC, "run.i", "run.length", "run.from_pos", "run.to_pos")


def _named(runs: DataFrame, ranks: DataFrame, depth: int) -> DataFrame:
    """Runs of ``depth`` to ``2 depth - 1`` lines with the two ranks that name their interval; unique ones leave."""
    at = lambda name: ranks.select(*_DOC, F.col("i").alias("_i"), F.col("rank").alias(name))
    mine = runs.where((F.col("length") >= depth) & (F.col("length") < 2 * depth))
    mine = mine.withColumn("_i", F.col("i")).join(at("a"), [*_DOC, "_i"]).drop("_i")
    return mine.withColumn("_i", F.col("i") + F.col("length") - depth).join(at("b"), [*_DOC, "_i"]).drop("_i")


def _deeper(ranks: DataFrame, depth: int) -> DataFrame:
    """Ranks at twice the depth, of the positions whose prefix occurs more than once."""
    order = Window.partitionBy(*_DOC).orderBy("i")
    pairs = ranks.select(*_DOC, "i", F.col("rank").alias("a"), F.lead("rank", depth).over(order).alias("b"), F.lead("i", depth).over(order).alias("then"))
    pairs = pairs.where(F.col("then") == F.col("i") + depth).drop("then")
    classes = _ranked(pairs.groupBy("a", "b").count().where("count > 1").select("a", "b"), ["a", "b"])
    return cut(pairs.join(classes, ["a", "b"]).select(*_DOC, "i", "rank"))


def repeated_runs(df: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``k0, k1, spans``: for each document with later copies, the line spans to delete, merged and in order.

    ``df`` has the key columns ``k0, k1``; rows that repeat both are one document.
    """
    if not df.groupBy(*_DOC).count().where("count > 1").isEmpty():
        df = df.dropDuplicates(_DOC)
    live = _live(df, text)
    runs = cut(_windows(live, min_words))
    longest = runs.agg(F.max("length")).first()[0] or 0
    ranks, depth, named = live.select(*_DOC, "i", "rank"), 1, None
    while depth <= longest:
        part = _named(runs, ranks, depth)
        named = part if named is None else named.unionByName(part)
        if 2 * depth <= longest:
            ranks = _deeper(ranks, depth)
        depth *= 2
    if named is None:
        named = runs.select("*", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    named = cut(named)
    name = ["length", "a", "b"]
    first = named.groupBy(*name).agg(F.min(F.struct(*_DOC, "i")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = cut(first)  # the join below can then split a run with very many copies
    clear = (F.struct("first.k0", "first.k1") != F.struct(*_DOC)) | (F.col("i") >= F.col("first.i") + F.col("length"))
    later = named.join(first, name).where(clear).select(*_DOC, "from_pos", "to_pos")
    order = Window.partitionBy(*_DOC).orderBy("from_pos", "to_pos")
    before = F.max("to_pos").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("new", F.coalesce(F.col("from_pos") > before, F.lit(True)).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy(*_DOC, "island").agg(F.min("from_pos").alias("from_pos"), F.max("to_pos").alias("to_pos"))
    return spans.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("from_pos", "to_pos"))).alias("spans"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The input with later copies of repeated line runs deleted from ``text``, plus ``n_lines`` and ``n_removed``.

    Every row stays. A null text stays null, with 0 lines. Documents are ordered by id, a null id
    first, and by text hash within an id; rows that repeat both are one document and get the same
    text. Blank lines go or stay with the line before them. Columns named ``n_lines`` or
    ``n_removed`` are replaced; others are passed on.
    """
    rest = without(df, "n_lines", "n_removed")
    k0, k1, cuts = unused(df, "k0", "k1", "spans")
    keyed = df.select(*rest, id_key(df, id_col).alias(k0), F.xxhash64(text).alias(k1))
    spans = repeated_runs(df.select(id_key(df, id_col).alias("k0"), F.xxhash64(text).alias("k1"), F.col(text).alias("text")), "text", min_words)
    spans = spans.select(F.col("k0").alias(k0), F.col("k1").alias(k1), F.col("spans").alias(cuts))
    lines = F.split(text, "\n", -1)
    counted = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines")
    # the spans of a partition are built into a hash table, so that texts stream past unsorted
    joined = keyed.join(spans.hint("shuffle_hash"), [k0, k1], "left").select(*rest, cuts, counted)

    def kept(each: Column) -> Column:
        start = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.try_element_at(cuts, j)["to_pos"] + 1)
        stop = lambda j: F.coalesce(F.try_element_at(cuts, j + 1)["from_pos"], F.size(each))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda j: F.slice(each, start(j) + 1, F.greatest(stop(j) - start(j), F.lit(0)))))

    removed = F.aggregate(cuts, F.lit(0).cast("long"), lambda n, s: n + F.least(s["to_pos"] + 1, F.col("n_lines")) - s["from_pos"])
    changed = F.col(cuts).isNotNull()
    joined = joined.withColumn("n_removed", F.when(changed, removed).otherwise(F.lit(0).cast("long")))
    joined = joined.withColumn(text, F.when(changed, F.array_join(_let(lines, kept), "\n")).otherwise(F.col(text)))
    return joined.select(*rest, "n_lines", "n_removed")


def keep_deduplicated(df: DataFrame) -> DataFrame:
    """The input without later copies of line runs; documents of which no word is left go. Columns unchanged."""
    row = df.select(F.struct(*without(df, "text")).alias("row"), "doc_id", "text")
    kept = dedup_lines(row).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return kept.select(*[F.col("text") if c.lower() == "text" else F.col("row")[c].alias(c) for c in df.columns])


def line_report(df: DataFrame) -> DataFrame:
    """The result of the registered query."""
    return dedup_lines(df.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"), "text")


def line_sql(min_words: int = MIN_WORDS) -> str:
    """The registered query over the view ``documents`` (unique ids), as DuckDB SQL of another kind: every line is matched with every earlier equal one, and matches that go on line by line are runs."""
    return f"""
WITH split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
worded AS (SELECT *, len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+')) AS words FROM split),
numbered AS (SELECT *, row_number() OVER d AS i, coalesce(lead(pos) OVER d - 1, 1000000000) AS until, sum(words) OVER d AS upto FROM worded WHERE words > 0
    WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
matches AS (SELECT a.doc_id, a.i, b.doc_id AS source, a.i - b.i AS lag FROM numbered a JOIN numbered b ON a.line = b.line AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.i < a.i)),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, source, lag ORDER BY i) AS island FROM matches),
maximal AS (SELECT doc_id, min(i) AS s, max(i) AS e, CASE WHEN doc_id = source THEN lag ELSE 1000000000 END AS most FROM islands GROUP BY doc_id, source, lag, island),
runs AS (SELECT DISTINCT doc_id, s, s + least(most, total) - 1 AS e FROM (SELECT doc_id, most, e - s + 1 AS total, unnest(range(s, greatest(e - most + 1, s) + 1)) AS s FROM maximal)),
later AS (SELECT r.doc_id, a.pos AS from_pos, b.until AS to_pos FROM runs r JOIN numbered a ON a.doc_id = r.doc_id AND a.i = r.s JOIN numbered b ON b.doc_id = r.doc_id AND b.i = r.e
    WHERE b.upto - a.upto + a.words >= {min_words}),
fates AS (SELECT w.doc_id, w.line, w.pos, EXISTS (SELECT 1 FROM later x WHERE x.doc_id = w.doc_id AND w.pos BETWEEN x.from_pos AND x.to_pos) AS gone FROM split w),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM fates GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(k.text) AS kept_sha256, k.text
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

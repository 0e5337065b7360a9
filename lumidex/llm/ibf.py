"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: its lines, cut again at the first sentence end ``PARAGRAPH`` to ``LONGEST``
characters on, where there is none at the end of the first word from ``SHORT`` characters on, and after
``LONGEST`` characters at last, so that no paragraph is longer. Each distinct paragraph's digest is put in three cells of a sketch, one
in each third of it; a cell holds the number of its digests, their XOR and the XOR of their
checksums. The difference of two sketches, cell by cell, holds only the digests that the texts do
not share. Peeling takes out cells with one digest and removes it from its other cells, round by
round, until nothing is left; if something stays, both texts are sketched again, with ``EACH`` cells
for each digest that the failed sketch tells to differ, and then twice as large each time.
The digests recovered give the likeness: shared paragraphs among all paragraphs of the two.

Sketches are kept sparse, as cells in order of place, and every step is an expression on one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumidex.llm.common import id_back, id_key, let, unused
from lumidex.session import cut

#: Characters of a paragraph before a sentence end cuts it, at most, and before a word's end does if no sentence ends; cells of a fingerprint; rounds of peeling; retries; cells of the first retry for each digest expected (peeling wants 1.23).
PARAGRAPH = 96
LONGEST = 160
SHORT = 24
CELLS = 24
ROUNDS = 30
RETRIES = 12
EACH = 24
#: Places of a retry at most: for each paragraph that a text can have (its characters fit 31 bits) there are more than it needs.
MOST_CELLS = 3 << 29
_SENTENCE = rf"[^\n]{{{PARAGRAPH},{LONGEST}}}?(?:[.!?]+(?=\s|$)|[。！？…।؟۔]+)"
_WORDS = rf"[^\n]{{{SHORT},{PARAGRAPH}}}?[^\n\s.!?](?=\s)"
_PIECES = rf"{_SENTENCE}|{_WORDS}|[^\n]{{1,{LONGEST}}}"
_CELL = "array<struct<c:int,n:bigint,k:bigint,h:bigint>>"
_LOW32 = 0xFFFFFFFF


def paragraph_digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs; none for null and empty texts."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PIECES), F.lit(0)), lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(3)).bitwiseAND(F.lit(_LOW32))


def _full(cell: Column) -> Column:
    return (cell["n"] != 0) | (cell["k"] != 0) | (cell["h"] != 0)


def _added(entries: Column, sign, digest, check, needs: Column | None = None) -> Column:
    """Cells that are not empty, from entries written as longs: the place above 32 bits, below them a number.

    ``sign(number)`` (None: all are 1), ``digest(number)`` and ``check(number)`` look up what an entry adds to its cell. Longs sort and add up far faster than cells.
    Only places whose least number is below ``needs`` count, if it is given. Linear but for the sort.
    """
    place, number = (lambda x: F.shiftright(x, 32)), (lambda x: x.bitwiseAND(F.lit(_LOW32)).cast("int"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def cells(e: Column) -> Column:
        made = lambda i, n, k, h: F.struct(place(e[i]).cast("int").alias("c"), n.alias("n"), k.alias("k"), h.alias("h"))
        alone = lambda i: let(number(e[i]), lambda x: made(i, one if sign is None else sign(x), digest(x), check(x)))
        xored = lambda xs, of: F.aggregate(xs, zero, lambda t, x: t.bitwiseXOR(of(number(x))))

        def several(i: Column, xs: Column) -> Column:
            n = F.size(xs).cast("long") if sign is None else F.aggregate(xs, zero, lambda t, x: t + sign(number(x)))
            return let(made(i, n, xored(xs, digest), xored(xs, check)), lambda c: F.when(_full(c), c))

        def cell(first: Column, until: Column) -> Column:
            made_ = F.when(until - first == 1, alone(first)).otherwise(let(F.slice(e, first + 1, until - first), lambda xs: several(first, xs)))
            return made_ if needs is None else F.when(number(e[first]) < needs, made_)

        firsts = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: F.when(i == 0, True).otherwise(place(e[i]) != place(e[i - 1])))
        # the end stands behind the last place, so that each place finds the next one
        ends = F.concat(firsts, F.array(F.size(e)))
        return let(ends, lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), lambda first, j: cell(first, p[j + 1])))

    return F.filter(let(F.sort_array(entries), lambda e: F.when(F.size(e) == 0, F.array().cast(_CELL)).otherwise(cells(e))), lambda x: x.isNotNull())


def _numbered(digests: Column, third: Column, after: Column) -> Column:
    """The entries of digests in their three cells of a sketch of three times ``third``, one in each third, numbered on from ``after``."""
    place = lambda d, j: F.pmod(F.xxhash64(d, F.lit(j)), third) + (F.lit(j) * third if j else F.lit(0))
    entries = lambda d, n: F.array(*[F.shiftleft(place(d, j), 32).bitwiseOR(n) for j in range(3)])
    return F.flatten(F.transform(digests, lambda d, i: entries(d, (after + i).cast("long"))))


def _subtracted(a: Column, b: Column) -> Column:
    """The difference of two sketches given as cells."""
    both = F.concat(a, F.transform(b, lambda x: F.struct(x["c"].alias("c"), (-x["n"]).alias("n"), x["k"].alias("k"), x["h"].alias("h"))))
    return let(both, lambda x: _added(F.transform(x, lambda y, i: F.shiftleft(y["c"].cast("long"), 32).bitwiseOR(i.cast("long"))), *[lambda i, f=f: x[i][f] for f in "nkh"]))


def _checked(digests: Column, use) -> Column:
    """Hands on the digests and their checksums, each computed once."""
    return let(F.struct(digests.alias("d"), F.transform(digests, _check).alias("h")), lambda x: use(x["d"], x["h"]))


def sketch(digests: Column) -> Column:
    """The fingerprint's sketch of distinct digests, of ``CELLS`` cells."""
    return _checked(digests, lambda d, h: _added(_numbered(d, F.lit(CELLS // 3).cast("long"), F.lit(0)), None, lambda i: d[i], lambda i: h[i]))


def _difference(a: Column, b: Column, third: Column) -> Column:
    """The sketch of ``a`` less that of ``b``: sketches are sums, so the entries of ``b`` go in with their sign turned."""
    size = F.size(a)
    return _checked(F.concat(a, b), lambda d, h: _added(_numbered(d, third, F.lit(0)), lambda i: F.when(i < size, 1).otherwise(-1).cast("long"), lambda i: d[i], lambda i: h[i]))


def _peeled(difference: Column, third: Column) -> Column:
    """``done, found``: whether peeling empties the sketch, and how many digests it takes out.

    A cell with one digest is empty without it, so only the other cells are added up again; and not even those
    if all cells add up to what was taken out, each digest thrice: then nothing else is left in them. A sketch without such a cell is
    given up at once, so that no later round carries it along.
    """
    none = F.array().cast(_CELL)
    start = F.struct(difference.alias("cells"), F.lit(0).alias("found"), F.lit(False).alias("stuck"))
    pure = lambda x: (F.abs(x["n"]) == 1) & (x["h"] == _check(x["k"]))
    xored = lambda values, of: F.aggregate(values, F.lit(0).cast("long"), lambda t, x: t.bitwiseXOR(of(x)))

    def step(acc: Column, _: Column) -> Column:
        def parted(single: Column) -> Column:
            keys = lambda n: F.array_distinct(F.transform(F.filter(single, lambda x: x["n"] == n), lambda x: x["k"]))
            some = F.size(single)
            rest = F.when((some == 0) | (some == F.size(acc["cells"])), none).otherwise(F.filter(acc["cells"], lambda x: ~pure(x)))
            return F.struct(rest.alias("rest"), keys(1).alias("more"), keys(-1).alias("less"))

        found = let(F.filter(acc["cells"], pure), parted)

        def taken(f: Column) -> Column:
            n_rest, n_more = F.size(f["rest"]), F.size(f["more"])
            size = n_more + F.size(f["less"])

            def left(keys: Column) -> Column:
                held = F.transform(f["rest"], lambda x, i: F.shiftleft(x["c"].cast("long"), 32).bitwiseOR(i.cast("long")))
                of = lambda kept, gone: lambda i: F.when(i < n_rest, kept(i)).otherwise(gone(i - n_rest))
                sign = of(lambda i: f["rest"][i]["n"], lambda i: F.when(i < n_more, -1).otherwise(1).cast("long"))
                return _added(F.concat(held, _numbered(keys, third, n_rest)), sign, of(lambda i: f["rest"][i]["k"], lambda i: keys[i]), of(lambda i: f["rest"][i]["h"], lambda i: _check(keys[i])), n_rest)

            def remaining(keys: Column) -> Column:
                counted = F.aggregate(acc["cells"], F.lit(0).cast("long"), lambda t, x: t + x["n"]) == 3 * (n_more - F.size(f["less"]))
                all_out = counted & (xored(acc["cells"], lambda x: x["k"]) == xored(keys, lambda k: k)) & (xored(acc["cells"], lambda x: x["h"]) == xored(keys, _check))
                return F.when(all_out, none).otherwise(left(keys))

            cells_ = F.when((n_rest == 0) | (size == 0), none).otherwise(let(F.concat(f["more"], f["less"]), remaining))
            return F.struct(cells_.alias("cells"), (acc["found"] + size).alias("found"), (size == 0).alias("stuck"))

        return F.when(F.size(acc["cells"]) > 0, let(found, taken)).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.struct(((F.size(acc["cells"]) == 0) & ~acc["stuck"]).alias("done"), acc["found"].alias("found")))


def with_likeness(df: DataFrame, out: str, a: str, b: str, sketch_a: str, sketch_b: str, attempts: str | None = None) -> DataFrame:
    """Adds the likeness of two columns of digests with their sketches: shared paragraphs among all, 0 to 1; 1 if there are none.

    The given sketches are subtracted and peeled. Where they are too small, their difference still
    tells how much differs: the squares of its counts add up to three for each digest, and a part
    that the sizes explain. Both sides are sketched again with ``EACH`` cells for each digest
    expected, and with twice as many each time that peeling leaves something. ``attempts`` names a column that tells how many
    sketches it took: 1 for the given ones, and ``RETRIES + 2`` where the sets themselves settled it.
    """
    first, expected, tried, differ = unused(df, "first", "expected", "tried", "differ")
    size_a, size_b = F.size(a), F.size(b)

    def attempt(d: Column) -> Column:
        squares = F.aggregate(d, F.lit(0.0), lambda s, x: s + x["n"] * x["n"])
        return let(_peeled(d, F.lit(CELLS // 3).cast("long")), lambda r: F.struct(r["done"].alias("done"), r["found"].alias("found"), squares.alias("squares")))

    apart = (size_a - size_b).cast("double")
    guess = (F.col(f"{first}.squares") - 9 * apart * apart / CELLS) / 3
    guess = F.least(F.greatest(guess, F.abs(apart), F.lit(8.0)), (size_a + size_b).cast("double"))

    def again(acc: Column, i: Column) -> Column:
        third = F.least(F.ceil(EACH * F.col(expected) / 3) * F.pow(F.lit(2), i - 1), F.lit(float(MOST_CELLS // 3))).cast("long")
        peeled = let(third, lambda n: let(_difference(F.col(a), F.col(b), n), lambda d: _peeled(d, n)))
        return F.when(acc["done"], acc).otherwise(let(peeled, lambda r: F.struct(r["done"].alias("done"), r["found"].alias("found"), (i + 1).alias("sketches"))))

    rows = df.withColumn(first, let(_subtracted(F.col(sketch_a), F.col(sketch_b)), attempt)).withColumn(expected, guess)
    begun = F.struct(F.col(f"{first}.done").alias("done"), F.col(f"{first}.found").alias("found"), F.lit(1).alias("sketches"))
    larger = F.aggregate(F.sequence(F.lit(1), F.lit(RETRIES)), begun, again)
    rows = rows.withColumn(tried, F.when(F.col(f"{first}.done"), begun).otherwise(larger))
    # no sketch of the ladder is ever too small in practice; the sets themselves settle it if one is
    exact = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    rows = rows.withColumn(differ, F.when(F.col(f"{tried}.done"), F.col(f"{tried}.found")).otherwise(exact))
    both = size_a + size_b
    shared = F.when(both == 0, F.lit(1.0)).otherwise((both - F.col(differ)) / (both + F.col(differ)))
    rows = rows.withColumn(out, shared)
    if attempts:
        rows = rows.withColumn(attempts, F.when(F.col(f"{tried}.done"), F.col(f"{tried}.sketches")).otherwise(RETRIES + 2))
    return rows.drop(first, expected, tried, differ)


def written(digests: Column, cells: Column) -> Column:
    """A fingerprint as text: the number of paragraphs, then each cell that is not empty in 34 hexadecimal digits.

    They are the cell's place (2), its count (8), the checksums (8) and the digests (16).
    """
    part = lambda x, digits: F.lpad(F.hex(x), digits, "0")
    digits = F.transform(cells, lambda x: F.concat(part(x["c"], 2), part(x["n"], 8), part(x["h"], 8), part(x["k"], 16)))
    return F.lower(F.concat(F.size(digests).cast("string"), F.lit(":"), F.array_join(digits, "")))


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of the whole text (null: as empty) as a string; equal texts have equal ones."""
    made = let(paragraph_digests(F.col(text)), lambda d: written(d, sketch(d)))
    return df.withColumn(out, made)


def _successions(docs: DataFrame) -> DataFrame:
    """``k0, k1, n, m, prev``: distinct documents, their rows, and the one before in order of key (before the first: the last).

    Sorted by range; the neighbour across a boundary comes from one row for each range.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = docs.groupBy("k0", "k1").agg(F.max(F.length("text")).cast("long").alias("n"), F.count("*").cast("int").alias("m"))
    each = cut(each.repartitionByRange(parts, "k0", "k1").withColumn("run", F.spark_partition_id()))
    row = F.struct("k0", "k1", "n", "m")
    within = Window.partitionBy("run").orderBy("k0", "k1")
    ends = each.groupBy("run").agg(F.max(row).alias("last"))
    across = Window.orderBy("run")
    final = ends.agg(F.max("last")).first()[0]
    if final is None:
        return each.select("k0", "k1", "n", "m", row.alias("prev"))
    wrap = F.struct(*[F.lit(final[c]).cast(each.schema[c].dataType).alias(c) for c in ("k0", "k1", "n", "m")])
    ends = ends.select("run", F.coalesce(F.lag("last").over(across), wrap).alias("before"))
    linked = each.withColumn("own", F.lag(row).over(within)).join(ends, "run")
    return cut(linked.select("k0", "k1", "n", "m", F.coalesce("own", "before").alias("prev")))


def version_report(df: DataFrame) -> DataFrame:
    """The fixed result of the registered query: each document against its edited version and its successor.

    The order is by id, a null id first, then by text hash; rows that repeat both follow each other.
    """
    docs = df.select(id_key(df, "doc_id").alias("k0"), F.coalesce("text", F.lit("")).alias("text")).select("k0", F.xxhash64("text").alias("k1"), "text")
    after = _successions(docs)
    if (after.agg(F.max("m")).first()[0] or 1) > 1:
        docs = docs.dropDuplicates(["k0", "k1"])
    heads = docs.join(after.hint("shuffle_hash"), ["k0", "k1"])
    heads = heads.select(
        F.col("prev.k0").alias("k0"), F.col("prev.k1").alias("k1"), F.col("prev.m").alias("m"), F.substring("text", F.lit(1), F.floor(F.col("prev.n") / 4).cast("int")).alias("head"), paragraph_digests(F.col("text")).alias("next_digests")
    )
    rows = docs.join(heads.hint("shuffle_hash"), ["k0", "k1"]).withColumn("n", F.length("text"))
    quarter = F.floor(F.col("n") / 4).cast("int")
    rows = rows.withColumn("digests", paragraph_digests(F.col("text")))
    # of rows that repeat a document only the last is followed by another one
    last = F.struct(F.lit(1).alias("times"), F.col("head").alias("head"), F.col("next_digests").alias("next_digests"))
    repeat = F.struct((F.col("m") - 1).alias("times"), F.substring("text", F.lit(1), quarter).alias("head"), F.col("digests").alias("next_digests"))
    rows = rows.select("k0", "text", "n", "digests", F.explode(F.when(F.col("m") > 1, F.array(last, repeat)).otherwise(F.array(last))).alias("v"))
    rows = rows.select("k0", "n", "digests", F.concat(F.substring("text", F.lit(1), F.col("n") - quarter), "v.head").alias("edited"), "v.next_digests", "v.times")
    rows = rows.select("k0", "n", "digests", "next_digests", "times", F.sha2("edited", 256).alias("edited_sha256"), paragraph_digests(F.col("edited")).alias("edited_digests"))
    rows = rows.withColumns({"cells": sketch(F.col("digests")), "edited_cells": sketch(F.col("edited_digests")), "next_cells": sketch(F.col("next_digests"))})
    rows = with_likeness(rows, "near_edited", "digests", "edited_digests", "cells", "edited_cells", "sketches_edited")
    rows = with_likeness(rows, "near_next", "digests", "next_digests", "cells", "next_cells", "sketches_next")
    made = rows.select(
        id_back(df, "doc_id", "k0").alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        written(F.col("digests"), F.col("cells")).alias("fingerprint"),
        written(F.col("edited_digests"), F.col("edited_cells")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "sketches_edited",
        "sketches_next",
        "times",
    )
    return made.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("_copy", "times")

"""Perceptual hashes as Columns over 8 x 8 gray planes (64 doubles, row by row), and distances.

A hash is 16 hexadecimal digits, most significant bit first. ``lumidex.functions.kernels`` has the
same hashes for planes of any size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumidex.functions.numbers import let, mean, total

SIDE = 8
#: Columns of a row of nine that an eight-wide plane is widened to.
WIDENED = [j * 8 // 9 for j in range(9)]
#: Distance that stands for a missing or malformed hash.
FAR = 64


def transform_matrix() -> list[list[float]]:
    """The low 8 rows of the orthonormal 32-point cosine transform, folded for planes whose cells are repeated four times."""
    rows = []
    for k in range(SIDE):
        scale = math.sqrt(1 / 32) if k == 0 else math.sqrt(2 / 32)
        rows.append([scale * sum(math.cos(math.pi * (2 * x + 1) * k / 64) for x in range(4 * i, 4 * i + 4)) for i in range(SIDE)])
    return rows


def _constant(values: list[float]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def bits_to_hex(bits: Column) -> Column:
    """64 booleans, first the most significant, as 16 digits."""
    one = lambda i: F.when(F.get(bits, i), 1).otherwise(0)
    digit = lambda n: F.substring(F.lit("0123456789abcdef"), 1 + 8 * one(4 * n) + 4 * one(4 * n + 1) + 2 * one(4 * n + 2) + one(4 * n + 3), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), digit), "")


def ahash(gray: Column) -> Column:
    """Brighter than the mean."""
    return let(mean(gray), lambda m: bits_to_hex(F.transform(gray, lambda v: v > m)))


def dhash(gray: Column) -> Column:
    """Brighter than the left neighbour, on rows widened to nine."""
    left, right = F.array(*[F.lit(c) for c in WIDENED[:-1]]), F.array(*[F.lit(c) for c in WIDENED[1:]])
    at = lambda i, columns: F.get(gray, F.floor(i / SIDE).cast("int") * SIDE + F.get(columns, i % SIDE))
    return bits_to_hex(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: at(i, right) > at(i, left)))


def low_frequencies(gray: Column) -> Column:
    """The 64 lowest coefficients of the plane's cosine transform."""
    m = F.array(*[_constant(row) for row in transform_matrix()])
    cells = F.sequence(F.lit(0), F.lit(7))
    row, col = (lambda i: F.floor(i / SIDE).cast("int")), (lambda i: i % SIDE)
    half = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: total(F.transform(cells, lambda y: F.get(F.get(m, row(i)), y) * F.get(gray, y * SIDE + col(i)))))
    return let(half, lambda t: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: total(F.transform(cells, lambda x: F.get(t, row(i) * SIDE + x) * F.get(F.get(m, col(i)), x)))))


def phash(gray: Column) -> Column:
    """Above the median of the coefficients, the first taken as 0 for the median but not for its own bit."""

    def bits(c: Column) -> Column:
        rest = F.concat(F.array(F.lit(0.0)), F.slice(c, 2, 63))
        middle = let(F.sort_array(rest), lambda s: (F.get(s, F.lit(31)) + F.get(s, F.lit(32))) / 2)
        return let(middle, lambda m: bits_to_hex(F.transform(c, lambda v: v > m)))

    return let(low_frequencies(gray), bits)


def turned(gray: Column, quarters: int) -> Column:
    """The plane turned counter-clockwise by quarters."""
    places = list(range(64))
    for _ in range(quarters % 4):
        places = [places[x * SIDE + (SIDE - 1 - y)] for y in range(SIDE) for x in range(SIDE)]
    return F.array(*[F.get(gray, F.lit(p)) for p in places])


def rotations(gray: Column) -> Column:
    """The four pHashes at 0, 90, 180 and 270 degrees."""
    return F.array(*[phash(turned(gray, q)) for q in range(4)])


def color_signature(red: Column, green: Column, blue: Column) -> Column:
    """Mean colours of the 4 x 4 cells, as 48 integers 0 to 255, cell by cell."""

    def cell(i: Column) -> Column:
        y, x = F.floor(i / 12).cast("int"), F.floor(i / 3).cast("int") % 4
        start = 2 * y * SIDE + 2 * x
        box = lambda p: (F.get(p, start) + F.get(p, start + 1) + F.get(p, start + SIDE) + F.get(p, start + SIDE + 1)) / 4
        value = F.when(i % 3 == 0, box(red)).when(i % 3 == 1, box(green)).otherwise(box(blue))
        return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), value * 255))).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(47)), cell)


def halves(hash_: Column) -> Column:
    """The hash as two 32-bit halves in longs; null where it is missing or malformed."""
    number = lambda start: F.conv(F.substring(F.lpad(hash_, 16, "0"), start, 8), 16, 10).cast("long")
    return F.when(hash_.rlike("^[0-9a-fA-F]{1,16}$"), F.struct(number(1).alias("hi"), number(9).alias("lo")))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two ``halves``; 64 if one is missing."""
    apart = F.bit_count(a["hi"].bitwiseXOR(b["hi"])) + F.bit_count(a["lo"].bitwiseXOR(b["lo"]))
    return F.coalesce(apart, F.lit(FAR)).cast("int")


def color_distance(a: Column, b: Column) -> Column:
    """Mean difference of two signatures, 0 to 1; 1 if one is missing or their lengths differ."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a) / 255
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (F.size(a) == 0), 1.0).otherwise(apart)


def similarity_percent(distance: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * (1 - distance / 64)))

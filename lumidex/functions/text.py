"""Names, labels and dates as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lowest score of each grade.
GRADES = [(85, "A"), (72, "B"), (58, "C"), (42, "D"), (25, "E")]


def folded(text: Column) -> Column:
    """Lower case for A to Z only."""
    return F.translate(text, _UPPER, _LOWER)


def like(text: Column, needle: str) -> Column:
    """Substring pattern in which ``%`` and ``_`` are wildcards and the backslash is not special; case of A to Z is ignored."""
    pattern = needle.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\")
    return folded(text).like(f"%{pattern}%")


def grade(score: Column) -> Column:
    out = F.when(score >= GRADES[0][0], GRADES[0][1])
    for least, letter in GRADES[1:]:
        out = out.when(score >= least, letter)
    return out.otherwise("F")


def band(score: Column) -> Column:
    return F.when(score >= 72, "good").when(score >= 50, "warn").otherwise("bad")


def megapixels(width: Column, height: Column) -> Column:
    return width.cast("long") * height.cast("long") / 1e6


def bytes_per_pixel(size: Column, width: Column, height: Column) -> Column:
    pixels = width.cast("long") * height.cast("long")
    return F.when(pixels > 0, size / pixels).otherwise(0.0)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    return folded(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def _decimals(top: Column, bottom: Column, digits: int) -> Column:
    """A quotient of whole numbers with that many decimals, half up without rounding errors."""
    ten = 10**digits
    n = F.floor((top.cast("long") * (2 * ten) + bottom) / (bottom * 2)).cast("long")
    return F.format_string(f"%d.%0{digits}d", F.floor(n / ten).cast("long"), n % ten) if digits else n.cast("string")


def human_size(size: Column) -> Column:
    """Bytes in the largest unit of at least 1; no decimals from 100 of it or for bytes, else one."""
    out = F.format_string("%d B", size.cast("long"))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        factor = F.lit(1024**i).cast("long")
        value = F.when(size >= 100 * factor, _decimals(size, factor, 0)).otherwise(_decimals(size, factor, 1))
        out = F.when(size >= factor, F.concat(value, F.lit(f" {unit}"))).otherwise(out)
    return out


def aspect(width: Column, height: Column) -> Column:
    """The reduced ratio, or a decimal one where it has large terms; ``-`` without a size. Euclid's steps are unrolled over a bounded sequence."""
    start = F.struct(width.cast("long").alias("a"), height.cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.when(s["b"] != 0, s["a"] % s["b"]).alias("b")))
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step, lambda s: s["a"])
    w, h = F.floor(width / gcd).cast("long"), F.floor(height / gcd).cast("long")
    ratio = F.when((w > 30) | (h > 30), F.concat(_decimals(width, height.cast("long"), 2), F.lit(":1"))).otherwise(F.concat_ws(":", w.cast("string"), h.cast("string")))
    return F.when((width > 0) & (height > 0), ratio).otherwise("-")


def camera_label(make: Column, model: Column) -> Column:
    """The model alone if it begins with the make."""
    make, model = F.trim(F.coalesce(make, F.lit(""))), F.trim(F.coalesce(model, F.lit("")))
    return F.when(F.startswith(folded(model), folded(make)), model).otherwise(F.trim(F.concat_ws(" ", make, model)))


def sanitised(name: Column) -> Column:
    """Safe on any file system: reserved characters become ``_``, outer spaces and then dots go, nothing left is ``photo``."""
    clean = F.regexp_replace(name, r'[/\\:*?"<>|]', "_")
    clean = F.regexp_replace(F.regexp_replace(clean, r"^\s+|\s+$", ""), r"^\.+|\.+$", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", "photo").otherwise(clean)


def from_epoch(seconds: Column) -> Column:
    """The time without a zone, whatever the session's is."""
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def taken_or_modified(taken_at: Column, mtime: Column) -> Column:
    return F.coalesce(taken_at, from_epoch(mtime))


def parsed_time(text: Column) -> Column:
    """The three forms that cameras write, and that of manifests; null for others."""
    forms = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd", "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in forms])


def summary(width: Column, height: Column, camera: Column, taken_at: Column) -> Column:
    # one decimal of the exact value, half even, as printf has it; Java's own formats round what they print half up
    size = F.when((width > 0) & (height > 0), F.concat(width.cast("string"), F.lit("x"), height.cast("string"), F.lit("  "), F.replace(F.format_number(megapixels(width, height), 1), F.lit(","), F.lit("")), F.lit(" MP")))
    return F.concat_ws("  ", size, F.when(camera != "", camera), F.date_format(taken_at, "yyyy-MM-dd"))


def thumbnail_key(path: Column, edge: int, mtime: Column) -> Column:
    return F.sha1(F.concat_ws("|", path, F.lit(str(edge)), mtime.cast("long").cast("string")))

"""Plans of imports and exports: which files go where, and why others do not. Files are touched elsewhere."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumidex.functions import text
from lumidex.functions.numbers import rounded
from lumidex.operators.components import connected_components
from lumidex.operators.ranking import numbered_within
from lumidex.operators.similarity import hamming_pairs, hashed, verified
from lumidex.session import cut
from lumidex.settings import METRICS, Settings

#: Links of a component that one task settles at most; it holds the ids of those turned away.
LARGE = 2_000_000

def outside_library(found: DataFrame, root: str) -> DataFrame:
    """Sources that are not inside the library already."""
    return found.where(~F.startswith(F.col("path"), F.lit(root.rstrip("/") + "/")))


def exact_import(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``outcome`` and ``match`` to a batch (``ord, path, sha256``): ``duplicate`` of the index or of an earlier row, else ``import``.

    An empty or null digest equals none. ``known`` has one row for each digest (``operators.index.digests``).
    """
    first = cut(batch.where("sha256 != ''").groupBy("sha256").agg(F.min(F.struct("ord", "path")).alias("first")))
    rows = batch.join(known.where("sha256 != ''").select("sha256", F.col("path").alias("_known")), "sha256", "left").join(first, "sha256", "left")
    earlier = F.when(F.col("first.ord") != F.col("ord"), F.col("first.path"))
    match = F.coalesce("_known", earlier)
    return rows.withColumn("match", match).withColumn("outcome", F.when(F.col("match").isNotNull(), "duplicate").otherwise("import")).drop("_known", "first")


def similar_import(batch: DataFrame, index: DataFrame, settings: Settings | None = None, large: int = LARGE) -> DataFrame:
    """Adds ``outcome`` and ``match``: ``similar`` if a row looks like an indexed photo or like an earlier row that is accepted itself, and the id of that one.

    ``batch`` has ``ord, id, phash, dhash, color_sig``; ids differ from those of the index. The match is the
    indexed photo of the highest score (then least id), or else the earliest accepted row. Only the
    batch probes the index. The rule is sequential, but only within components of rows that look alike: a task gets a
    component's links in the order of their later rows and settles them as they stream past, however long a chain
    is. Components of more than ``large`` links are settled in rounds instead, so that no task holds one.
    """
    s = settings or Settings()
    cols = ["id", "phash", "dhash", "color_sig"]
    ok = index.where("status = 'ok'")
    new, old = hashed(batch), hashed(ok)
    facts = ok.select(*cols).unionByName(batch.select(*cols))
    known = verified(hamming_pairs(new, old, s.phash_threshold, ordered=False), facts, s)
    score = ok.select(F.col("id").alias("b"), *([F.col("score").alias("_score")] if "score" in ok.columns else [F.lit(0.0).alias("_score")]))
    in_index = cut(known.join(score, "b").groupBy(F.col("a").alias("id")).agg(F.max_by("b", F.struct(F.col("_score"), -F.col("b"))).alias("_known")))
    pairs = verified(hamming_pairs(new, new, s.phash_threshold), batch.select(*cols), s)
    # rows like the index are out, and turn no other row away
    order = batch.select("id", F.struct("ord", "id").alias("o")).join(in_index, "id", "left_anti")
    a, b = order.select(F.col("id").alias("a"), F.col("o").alias("oa")), order.select(F.col("id").alias("b"), F.col("o").alias("ob"))
    inside = pairs.join(a, "a").join(b, "b").select(F.least("oa", "ob").alias("early"), F.greatest("oa", "ob").alias("late"))
    inside = cut(inside)
    turned_away = _settled(inside, large).select(F.col("late").alias("id"), F.col("early").alias("_early"))
    told = batch.join(in_index, "id", "left").join(turned_away, "id", "left").withColumn("match", F.coalesce("_known", "_early"))
    return told.withColumn("outcome", F.when(F.col("match").isNotNull(), "similar").otherwise("import")).drop("_known", "_early")


def _settled(links: DataFrame, large: int) -> DataFrame:
    """``early, late``: the rows (ids) that are turned away, with the earliest accepted row that each looks like. ``links`` holds structs ``ord, id``."""
    spark = links.sparkSession
    roots = cut(connected_components(links.select(F.col("early.id").alias("a"), F.col("late.id").alias("b"))))
    rooted = links.join(roots, links["late.id"] == roots["node"]).select("root", "early", "late")
    sizes = cut(rooted.groupBy("root").count())
    small = rooted.join(sizes.where(F.col("count") <= large).select("root"), "root", "left_semi")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = small.repartition(parts, "root").sortWithinPartitions("root", "late", "early").select("root", F.col("early.id").alias("early"), F.col("late.id").alias("late"))
    out = sorted_.mapInPandas(_first_come, "early long, late long")
    many = sizes.where(F.col("count") > large)
    return out if many.isEmpty() else out.unionByName(_in_rounds(cut(rooted.join(many.select("root"), "root", "left_semi").select("early", "late"))))


def _first_come(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of whole components, by their later rows: all links in which a row is the later one come before those in which it is the earlier."""
    root, away, last = None, set(), None
    for pdf in batches:
        found = []
        for r, early, late in zip(pdf["root"].tolist(), pdf["early"].tolist(), pdf["late"].tolist()):
            if r != root:
                root, away, last = r, set(), None
            if late != last and early not in away:
                away.add(late)
                last = late
                found.append((early, late))
        yield pd.DataFrame(found, columns=["early", "late"])


def _in_rounds(links: DataFrame) -> DataFrame:
    """The same for large components: a row is accepted when all its earlier look-alikes are turned away, and turned away when one of them is accepted."""
    rows = links.select(F.col("early.id").alias("id")).unionByName(links.select(F.col("late.id").alias("id"))).distinct()
    state = cut(rows.withColumn("fate", F.lit(None).cast("string")))
    while not state.where("fate IS NULL").isEmpty():
        met = links.join(state.select(F.col("id").alias("_early"), "fate"), F.col("early.id") == F.col("_early"))
        early = met.groupBy(F.col("late.id").alias("_late")).agg(F.bool_or(F.coalesce(F.col("fate") == "in", F.lit(False))).alias("taken"), F.bool_or(F.col("fate").isNull()).alias("open"))
        fate = F.coalesce("fate", F.when(F.col("taken"), "out"), F.when(F.col("open"), None).otherwise("in"))
        state = cut(state.join(early, state["id"] == early["_late"], "left").select("id", fate.alias("fate")))
    accepted = state.where("fate = 'in'").select("id")
    first = links.join(accepted, F.col("early.id") == F.col("id"), "left_semi").groupBy(F.col("late.id").alias("late")).agg(F.min("early").alias("first"))
    return first.select("first.id", "late").withColumnRenamed("id", "early")


def present_at_destination(plan: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``outcome`` and ``match``: ``duplicate`` of the file that stands where a row wants to go, if its bytes are equal, else ``import``.

    ``plan`` has ``target, sha256``; ``files`` has ``path, sha256`` of what is in the library, indexed
    or not. An empty or null digest equals none.
    """
    there = files.where("sha256 != ''").select(F.col("path").alias("target"), F.col("sha256").alias("_there"))
    same = F.coalesce(F.col("_there") == F.col("sha256"), F.lit(False))
    return plan.join(there, "target", "left").withColumns({"outcome": F.when(same, "duplicate").otherwise("import"), "match": F.when(same, F.col("target"))}).drop("_there")


def destination(root: str, organise: str, source_root: str | None = None) -> Column:
    """Where a photo lands: by month taken (or modified), mirrored from its source folder, or flat."""
    name = text.basename(F.col("path"))
    if organise == "date":
        when = text.taken_or_modified(F.col("taken_at"), F.col("mtime"))
        return F.concat_ws("/", F.lit(root), F.date_format(when, "yyyy"), F.date_format(when, "yyyy-MM"), name)
    if organise == "source" and source_root is not None:
        base = source_root.rstrip("/")
        inside = F.regexp_extract(F.substring(F.col("path"), F.lit(len(base) + 1), F.length("path")), "^/(.*)/[^/]*$", 1)
        top = F.lit(base.rsplit("/", 1)[-1])
        return F.when(F.startswith(F.col("path"), F.lit(base + "/")), F.concat_ws("/", F.lit(root), top, F.nullif(inside, F.lit("")), name)).otherwise(F.concat_ws("/", F.lit(root), top, name))
    return F.concat_ws("/", F.lit(root), name)


def free_names(plan: DataFrame, taken: DataFrame | None = None, order: str = "id", target: str = "target") -> DataFrame:
    """Gives every row its own ``target``: later rows of one name get ``-1``, ``-2`` before the suffix, passing over taken names.

    The k-th row of a name gets the k-th free number. With taken numbers ``t0 < t1 < ...``, ``tj - j`` numbers
    are free below ``tj``: sorted among the rows by that, the taken ones push each row to the number that is its place in the
    common order. So numbers are places in sorted ranges, and a name that very many rows wish for is spread
    out like any other. Only where two wishes can make the same name (``a-1.jpg`` is wished for
    itself and by the second ``a.jpg``) another round follows, for those rows alone.
    """
    stem, suffix = F.regexp_extract(F.col("_wish"), r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(F.col("_wish"), r"^(.*?)(\.[^./]*)?$", 2)
    wish = lambda c: F.regexp_replace(c, r"-[0-9]+(\.[^./]*)?$", "$1")
    number = lambda c: F.try_element_at(F.regexp_extract_all(c, F.lit(r"-([1-9][0-9]{0,8})(?:\.[^./]*)?$"), F.lit(1)), F.lit(1)).cast("long")
    name = F.when(F.col("_n") == 0, F.col("_wish")).otherwise(F.concat(stem, F.lit("-"), F.col("_n").cast("string"), suffix))
    open_ = plan.withColumnRenamed(target, "_wish")
    used = taken.select(F.col("path").alias("_used")).distinct() if taken is not None else plan.select(F.lit("").alias("_used")).limit(0)
    done = None
    while True:
        zero = used.select(F.col("_used").alias("_wish"), F.lit(0).cast("long").alias("_number"))
        later = used.select(wish("_used").alias("_wish"), number("_used").alias("_number")).where("_number IS NOT NULL")
        gone = zero.unionByName(later).join(open_.select("_wish").distinct(), "_wish", "left_semi").distinct()
        below = numbered_within(gone, "_wish", [F.asc("_number")], "_j").select("_wish", (F.col("_number") - F.col("_j")).alias("_k"), F.lit(0).alias("_row"))
        ranked = cut(numbered_within(open_, "_wish", [F.asc(order)], "_k"))
        places = below.unionByName(ranked.select("_wish", "_k", F.lit(1).alias("_row")))
        merged = numbered_within(places, "_wish", [F.asc("_k"), F.asc("_row")], "_n").where("_row = 1").drop("_row")
        tried = cut(ranked.join(cut(merged), ["_wish", "_k"]).withColumn(target, name))
        # a wish goes before a name that was made up; rows that meet in a name are as many as wishes that make it
        first = Window.partitionBy(target).orderBy("_n", order)
        tried = cut(tried.withColumn("_nth", F.row_number().over(first)))
        fine = tried.where("_nth = 1").drop("_k", "_nth", "_n")
        done = fine if done is None else done.unionByName(fine)
        rest = tried.where("_nth > 1")
        if rest.isEmpty():
            return done.drop("_wish")
        used = cut(used.unionByName(fine.select(F.col(target).alias("_used"))))
        open_ = rest.drop("_k", "_nth", "_n", target)


def export_name(naming: str) -> Column:
    """Names by rank, score or date before the original name; other namings keep it. Needs ``rank`` for the first."""
    original = text.sanitised(F.coalesce(F.nullif(F.col("filename"), F.lit("")), text.basename(F.col("path"))))
    if naming == "rank":
        return F.concat(F.format_string("%04d_", F.col("rank").cast("long")), original)
    if naming == "score":
        return F.concat(F.format_string("%03d_", F.bround(F.col("score"), 0).cast("long")), original)
    if naming == "date":
        return F.concat(F.date_format(text.taken_or_modified(F.col("taken_at"), F.col("mtime")), "yyyy-MM-dd_"), original)
    return original


def export_selection(ranked: DataFrame, long: DataFrame | None = None, best_only: bool = False, least: float | None = None, top: int | None = None) -> DataFrame:
    """Keepers, or those above a score, or all; then the first so many by score."""
    if best_only and long is not None:
        ranked = ranked.join(long.where("NOT is_best").select("id"), "id", "left_anti")
    elif least is not None:
        ranked = ranked.where(F.col("score") >= least)
    return ranked.orderBy(F.desc("score"), F.asc("id")).limit(max(0, top)) if top is not None else ranked


def manifest(photos: DataFrame, long: DataFrame | None = None, naming: str = "original", target: str | None = None) -> DataFrame:
    """One row for each exported photo (with ``rank``): 17 fixed columns, then the metrics; blanks where nothing is known.

    The name is that of the column ``target``, where a photo was placed, or else that of the naming.
    """
    if long is None:
        rows = photos.withColumns({"_group": F.lit(None).cast("int"), "_best": F.lit(None).cast("boolean")})
    else:
        rows = photos.join(long.select("id", F.col("group_index").alias("_group"), F.col("is_best").alias("_best")), "id", "left")
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    fixed = {
        "rank": F.col("rank"),
        "exported_as": export_name(naming) if target is None else text.basename(F.col(target)),
        "source": F.col("path"),
        "score": rounded(F.col("score"), 2),
        "grade": text.grade(F.col("score")),
        "rating": F.col("rating"),
        "width": F.col("width"),
        "height": F.col("height"),
        "megapixels": rounded(text.megapixels(F.col("width"), F.col("height")), 2),
        "bytes": F.col("size"),
        "format": F.col("format"),
        "camera": F.col("camera"),
        "iso": blank(F.col("iso")),
        "taken_at": F.coalesce(F.date_format("taken_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")),
        "flags": F.array_join("flags", " "),
        "duplicate_group": blank(F.col("_group")),
        "group_role": F.when(F.col("_best").isNull(), "").when(F.col("_best"), "keeper").otherwise("duplicate"),
    }
    measured = {f"metric_{m}": F.coalesce(rounded(F.col(f"metrics.{m}"), 4), F.lit(0.0)) for m in METRICS}
    return rows.select(*[c.alias(k) for k, c in {**fixed, **measured}.items()])


def export_plan(ranked: DataFrame, root: str, naming: str = "original", folders: DataFrame | None = None) -> DataFrame:
    """``id, path, target`` of each photo of a ranking, under names that differ; with ``folders`` (``id, group_index``) members of a group stand in the group's own folder."""
    base = F.lit(root.rstrip("/"))
    if folders is not None:
        ranked = ranked.join(folders.select("id", "group_index"), "id", "left")
        base = F.when(F.col("group_index").isNull(), base).otherwise(F.concat_ws("/", base, group_folder(F.col("group_index"))))
    wanted = ranked.select("id", "path", "rank", F.concat_ws("/", base, export_name(naming)).alias("target"))
    return free_names(wanted, order="rank").select("id", "path", "target")


def group_folder(index: Column) -> Column:
    return F.format_string("group-%03d", index.cast("long"))

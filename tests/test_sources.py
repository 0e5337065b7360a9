"""Listings and reads by tasks, index commits, cancellation, sinks, resampling."""

import csv
import json
import os
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_workflows import SMALL, png

from lumidex import workflows
from lumidex.cancellation import Cancellation
from lumidex.functions import kernels
from lumidex.operators import index, ranking, similarity, transfer
from lumidex.session import counted
from lumidex.settings import Settings
from lumidex.sources import files, folders, manifests, photo_index

# listings and reads


def names(spark, roots, settings=SMALL):
    return sorted(r.path.rsplit("/", 1)[1] for r in folders.list_files(spark, [str(r) for r in roots], settings).collect())


FOUND = ["_c.png", "a[1].PNG", "b{x}*.png", "d.png", "f.png", "g h+%41é.png"]


def test_listing_finds_any_name_and_prunes_below_roots_only(spark, tmp_path):
    shots = tmp_path / ".cache" / "shots"
    for name in ("_c.png", "a[1].PNG", "b{x}*.png", "node_modules/no.png", ".hidden/no.png", ".no.png", "deep/er/d.png", "_e/f.png", "g h+%41é.png"):
        png(shots / name, 1, 8, 8 + len(name))
    (shots / "text.txt").write_bytes(b"x" * 100)
    (shots / "tiny.png").write_bytes(b"x")
    assert names(spark, [shots]) == FOUND
    assert names(spark, [f"file:{shots}", shots / "deep", tmp_path / "absent"]) == FOUND
    assert names(spark, [shots], Settings(min_file_bytes=20, include_hidden=True)) == sorted([".no.png", "no.png", *FOUND])
    assert names(spark, [shots / ".no.png"]) == [".no.png"] and names(spark, []) == [] and names(spark, [tmp_path]) == []
    assert folders.walk([str(tmp_path / "absent")], SMALL) and list(folders.walk([str(tmp_path / "absent")], SMALL)) == []
    result = workflows.scan(spark, str(tmp_path / "i"), [str(shots)], SMALL)
    assert (result.scanned, result.indexed, result.failed) == (6, 6, 0)


def test_large_trees_are_handed_back_and_loops_end(spark, tmp_path, monkeypatch):
    for i in range(30):
        png(tmp_path / "t" / f"d{i % 6}" / f"e{i % 3}" / f"{i}.png", 1, 4, 4)
    os.symlink(tmp_path / "t", tmp_path / "t" / "d0" / "again")
    first = list(folders.walk([str(tmp_path / "t")], SMALL, 20))
    assert any(later for _, later in first) and not all(later for _, later in first)
    monkeypatch.setattr(folders.walk, "__defaults__", (5,))
    assert len(names(spark, [tmp_path / "t"])) == 30
    assert len(names(spark, [tmp_path / "t"], Settings(min_file_bytes=20, follow_symlinks=True))) == 30


def test_store_paths():
    import pyarrow.fs

    assert folders.is_store("s3://bucket/a.jpg") and not folders.is_store("file:///a") and not folders.is_store("/a:b//c")
    assert folders.plain_path("file:///a/b/") == "/a/b" and folders.plain_path("s3://b/x/") == "s3://b/x"
    info = pyarrow.fs.FileInfo("b/x/a.jpg", pyarrow.fs.FileType.File, size=5)
    assert folders._from_store(info, "s3://")[:5] == ("s3://b/x/a.jpg", "a.jpg", False, False, 5)


def test_only_wanted_files_are_opened(spark, tmp_path):
    for i in range(40):
        png(tmp_path / f"{i}.png", i + 1, 8, 8)
    os.mkfifo(tmp_path / "blocks.png")  # whoever opened it would wait for ever
    wanted = spark.createDataFrame([(str(tmp_path / "7.png"),)], "path string")
    assert [os.path.basename(p) for p in files._pictures(spark, wanted).inputFiles()] == ["7.png"]
    assert files.digests(spark, wanted).count() == 1
    rows = files.analyse_files(spark, wanted.selectExpr("path", "100L AS size", "1.0D AS mtime"), SMALL).collect()
    assert [(r.path, r.status, r.width) for r in rows] == [(str(tmp_path / "7.png"), "ok", 8)]
    facts = {os.path.basename(r.path or "-"): r.unread for r in folders.read_facts(spark.createDataFrame([(str(tmp_path / "gone.png"),), (None,), (str(tmp_path / "1.png"),)], "path string")).collect()}
    assert facts["1.png"] == "" and facts["gone.png"] and facts["-"]
    assert files.digests(spark, wanted.limit(0)).count() == 0


# the index


def test_rows_of_files_that_are_there_stay(spark, tmp_path):
    root = str(tmp_path / "i")
    png(tmp_path / "s" / "small.png", 1, 8, 8)
    png(tmp_path / "s" / "large.png", 2, 60, 60)
    workflows.scan(spark, root, [str(tmp_path / "s")], SMALL)
    photo_index.update_index(spark, root, lambda df: index.set_rating(df, 1, 4))
    again = workflows.scan(spark, root, [str(tmp_path / "s")], Settings(min_file_bytes=2000))
    assert (again.scanned, again.removed) == (1, 0) and photo_index.read_index(spark, root).count() == 2
    (tmp_path / "s" / "small.png").unlink()
    assert workflows.scan(spark, root, [str(tmp_path / "s")], SMALL).removed == 1
    before = photo_index.current_version(spark, root)
    assert workflows.scan(spark, root, [str(tmp_path / "s")], SMALL).summary().startswith("1 photos: 0 analysed, 1 unchanged in ")
    assert photo_index.current_version(spark, root) == before


def rows_of(spark, root):
    return {r.path: r.mark for r in photo_index.read_index(spark, root).collect()}


def facts(spark, *paths):
    return spark.createDataFrame([(p, 1) for p in paths], "path string, size long")


def test_of_two_writers_none_is_lost(spark, tmp_path):
    root = str(tmp_path / "i")
    first = photo_index.update_index(spark, root, lambda df: index.upsert(df, facts(spark, "/a", "/b")))
    old = photo_index.read_index(spark, root, first)
    photo_index.write_index(index.set_mark(old, old.where("path = '/a'"), "keep"), root, base=first)
    with pytest.raises(photo_index.Conflict):
        photo_index.write_index(index.set_mark(old, old.where("path = '/b'"), "delete"), root, base=first)
    assert rows_of(spark, root) == {"/a": "keep", "/b": "none"}

    calls = []

    def change(df):
        calls.append(1)
        if len(calls) == 1:  # another writer comes first
            photo_index.update_index(spark, root, lambda d: index.upsert(d, facts(spark, "/c")))
        return index.set_mark(df, df.where("path = '/b'"), "delete")

    photo_index.update_index(spark, root, change)
    assert len(calls) == 2 and rows_of(spark, root) == {"/a": "keep", "/b": "delete", "/c": "none"}
    failures = []

    def writer(n):
        try:
            photo_index.update_index(spark, root, lambda d: index.upsert(d, facts(spark, f"/t{n}")))
        except Exception as e:  # noqa: BLE001
            failures.append(e)

    threads = [threading.Thread(target=writer, args=(n,)) for n in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failures and {f"/t{n}" for n in range(4)} <= set(rows_of(spark, root))
    ids = [r.id for r in photo_index.read_index(spark, root).collect()]
    assert len(ids) == len(set(ids)) == 7
    assert not [n for n in os.listdir(root) if n.startswith(".") and not n.endswith(".crc")]


def test_a_batch_of_a_stream_is_in_the_index_once(spark, tmp_path):
    root = str(tmp_path / "i")
    calls = []
    change = lambda d: calls.append(1) or index.upsert(d, facts(spark, f"/{len(calls)}"))
    for number in (0, 0, 1, 0, 1):
        photo_index.update_index(spark, root, change, ("stream", number))
    photo_index.update_index(spark, root, change, ("other", 0))
    photo_index.write_index(photo_index.read_index(spark, root), root)
    photo_index.update_index(spark, root, change, ("stream", 1))
    assert len(calls) == 3 and set(rows_of(spark, root)) == {"/1", "/2", "/3"}


def test_versions_without_a_commit_file_are_read(spark, tmp_path):
    root = str(tmp_path / "i")
    index.upsert(photo_index.empty_index(spark), facts(spark, "/old")).write.parquet(f"{root}/v00000003")
    assert photo_index.current_version(spark, root) == 3 and set(rows_of(spark, root)) == {"/old"}
    photo_index.update_index(spark, root, lambda d: index.upsert(d, facts(spark, "/new")))
    assert photo_index.current_version(spark, root) == 4 and set(rows_of(spark, root)) == {"/old", "/new"}


# cancellation


def after(n):
    """A progress callback that stops at its n-th call."""
    calls = []
    return Cancellation(lambda done, total, message: calls.append(message) or len(calls) < n)


def test_stopped_scans_keep_what_is_done(spark, tmp_path):
    root, shots = str(tmp_path / "i"), tmp_path / "s"
    for i in range(5):
        png(shots / f"{i}.png", i + 1, 8, 8)
    nothing = workflows.scan(spark, root, [str(shots)], SMALL, cancellation=after(1))
    assert nothing.cancelled and nothing.scanned == 0 and "cancelled" in nothing.summary()
    some = workflows.scan(spark, root, [str(shots)], SMALL, cancellation=after(3), batch_files=2)
    assert some.cancelled and (some.scanned, some.indexed) == (5, 2) and photo_index.read_index(spark, root).count() == 2
    (shots / "0.png").unlink()
    last = workflows.scan(spark, root, [str(shots)], SMALL, cancellation=after(4), batch_files=2)
    assert last.cancelled and last.removed == 0 and last.skipped == 1 and photo_index.read_index(spark, root).count() == 5
    done = workflows.scan(spark, root, [str(shots)], SMALL)
    assert not done.cancelled and (done.indexed, done.skipped, done.removed) == (0, 4, 1)


def test_running_jobs_are_interrupted(spark):
    stop, reached = Cancellation(), []

    def work():
        with stop.over(spark):
            spark.range(8).repartition(8).mapInPandas(lambda batches: (time.sleep(60) or b for b in batches), "id long").count()
            reached.append(1)

    thread = threading.Thread(target=work)
    thread.start()
    time.sleep(4)
    began = time.time()
    stop.cancel()
    thread.join(40)
    assert not thread.is_alive() and not reached and time.time() - began < 40
    assert spark.range(3).count() == 3
    with pytest.raises(ValueError), Cancellation().over(spark):
        raise ValueError


def test_stopped_imports_exports_and_groups(spark, tmp_path):
    root, shots = str(tmp_path / "i"), tmp_path / "s"
    for i in range(4):
        png(shots / f"{i}.png", i + 1, 8, 8)
    (shots / "copy.png").write_bytes((shots / "1.png").read_bytes())
    settings = Settings(min_file_bytes=20, library_root=str(tmp_path / "lib"), import_organise="flat")
    none = workflows.import_photos(spark, root, [str(shots)], settings, cancellation=after(1))
    assert none.cancelled and none.imported == 0 and "Import cancelled" in none.summary()
    some = workflows.import_photos(spark, root, [str(shots)], settings, cancellation=after(3), batch_files=2)
    assert some.cancelled and some.imported == 2 and len(list((tmp_path / "lib").iterdir())) == 2
    workflows.scan(spark, root, [str(shots)], SMALL)
    photos = photo_index.read_index(spark, root)
    groups, long = workflows.long_groups(photos, SMALL, after(1))
    assert groups.count() == long.count() == 0 and workflows.long_groups(photos, SMALL)[0].count() == 1
    assert groups.dtypes == workflows.long_groups(photos, SMALL)[0].dtypes and long.dtypes == workflows.long_groups(photos, SMALL)[1].dtypes
    out = workflows.export_photos(spark, ranking.with_rank(photos), str(tmp_path / "out"), Settings(), cancellation=after(2), batch_files=3)
    assert out.cancelled and out.exported == 3 and "Export cancelled" in out.summary()
    assert len(list(csv.DictReader(open(out.manifest)))) == 3
    unplaced = spark.createDataFrame([(str(shots / "0.png"), str(tmp_path / "out2" / "x.png"))], "path string, target string")
    assert files.placed_so_far(unplaced).count() == 0


# counters and sinks


def test_counters_pass_with_the_rows(spark):
    rows, n = counted(spark.range(1000), rows=F.count("*"), even=F.count_if(F.col("id") % 2 == 0), total=F.sum("id"))
    assert n == {"rows": 1000, "even": 500, "total": 499500} and rows.count() == 1000
    for empty in (spark.range(0), spark.createDataFrame([], "id long")):
        assert counted(empty, rows=F.count("*"), total=F.sum("id"))[1] == {"rows": 0, "total": 0}


def test_manifests_are_joined_in_order_of_rank(spark, tmp_path):
    rows = spark.range(5000).selectExpr("5000 - id AS rank", "concat('a,\"', id, '\n') AS source", "if(id % 2 = 0, null, id / 4) AS score").repartition(7)
    manifests.write_manifest_csv(rows, str(tmp_path / "x" / "m.csv"))
    with open(tmp_path / "x" / "m.csv", newline="") as f:
        got = list(csv.reader(f))
    assert got[0] == ["rank", "source", "score"] and [int(r[0]) for r in got[1:]] == list(range(1, 5001)) and got[1][1:] == ['a,"4999\n', "1249.75"]
    manifests.write_manifest_json(rows, str(tmp_path / "x" / "m.json"), "rank", "copy", "now")
    told = json.loads((tmp_path / "x" / "m.json").read_text())
    assert told["count"] == 5000 and [p["rank"] for p in told["photos"]] == list(range(1, 5001)) and told["photos"][1]["score"] is None
    manifests.write_manifest_csv(rows.limit(0), str(tmp_path / "x" / "none.csv"))
    assert (tmp_path / "x" / "none.csv").read_text() == "rank,source,score\n".replace("\n", "\r\n") or (tmp_path / "x" / "none.csv").read_text().strip() == "rank,source,score"
    assert sorted(os.listdir(tmp_path / "x")) == ["m.csv", "m.json", "none.csv"]


# resampling


def test_filters():
    rng = np.random.default_rng(1)
    flat = np.full((9, 7), 0.25)
    for kernel in kernels.SUPPORT:
        for size in ((3, 3), (20, 5), (9, 7), (1, 1)):
            assert np.allclose(kernels.resample(flat, *size, kernel), 0.25)
        assert np.allclose(kernels.filter_matrix(13, 5, kernel).sum(axis=1), 1)
    assert np.allclose(kernels.filter_matrix(4, 2), [[3 / 7, 3 / 7, 1 / 7, 0], [0, 1 / 7, 3 / 7, 3 / 7]])
    assert np.allclose(kernels.filter_matrix(2, 4), [[1, 0], [0.75, 0.25], [0.25, 0.75], [0, 1]])
    ramp = np.tile(np.arange(16.0), (16, 1))
    assert np.allclose(kernels.resample(ramp, 8, 8, kernels.triangle)[:, 1:-1], np.tile(np.arange(8) * 2 + 0.5, (8, 1))[:, 1:-1])
    colour = rng.integers(0, 256, (40, 30, 3)).astype(np.uint8)
    small = kernels.scaled(colour, 16)
    assert small.shape == (16, 12, 3) and small.dtype == np.uint8 and kernels.scaled(colour, 80).shape == (80, 60, 3)
    assert kernels.within(colour, 40) is colour and kernels.within(colour, 20).shape == (20, 15, 3)


def test_resized_export(spark, tmp_path):
    png(tmp_path / "s" / "a.png", 3, 60, 40)
    png(tmp_path / "s" / "b.png", 4, 10, 8)
    (tmp_path / "s" / "c.jpg").write_bytes(b"no picture" * 9)
    rows = [(str(tmp_path / "s" / n), str(tmp_path / "o" / n)) for n in ("a.png", "b.png", "c.jpg", "gone.png")]
    plan = spark.createDataFrame(rows, "path string, target string")
    for _ in range(2):  # placing again changes nothing
        got = {os.path.basename(r.path): (r.bytes > 0, r.error) for r in files.place_files(plan, max_edge=30).collect()}
        assert got["a.png"] == got["b.png"] == (True, "") and "PNG" in got["c.jpg"][1] and got["gone.png"][1]
    sizes = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in files._pictures(spark, spark.createDataFrame([(t,) for _, t in rows[:2]], "path string")).collect()}
    assert sizes == {"a.png": (30, 20), "b.png": (10, 8)}
    moved = files.place_files(spark.createDataFrame([(rows[1][0], str(tmp_path / "o" / "moved.png"))], "path string, target string"), "move", 5).collect()
    assert moved[0].error == "" and not os.path.exists(rows[1][0])


# joins and plans at size


def codes(spark, values, first=1):
    return similarity.hashed(spark.createDataFrame([(first + i, f"{v:016x}") for i, v in enumerate(values)], "id long, phash string"))


@pytest.mark.parametrize("radius", [16, 18, 33, 64])
def test_metric_tree_join(spark, radius, monkeypatch):
    monkeypatch.setattr(similarity, "TILE_ROWS", 60)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 64, 12, np.uint64)
    values = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 14), replace=False)) for b in base for _ in range(20)] + [int(base[0])] * 5
    apart = lambda x, y: (x ^ y).bit_count()
    rows = codes(spark, values)
    got = sorted((r.a, r.b, r.distance) for r in similarity.hamming_pairs(rows, rows, radius, outright=0).collect())
    assert got == [(i + 1, j + 1, apart(x, y)) for i, x in enumerate(values) for j, y in enumerate(values) if i < j and apart(x, y) <= radius]
    other = codes(spark, values[:70], 50)
    for ordered in (True, False):
        got = sorted((r.a, r.b) for r in similarity.hamming_pairs(other, rows, radius, ordered=ordered, outright=0).collect())
        assert got == sorted((50 + i, j + 1) for i, x in enumerate(values[:70]) for j, y in enumerate(values) if apart(x, y) <= radius and (not ordered or 50 + i < j + 1))
    none = rows.limit(0)
    assert similarity.hamming_pairs(none, none, radius, outright=0).count() == 0


def test_tree_splits_and_finds_all():
    rng = np.random.default_rng(3)
    held, asked = rng.integers(0, 1 << 12, 500, np.uint64), rng.integers(0, 1 << 12, 300, np.uint64)
    tree = similarity.Tree(held, 8)
    assert len(tree.nodes) > 50
    got = sorted((int(i), int(j), int(d)) for a, b, c in tree.within(asked, 2) for i, j, d in zip(a, b, c))
    assert got == sorted((i, j, (int(x) ^ int(y)).bit_count()) for i, x in enumerate(held) for j, y in enumerate(asked) if (int(x) ^ int(y)).bit_count() <= 2)


def chained(spark, n):
    """``early, late`` links of a chain of rows that each look like the next."""
    link = lambda c: F.struct(F.col(c).alias("ord"), F.col(c).alias("id"))
    return spark.range(n - 1).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y")).select(link("x").alias("early"), link("y").alias("late"))


def test_a_long_chain_takes_few_jobs(spark):
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    away = {r.late: r.early for r in transfer._settled(chained(spark, 10_000), transfer.LARGE).collect()}
    assert away == {i: i - 1 for i in range(1, 10_000, 2)}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before < 60


def test_large_components_are_settled_alike(spark):
    rng = np.random.default_rng(9)
    pairs = {tuple(sorted(map(int, rng.choice(60, 2, replace=False)))) for _ in range(90)}
    df = spark.createDataFrame(sorted(pairs), "x long, y long")
    link = lambda c: F.struct((F.col(c) * 7 % 61).alias("ord"), F.col(c).alias("id"))
    both = df.select(link("x").alias("x"), link("y").alias("y")).select(F.least("x", "y").alias("early"), F.greatest("x", "y").alias("late"))
    want, away = {}, set()
    near = {}
    for x, y in pairs:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    order = sorted(near, key=lambda i: (i * 7 % 61, i))
    for i in order:
        first = [j for j in order[: order.index(i)] if j in near[i] and j not in away]
        if first:
            away.add(i)
            want[i] = first[0]
    for large in (10**6, 0):
        assert {r.late: r.early for r in transfer._settled(both, large).collect()} == want


def test_a_name_that_very_many_wish_for(spark):
    n = 30_000
    plan = spark.range(n).select("id", F.lit("/o/a.jpg").alias("target"))
    taken = spark.createDataFrame([("/o/a.jpg",), ("/o/a-2.jpg",), ("/o/a-3.jpg",), ("/o/a-900.jpg",), ("/o/a-999999.jpg",), ("/o/b.jpg",)], "path string")
    got = [r.target for r in transfer.free_names(plan, taken).orderBy("id").collect()]
    free = (i for i in range(1, 10**6) if i not in (2, 3, 900))
    assert got == [f"/o/a-{next(free)}.jpg" for _ in range(n)]

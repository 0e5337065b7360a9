import struct
import zlib

from lumidex.operators import index, ranking, transfer
from lumidex.settings import Settings, Weights
from lumidex.sources import files, photo_index
from lumidex.streaming.incremental import follow

SCHEMA = "id long, path string, size long, mtime double, score double, mark string, rating int, status string, width int, height int"


def small(spark):
    rows = [(1, "/p/a.jpg", 100, 10.0, 10.0, "keep", 3, "ok", 4, 2), (2, "/p/b.jpg", 200, 20.0, 30.0, "none", 0, "ok", 2, 2), (3, "/q/c.jpg", 5, 5.0, 0.0, "delete", 1, "error", 0, 0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_upsert_keeps_marks_and_numbers_new_paths(spark):
    facts = spark.createDataFrame([("/p/b.jpg", 250), ("/p/z.jpg", 1), ("/p/y.jpg", 2)], "path string, size long")
    got = {r.path: (r.id, r.size, r.mark, r.rating) for r in index.upsert(small(spark), facts).collect()}
    assert got["/p/b.jpg"] == (2, 250, "none", 0) and got["/p/a.jpg"] == (1, 100, "keep", 3)
    assert got["/p/y.jpg"] == (4, 2, "none", 0) and got["/p/z.jpg"] == (5, 1, "none", 0)


def test_ratings_marks_and_deletes(spark):
    df = small(spark)
    assert [index.set_rating(df, 1, n).where("id = 1").first().rating for n in (99, -3)] == [5, 0]
    assert index.toggle_mark(df, 1, "keep").where("id = 1").first().mark == "none"
    assert index.clear_marks(df).where("mark != 'none'").count() == 0
    gone = spark.createDataFrame([("/p/a.jpg",), ("/nowhere",)], "path string")
    assert index.count_paths(df, gone) == 1 and index.delete_paths(df, gone).count() == 2
    assert index.by_path(index.rename_path(df.withColumn("filename", df.path), "/p/a.jpg", "/x/n.jpg"), "/x/n.jpg").first().filename == "n.jpg"


def test_difference_and_prune(spark):
    found = spark.createDataFrame([("/p/a.jpg", 100, 10.0), ("/p/b.jpg", 201, 20.0), ("/q/c.jpg", 5, 5.0), ("/n.jpg", 1, 1.0)], "path string, size long, mtime double")
    got = {r.path: r.action for r in index.scan_difference(found, small(spark)).collect()}
    assert got == {"/p/a.jpg": "skip", "/p/b.jpg": "update", "/q/c.jpg": "update", "/n.jpg": "add"}
    assert {r.action for r in index.scan_difference(found, small(spark), force=True).collect()} == {"update", "add"}
    assert [r.path for r in index.missing_paths(small(spark), found.where("path != '/p/a.jpg' AND path != '/q/c.jpg'"), ["/p"]).collect()] == ["/p/a.jpg"]


def test_meta(spark):
    meta = spark.createDataFrame([("schema_version", "1")], "key string, value string")
    meta = index.with_meta(index.seeded_meta(meta, spark.createDataFrame([("schema_version", "9"), ("k", "v")], "key string, value string")), "k", "w")
    assert (index.meta_value(meta, "schema_version"), index.meta_value(meta, "k"), index.meta_value(meta, "no", "d")) == ("1", "w", "d")


def test_percentiles_and_ranks(spark):
    df = spark.createDataFrame([(i, s, f"{i}.jpg") for i, s in enumerate((10.0, 20.0, 20.0, 40.0))], "id long, score double, filename string")
    assert {r.id: r.percentile for r in ranking.percentiles(df).collect()} == {0: 0.0, 1: 25.0, 2: 25.0, 3: 75.0}
    assert [r.id for r in ranking.with_rank(df).orderBy("rank").collect()] == [3, 1, 2, 0]
    assert [r.id for r in ranking.with_rank(df, top=2).orderBy("rank").collect()] == [3, 1]
    assert ranking.with_rank(df.limit(0)).count() == 0
    assert ranking.statistics(small(spark)).first().total == 2
    assert ranking.statistics(small(spark).limit(0)).first().asDict() == {"total": 0, "bytes": 0, "mean_score": 0.0, "megapixels": 0.0, "errors": 0}


def test_versions_and_stream(spark, tmp_path):
    root = str(tmp_path / "index")
    assert photo_index.read_index(spark, root).count() == 0
    facts = spark.createDataFrame([("/a.jpg", 5, 1.0)], "path string, size long, mtime double")
    facts.write.parquet(str(tmp_path / "in"))
    for turn in range(2):
        stream = spark.readStream.schema(facts.schema).parquet(str(tmp_path / "in"))
        follow(stream, root, str(tmp_path / "checkpoint")).awaitTermination(60)
        assert [(r.id, r.path, r.mark) for r in photo_index.read_index(spark, root).collect()] == [(1, "/a.jpg", "none")]


def greedy(batch, index_codes, radius):
    taken, out = list(index_codes), []
    for code in batch:
        near = any((code ^ t).bit_count() <= radius for t in taken)
        out.append("similar" if near else "import")
        if not near:
            taken.append(code)
    return out


def test_similar_import_is_the_sequential_rule(spark):
    codes = [0, 3, 15, 63, 255, 1 << 40, (1 << 40) | 1, 0xFFFF << 20, 7 << 50]
    shots = lambda cs, first: [(first + i, i, f"{c:016x}", "0" * 16, [0] * 48, "ok") for i, c in enumerate(cs)]
    schema = "id long, ord long, phash string, dhash string, color_sig array<int>, status string"
    known = [0xFFFF << 20]
    got = transfer.similar_import(spark.createDataFrame(shots(codes, 100), schema), spark.createDataFrame(shots(known, 1), schema), Settings(phash_threshold=2))
    assert [r.outcome for r in got.orderBy("ord").collect()] == greedy(codes, known, 2)


def test_exact_import(spark):
    batch = spark.createDataFrame([(1, "/a", "x"), (2, "/b", "y"), (3, "/c", "y"), (4, "/d", "z")], "ord long, path string, sha256 string")
    got = {r.path: (r.outcome, r.match) for r in transfer.exact_import(batch, spark.createDataFrame([("x", "/lib/x")], "sha256 string, path string")).collect()}
    assert got == {"/a": ("duplicate", "/lib/x"), "/b": ("import", None), "/c": ("duplicate", "/b"), "/d": ("import", None)}


def test_free_names(spark):
    plan = spark.createDataFrame([(1, "/o/a.jpg"), (2, "/o/a.jpg"), (3, "/o/a-1.jpg"), (4, "/o/b.jpg"), (5, "/o/x")], "id long, target string")
    got = {r.id: r.target for r in transfer.free_names(plan, spark.createDataFrame([("/o/b.jpg",)], "path string")).collect()}
    assert len(set(got.values())) == 5 and got[1] == "/o/a.jpg" and got[3] == "/o/a-1.jpg" and got[2] == "/o/a-2.jpg" and got[4] == "/o/b-1.jpg"


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    assert Settings.load(path) == Settings()
    s = Settings(phash_threshold=7, weights=Weights(sharpness=0))
    s.save(path)
    assert Settings.load(path) == s
    assert Settings.from_json('{"phash_threshold": "no", "unknown": 1, "color_threshold": 1}') == Settings(color_threshold=1.0)
    assert Settings.from_json("[1]") == Settings.from_json("{") == Settings()
    assert Weights(*[0.0] * 7).normalised()["detail"] == 1 / 7
    assert abs(sum(Weights(sharpness=-4).normalised().values()) - 1) < 1e-12


def png(path, pixels):
    h, w = len(pixels), len(pixels[0])
    raw = b"".join(b"\0" + b"".join(bytes(p) for p in row) for row in pixels)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_files_end_to_end(spark, tmp_path):
    from lumidex.workflows import scan

    shots = tmp_path / "shots"
    (shots / "node_modules").mkdir(parents=True)
    (shots / ".hidden").mkdir()
    picture = [[((x * 37 + y * 11) % 256, (x * 5) % 256, (y * 9) % 256) for x in range(32)] for y in range(24)]
    for name in ("a.PNG", "b.png", "node_modules/c.png", ".hidden/d.png", "note.txt"):
        png(shots / name, picture)
    (shots / "broken.png").write_bytes(b"not a picture" * 10)
    settings = Settings(min_file_bytes=20)
    listed = {r.path.rsplit("/", 1)[1] for r in files.list_files(spark, [str(shots), str(tmp_path / "absent")], settings).collect()}
    assert listed == {"a.PNG", "b.png", "broken.png"}
    assert files.count_files(spark, [str(shots / "b.png")], settings) == 1
    root = str(tmp_path / "index")
    counts = lambda r: (r.scanned, r.indexed, r.failed, r.skipped, r.removed)
    assert counts(scan(spark, root, [str(shots)], settings)) == (3, 2, 1, 0, 0)
    rows = {r.filename: r for r in photo_index.read_index(spark, root).collect()}
    assert rows["a.PNG"].sha256 == rows["b.png"].sha256 and rows["a.PNG"].phash == rows["b.png"].phash and (rows["a.PNG"].width, rows["a.PNG"].height) == (32, 24)
    assert rows["broken.png"].status == "error"
    (shots / "a.PNG").unlink()
    assert counts(scan(spark, root, [str(shots)], settings)) == (2, 0, 1, 1, 1)
    plan = spark.createDataFrame([(str(shots / "b.png"), str(tmp_path / "out" / "b.png")), ("/absent.png", str(tmp_path / "out" / "x.png"))], "path string, target string")
    for _ in range(2):  # placing again changes nothing
        assert [(r.path, r.bytes) for r in files.place_files(plan).where("error != ''").collect()] == [("/absent.png", 0)]
    assert (tmp_path / "out" / "b.png").read_bytes() == (shots / "b.png").read_bytes()
    assert files.delete_files(plan.select("path")) == (1, [])


def test_manifests(spark, tmp_path):
    import json

    rows = spark.createDataFrame([(2, "b.jpg", 1.5), (1, "a.jpg", 2.5)], "rank int, source string, score double")
    files.write_manifest_csv(rows, str(tmp_path / "m.csv"))
    text = (tmp_path / "m.csv").read_text().splitlines()
    assert text == ["rank,source,score", "1,a.jpg,2.5", "2,b.jpg,1.5"]
    files.write_manifest_json(rows, str(tmp_path / "m.json"), "rank", "copy", "now")
    got = json.loads((tmp_path / "m.json").read_text())
    assert got["count"] == 2 and [p["source"] for p in got["photos"]] == ["a.jpg", "b.jpg"]


def test_destinations_and_export_names(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("/card/x/y/a.jpg", "a.jpg", "2024-05-06 01:02:03", 0.0, 66.5, 7), ("/card/b.jpg", "b?.jpg", None, 86400.0, 7.2, 12345), ("/other/c.jpg", None, None, 0.0, 0.0, 1)], "path string, filename string, t string, mtime double, score double, rank int")
    df = df.withColumn("taken_at", F.col("t").cast("timestamp_ntz"))
    plans = [r[0] for r in df.select(transfer.destination("/lib", "date")).collect()]
    assert plans == ["/lib/2024/2024-05/a.jpg", "/lib/1970/1970-01/b.jpg", "/lib/1970/1970-01/c.jpg"]
    assert [r[0] for r in df.select(transfer.destination("/lib", "source", "/card")).collect()] == ["/lib/card/x/y/a.jpg", "/lib/card/b.jpg", "/lib/card/c.jpg"]
    names = df.select(*[transfer.export_name(n).alias(n) for n in ("rank", "score", "date", "original")]).collect()
    assert tuple(names[0]) == ("0007_a.jpg", "066_a.jpg", "2024-05-06_a.jpg", "a.jpg")
    assert tuple(names[1]) == ("12345_b_.jpg", "007_b_.jpg", "1970-01-02_b_.jpg", "b_.jpg") and names[2].original == "c.jpg"
    assert [r[0] for r in df.select(transfer.group_folder(F.lit(7))).limit(1).collect()] == ["group-007"]


def test_of_rows_that_repeat_a_path_the_last_counts_whole(spark):
    rows = [("/p/b.jpg", 1, 5.0), ("/p/b.jpg", None, 9.0), ("/p/b.jpg", 3, 7.0), (None, 4, 9.0)]
    got = {r.path: (r.id, r.size, r.mtime) for r in index.upsert(small(spark), spark.createDataFrame(rows, "path string, size long, mtime double")).collect()}
    assert got["/p/b.jpg"] == (2, None, 9.0) and None not in got
    timed = [("/p/n.jpg", 1, 9.0, 1.0), ("/p/n.jpg", 2, 5.0, 2.0), ("/p/n.jpg", 3, 9.0, None)]
    got = {r.path: (r.size, r.mtime) for r in index.upsert(small(spark).selectExpr("*", "0d AS indexed_at"), spark.createDataFrame(timed, "path string, size long, mtime double, indexed_at double")).collect()}
    assert got["/p/n.jpg"] == (2, 5.0)


def test_exact_import_keeps_every_row(spark):
    batch = spark.createDataFrame([(1, "/a", None), (2, "/b", ""), (3, "/c", ""), (4, "/d", "x"), (5, "/e", "x"), (6, "/f", "k")], "ord int, path string, sha256 string")
    known = spark.createDataFrame([("k", "/lib/k"), ("", "/lib/empty")], "sha256 string, path string")
    got = {r.path: (r.outcome, r.match) for r in transfer.exact_import(batch, known).collect()}
    assert got == {"/a": ("import", None), "/b": ("import", None), "/c": ("import", None), "/d": ("import", None), "/e": ("duplicate", "/d"), "/f": ("duplicate", "/lib/k")}


def test_a_crashed_write_does_not_block_the_next(spark, tmp_path):
    root = tmp_path / "index"
    photo_index.write_index(photo_index.empty_index(spark), str(root))
    (root / "v00000002").mkdir()
    (root / "v00000002" / "part-0.parquet").write_bytes(b"half")
    assert photo_index.write_index(photo_index.empty_index(spark), str(root)) == 3
    assert photo_index.read_index(spark, str(root)).count() == 0

import csv
import datetime
import json
import os
import struct
import zlib

import pytest

from lumidex import cli, workflows
from lumidex.operators import ranking, transfer
from lumidex.settings import Settings
from lumidex.sources import exif, files, photo_index

SMALL = Settings(min_file_bytes=20)


def tiff(order="<", make="Canon", model="Canon EOS R5", iso=400, orientation=6, taken="2024:05:06 07:08:09", **more):
    """A TIFF block with two directories; ``more`` adds measured values to the inner one."""
    pack = lambda form, *x: struct.pack(order + form, *x)
    held, outer, inner = b"", [], []
    base = 8 + 2 + 12 * 4 + 4 + 2 + 12 * (2 + len(more)) + 4

    def entry(tag, kind, count, raw):
        nonlocal held
        value = pack("I", base + len(held)) if len(raw) > 4 else raw.ljust(4, b"\0")
        held += raw if len(raw) > 4 else b""
        return (tag, kind, count, value)

    ascii_ = lambda tag, value: entry(tag, 2, len(value.encode()) + 1, value.encode() + b"\0")
    short = lambda tag, value: (tag, 3, 1, pack("HH", value, 0))
    outer = [ascii_(271, make), ascii_(272, model), short(274, orientation), (34665, 4, 1, pack("I", 8 + 2 + 12 * 4 + 4))]
    inner = [short(34855, iso), ascii_(36867, taken)]
    kinds = {"exposure_time": (33434, 5, "II"), "f_number": (33437, 5, "II"), "shutter_speed": (37377, 10, "ii"), "focal_length": (37386, 5, "II")}
    for name, value in more.items():
        inner.append(ascii_(42036, value) if name == "lens" else short(41986, value) if name == "exposure_mode" else entry(*kinds[name][:2], 1, pack(kinds[name][2], *value)))
    entries = lambda rows: pack("H", len(rows)) + b"".join(pack("HHI", t, k, n) + v for t, k, n, v in rows) + pack("I", 0)
    return (b"II*\0" if order == "<" else b"MM\0*") + pack("I", 8) + entries(outer) + entries(inner) + held


def jpeg(block):
    segment = lambda mark, body: b"\xff" + bytes([mark]) + (len(body) + 2).to_bytes(2, "big") + body
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xE1, b"Exif\0\0" + block) + b"\xff\xda" + b"\0" * 20


def png(path, seed, w=32, h=24, block=b"", blur=0):
    cell = lambda x, y: ((x // 4 * 37 + y // 3 * 11 + seed * 53 + x * y * seed) % 256, (x * 5 + seed * 29) % 256, (y * 9 * seed) % 256)
    raw = b"".join(b"\0" + b"".join(bytes(min(255, v + blur) for v in cell(x, y)) for x in range(w)) for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + (chunk(b"eXIf", block) if block else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.mark.parametrize("order", "<>")
def test_capture_facts(order):
    more = {"exposure_time": None, "f_number": None, "shutter_speed": None, "focal_length": None, "exposure_mode": None, "lens": ""}
    want = {"make": "Canon", "model": "Canon EOS R5", "iso": 400, "orientation": 6, "taken_at": datetime.datetime(2024, 5, 6, 7, 8, 9)} | more
    measured = tiff(order, exposure_time=(1, 250), f_number=(28, 10), shutter_speed=(-3, 2), focal_length=(50, 1), exposure_mode=1, lens="RF 50mm F1.2")
    assert exif.capture_facts(measured) == want | {"exposure_time": 1 / 250, "f_number": 2.8, "shutter_speed": -1.5, "focal_length": 50.0, "exposure_mode": 1, "lens": "RF 50mm F1.2"}
    assert exif.capture_facts(tiff(order, f_number=(1, 0)))["f_number"] is None
    block = tiff(order)
    assert exif.capture_facts(block) == exif.capture_facts(jpeg(block)) == want
    assert exif.capture_facts(tiff(order, taken="not a time"))["taken_at"] is None
    nothing = {"make": "", "model": "", "iso": None, "orientation": None, "taken_at": None} | more
    for broken in (b"", b"\xff\xd8", jpeg(b"II*\0"), b"II*\0\xff\xff\xff\x7f", b"MM\0*", b"\x89PNG\r\n\x1a\n\0\0", b"text" * 9):
        assert exif.capture_facts(broken) == nothing
    for cut in range(len(block)):
        exif.capture_facts(block[:cut])


def test_scan_reads_capture_facts_and_turns_pictures(spark, tmp_path):
    png(tmp_path / "s" / "up.png", 3, w=30, h=20)
    png(tmp_path / "s" / "turned.png", 3, w=30, h=20, block=tiff(">"))
    result = workflows.scan(spark, str(tmp_path / "i"), [str(tmp_path / "s")], SMALL)
    assert (result.indexed, result.failed) == (2, 0) and result.summary().startswith("2 photos: 2 analysed, 0 unchanged in ")
    rows = {r.filename: r for r in photo_index.read_index(spark, str(tmp_path / "i")).collect()}
    up, turned = rows["up.png"], rows["turned.png"]
    assert (up.width, up.height, turned.width, turned.height) == (30, 20, 20, 30)
    assert (turned.camera, turned.iso, turned.taken_at) == ("Canon EOS R5", 400, datetime.datetime(2024, 5, 6, 7, 8, 9))
    assert (up.camera, up.iso, up.taken_at) == ("", None, None)


def test_a_physical_file_is_listed_once(spark, tmp_path):
    png(tmp_path / "a" / "one.png", 1)
    os.link(tmp_path / "a" / "one.png", tmp_path / "a" / "two.png")
    png(tmp_path / "b" / "three.jpe", 2)
    png(tmp_path / "b" / "raw.nef", 2)
    png(tmp_path / "b" / ".hg" / "x.png", 4)
    os.symlink(tmp_path / "a", tmp_path / "b" / "again")
    names = lambda roots, s=SMALL: sorted(r.path.rsplit("/", 1)[1] for r in files.list_files(spark, roots, s).collect())
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert names([a]) == ["one.png"] and names([a, str(tmp_path)]) == ["one.png", "three.jpe"]
    assert names([b]) == ["three.jpe"]
    assert names([b], Settings(min_file_bytes=20, include_raw=True)) == ["raw.nef", "three.jpe"]
    assert names([b], Settings(min_file_bytes=20, follow_symlinks=True)) == ["one.png", "three.jpe"]


def library(tmp_path, **more):
    return Settings(min_file_bytes=20, library_root=str(tmp_path / "lib"), import_organise="date", **more)


def test_import_twice_then_similar(spark, tmp_path):
    card, root = tmp_path / "card", str(tmp_path / "i")
    png(card / "a.png", 1, block=tiff())
    png(card / "b.png", 2)
    png(card / "sub" / "a.png", 5, block=tiff())
    (card / "copy.png").write_bytes((card / "a.png").read_bytes())
    dry = workflows.import_photos(spark, root, [str(card)], library(tmp_path), dry_run=True)
    assert (dry.imported, dry.skipped_duplicate) == (3, 1) and not (tmp_path / "lib").exists()
    first = workflows.import_photos(spark, root, [str(card)], library(tmp_path))
    assert (first.imported, first.skipped_duplicate, first.failed) == (3, 1, 0)
    assert first.rejected == [(str(card / "copy.png"), "identical file", str(card / "a.png"))]
    placed = sorted(str(p.relative_to(tmp_path / "lib")) for p in (tmp_path / "lib").rglob("*.png"))
    assert placed[:2] == ["2024/2024-05/a-1.png", "2024/2024-05/a.png"] and len(placed) == 3
    # the index knows nothing yet: what stands at the destination is told by its bytes
    again = workflows.import_photos(spark, root, [str(card)], library(tmp_path))
    assert (again.imported, again.skipped_duplicate) == (1, 3)
    workflows.scan(spark, root, [str(tmp_path / "lib")], SMALL)
    indexed = workflows.import_photos(spark, root, [str(card)], library(tmp_path))
    assert (indexed.imported, indexed.skipped_duplicate) == (0, 4) and "4 already in library" in indexed.summary()
    png(tmp_path / "more" / "like-b.png", 2, blur=1)
    png(tmp_path / "more" / "other.png", 7)
    (tmp_path / "more" / "broken.png").write_bytes(b"no picture" * 9)
    wary = workflows.import_photos(spark, root, [str(tmp_path / "more")], library(tmp_path, import_skip_similar=True))
    assert wary.skipped_similar == 1 and wary.rejected[0][1] == "looks the same as" and wary.rejected[0][2].endswith("b.png")
    assert (wary.imported, wary.failed) == (1, 1)
    moved = workflows.import_photos(spark, root, [str(tmp_path / "more")], library(tmp_path, import_mode="move", import_skip_similar=True))
    assert "moved" in moved.summary()


def test_moves_leave_nothing_behind(spark, tmp_path):
    png(tmp_path / "card" / "a.png", 1)
    result = workflows.import_photos(spark, str(tmp_path / "i"), [str(tmp_path / "card")], library(tmp_path, import_mode="move"))
    assert result.imported == 1 and not (tmp_path / "card" / "a.png").exists() and len(list((tmp_path / "lib").rglob("*.png"))) == 1


def test_export(spark, tmp_path):
    shots, root = tmp_path / "shots", str(tmp_path / "i")
    png(shots / "a.png", 1)
    (shots / "b.png").write_bytes((shots / "a.png").read_bytes())
    png(shots / "c.png", 5)
    workflows.scan(spark, root, [str(shots)], SMALL)
    photos = photo_index.read_index(spark, root).where("status = 'ok'")
    _, long = workflows.long_groups(photos, SMALL)
    ranked = ranking.with_rank(photos)
    out = tmp_path / "out"
    result = workflows.export_photos(spark, ranked, str(out), Settings(export_group_folders=True, export_naming="rank"), long)
    assert (result.exported, result.failed) == (3, 0) and len(list((out / "group-001").iterdir())) == 2
    rows = list(csv.DictReader(open(result.manifest)))
    assert sorted(r["group_role"] for r in rows) == ["", "duplicate", "keeper"] and all((out / r["exported_as"]).exists() or (out / "group-001" / r["exported_as"]).exists() for r in rows)
    linked = workflows.export_photos(spark, ranked, str(tmp_path / "links"), Settings(export_mode="symlink", export_manifest="json"))
    assert linked.exported == 3 and all(p.is_symlink() for p in (tmp_path / "links").glob("*.png")) and json.load(open(linked.manifest))["count"] == 3
    bad = workflows.export_photos(spark, ranked, str(tmp_path / "bad"), Settings(export_mode="symlink", export_max_edge=100))
    assert (bad.exported, bad.failed, bad.manifest) == (0, 3, "") and "symbolic links" in bad.errors[0][1]
    none = workflows.export_photos(spark, ranked, str(tmp_path / "none"), Settings(export_manifest="none"))
    assert none.exported == 3 and none.manifest == "" and "3 photos" in none.summary()
    totals = workflows.preview(photos).first()
    assert totals.photos == 3 and totals.bytes == sum(p.stat().st_size for p in shots.iterdir())
    assert workflows.preview(photos.limit(0)).first().asDict() == {"photos": 0, "bytes": 0, "megapixels": 0.0, "mean_score": 0.0}


def test_command_line(spark, tmp_path, capsys):
    shots, root, saved = tmp_path / "shots", str(tmp_path / "i"), str(tmp_path / "s.json")
    Settings(min_file_bytes=20).save(saved)
    png(shots / "a.png", 1)
    (shots / "b.png").write_bytes((shots / "a.png").read_bytes())
    png(shots / "c.png", 5)
    run = lambda *args: cli.main(["--index", root, "--settings", saved, *args], spark)
    assert run("scan") == 1 and run("scan", str(shots), "--remember") == 0 and run("scan") == 0
    assert Settings.load(saved).watched_folders == (str(shots),)
    assert run("rank", "--sort", "name", "--limit", "2") == 0 and run("stats") == 0
    assert run("import", str(shots)) == 1 and run("import", str(shots), "--into", str(tmp_path / "lib"), "--organise", "flat") == 0
    assert run("export", str(tmp_path / "out"), "--best-only", "--naming", "score") == 0
    assert run("dupes", "--threshold", "4", "--delete", "--yes") == 0
    said = capsys.readouterr().out
    assert "1 groups, 2 photos, 1 removable" in said and "1 deleted" in said and "photos 3" in said and "3 already in library" in said
    assert sum(p.exists() for p in (shots / "a.png", shots / "b.png")) == 1
    assert photo_index.read_index(spark, root).count() == 2


def test_matches_of_similar_imports(spark):
    """The best look-alike of the index, or else the earliest accepted row of the batch."""
    color = "array_repeat(0, 48) AS color_sig"
    shots = lambda rows: spark.createDataFrame([(i, f"{c:016x}", o, s) for i, c, o, s in rows], "id long, phash string, ord int, score double").selectExpr("*", "phash AS dhash", color, "'ok' AS status")
    known = shots([(1, 0xF0, 0, 10.0), (2, 0xF1, 0, 90.0), (3, 0xFF0000, 0, 5.0)])
    batch = shots([(100, 0xF3, 1, 0.0), (101, 0xFFFF00000000, 2, 0.0), (102, 0xFFFF00000001, 3, 0.0), (103, 0xFFFF00000003, 4, 0.0)])
    got = {r.id: (r.outcome, r.match) for r in transfer.similar_import(batch, known, Settings(phash_threshold=3)).collect()}
    assert got == {100: ("similar", 2), 101: ("import", None), 102: ("similar", 101), 103: ("similar", 101)}


def test_free_names_meet_names_in_use(spark):
    plan = spark.createDataFrame([(1, "/o/a.jpg"), (2, "/o/a.jpg"), (3, "/o/a-1.jpg"), (4, "/o/a.jpg"), (5, "/o/b"), (6, "/o/b")], "id long, target string")
    taken = spark.createDataFrame([("/o/a-2.jpg",), ("/o/b",), ("/o/b-1",), ("/o/b-02",)], "path string")
    got = {r.id: r.target for r in transfer.free_names(plan, taken).collect()}
    assert len(set(got.values())) == 6 and not set(got.values()) & {"/o/a-2.jpg", "/o/b", "/o/b-1"}
    assert got[1] == "/o/a.jpg" and got[3] == "/o/a-1.jpg" and (got[5], got[6]) == ("/o/b-2", "/o/b-3")


def test_settings_ranges():
    given = '{"similarity_threshold": 12, "detect_rotations": true, "export_naming": "odd", "import_mode": "move", "phash_threshold": 12, "dhash_threshold": 99, "watched_folders": ["/a"], "include_raw": true}'
    s = Settings.from_json(given)
    assert (s.phash_threshold, s.match_rotations, s.export_naming, s.import_mode, s.dhash_threshold, s.watched_folders) == (12, True, "original", "move", 16, ("/a",))
    assert ".nef" in s.extensions and ".nef" not in Settings().extensions and ".avif" in Settings().extensions

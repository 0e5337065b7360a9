import numpy as np
from pyspark.sql import functions as F

from lumidex.functions import hashing, kernels, quality, text


def planes(n=40, seed=1):
    rng = np.random.default_rng(seed)
    return [np.round(rng.random((8, 8)), 6) for _ in range(n)] + [np.full((8, 8), 0.5), np.linspace(0, 1, 64).reshape(8, 8)]


def test_hashes_agree_with_kernels(spark):
    given = planes()
    df = spark.createDataFrame([(i, p.ravel().tolist()) for i, p in enumerate(given)], "id int, g array<double>")
    rows = df.select("id", hashing.ahash(F.col("g")).alias("a"), hashing.dhash(F.col("g")).alias("d"), hashing.phash(F.col("g")).alias("p"), hashing.rotations(F.col("g")).alias("r"), hashing.color_signature(F.col("g"), F.col("g"), F.col("g")).alias("c")).collect()
    for r in rows[:40]:
        plane = given[r.id]
        assert (r.a, r.d, r.p) == (kernels.ahash(plane), kernels.dhash(plane), kernels.phash(plane))
        assert r.r == kernels.rotations(plane)
        assert r.c == kernels.color_signature(np.repeat(plane[..., None], 3, axis=2))


def test_measures_agree_with_kernels(spark):
    given = planes(12, 2)
    df = spark.createDataFrame([(i, p.ravel().tolist()) for i, p in enumerate(given)], "id int, g array<double>")
    g, inverse = F.col("g"), F.transform("g", lambda v: 1 - v)
    raw = quality.raw_metrics(g, g, F.reverse("g"), inverse, F.lit(2.0))
    for r in df.select("id", *[c.alias(k) for k, c in raw.items()]).collect():
        plane = given[r.id]
        rgb = np.stack([plane, plane.ravel()[::-1].reshape(8, 8), 1 - plane], axis=2)
        want = kernels.measure(plane, rgb, 2.0)
        assert all(abs(r[k] - v) < 1e-9 for k, v in want.items()), (r, want)


def test_area_resize():
    plane = np.arange(36.0).reshape(6, 6)
    assert kernels.area_resize(plane, 3, 3)[0, 0] == plane[:2, :2].mean()
    assert kernels.area_resize(plane, 6, 12).shape == (6, 12)
    assert kernels.area_resize(plane, 6, 6) is plane


def test_small_planes_have_no_measures():
    tiny = np.ones((1, 1))
    assert kernels.laplacian(tiny).size == 0 and kernels.noise_sigma(tiny) == 0 and kernels.grain_ratio(tiny) == 0


def test_distances(spark):
    df = spark.createDataFrame([("ffffffffffffffff", "0"), ("zz", "0"), (None, "0"), ("f", "0")], "a string, b string")
    got = [r[0] for r in df.select(hashing.hamming(hashing.halves(F.col("a")), hashing.halves(F.col("b")))).collect()]
    assert got == [64, 64, 64, 4]
    df = spark.createDataFrame([([0] * 48, [255] * 48), (None, [0] * 48), ([0], [0, 1]), ([5] * 48, [5] * 48)], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(hashing.color_distance(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, 1.0, 0.0]


def test_names(spark):
    df = spark.createDataFrame([('a/b:c?.jpg',), ("  ..x..  ",), ("...",), ("",), (None,)], "n string")
    assert [r[0] for r in df.select(text.sanitised(F.col("n"))).collect()] == ["a_b_c_.jpg", "x", "photo", "photo", "photo"]
    df = spark.createDataFrame([("Canon", "Canon EOS"), ("NIKON", "Z 6"), (None, "X"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(text.camera_label(F.col("a"), F.col("b"))).collect()] == ["Canon EOS", "NIKON Z 6", "X", ""]
    df = spark.createDataFrame([(1920, 1080), (0, 5), (1001, 333), (31, 30)], "w int, h int")
    assert [r[0] for r in df.select(text.aspect(F.col("w"), F.col("h"))).collect()] == ["16:9", "-", "3.01:1", "1.03:1"]
    df = spark.createDataFrame([(999,), (1536,), (2304,), (150 * 1024,), (5 * 1024**3,)], "s long")
    assert [r[0] for r in df.select(text.human_size(F.col("s"))).collect()] == ["999 B", "1.5 KB", "2.3 KB", "150 KB", "5.0 GB"]
    df = spark.createDataFrame([("2024:05:06 07:08:09",), ("2024-05-06T07:08:09",), ("soon",)], "t string")
    assert [r[0] is not None for r in df.select(text.parsed_time(F.col("t"))).collect()] == [True, True, False]


def test_summary_and_keys(spark):
    df = spark.createDataFrame([(4000, 3000, "X", "2024-05-06 00:00:00"), (0, 0, "", None)], "w int, h int, c string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert [r[0] for r in df.select(text.summary(F.col("w"), F.col("h"), F.col("c"), F.col("t"))).collect()] == ["4000x3000  12.0 MP  X  2024-05-06", ""]
    assert len(df.select(text.thumbnail_key(F.lit("/a"), 256, F.lit(1.5))).first()[0]) == 40


def test_metrics_as_json(spark):
    df = spark.createDataFrame([('{"sharpness": 0.5, "noise": "x", "other": 1}',), ("[]",), ("no",), (None,)], "t string")
    rows = [r.m for r in df.select(quality.metrics_from_json(F.col("t")).alias("m")).collect()]
    assert rows[0] is None or (rows[0].noise is None and rows[0].detail is None)
    assert all(r is None or all(v is None for v in r) for r in rows[1:])
    back = df.limit(1).select(quality.metrics_json(F.struct(F.lit(0.25).alias("sharpness"))).alias("j"), quality.metrics_json(F.lit(None).cast("struct<sharpness:double>")).alias("n")).first()
    assert back.j == '{"sharpness":0.25}' and back.n == "{}"

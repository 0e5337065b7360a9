import brute  # noqa: F401
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumidex.llm import ann


def exact(ids, x, every, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for i in np.flatnonzero(ids % every == 0):
        score = np.round(x @ x[i], 12)
        score[i] = -9
        out |= {(ids[i], ids[j]) for j in np.lexsort((ids, -score))[:k] if j != i}
    return out


def test_hilbert_neighbours_touch():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    place = ann.hilbert_index(cells, 3)
    assert sorted(place) == list(range(512))
    walk = cells[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = docs.toPandas()
    want = exact(table.vec_id.to_numpy(), np.stack(table.embedding).astype(float), 50, 5)
    got = {(r.query_id, r.vec_id) for r in ann.neighbours(docs, 50, 5, block=64).collect()}
    assert len(want & got) / len(want) >= 0.9


def found(rows):
    return {(r.query_id, r.vec_id) for r in rows.collect()}


def test_recall_of_many_vectors(spark):
    """10,000 vectors without structure, and as many in clusters, for which a window of a small share is measured."""
    rng = np.random.default_rng(3)
    loose = rng.standard_normal((10_000, 64)).astype(np.float32)
    centres = rng.standard_normal((400, 64))
    tight = (centres[rng.integers(0, 400, 10_000)] + 0.05 * rng.standard_normal((10_000, 64))).astype(np.float32)
    for x, most in ((loose, 0.2), (tight, 0.06)):
        df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": [v.tolist() for v in x]}), "vec_id long, embedding array<float>")
        want = exact(np.arange(len(x)), x.astype(float), 50, 5)
        assert len(want & found(ann.neighbours(df, 50, 5))) / len(want) >= 0.93
        rows = ann.valid_vectors(df)
        tables = ann._Tables(spark)
        keyed = tables.stored(ann._keys(rows, ann.CURVES), "keys")
        ranks = ann._ranked(tables, keyed)
        assert ann._window(rows, keyed.selectExpr("id", "id AS point"), ranks, 50, 5) <= most * len(x)
        tables.remove()


def test_blocks_parts_and_windows_lose_nothing(spark, monkeypatch):
    """A window over everything is exact, whatever the blocks, and whether or not their queries are dealt to parts."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 8))
    x[:200] = np.round(x[:200])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = found(ann.neighbours(df, 10, 4, window=700))
    fine = np.flatnonzero(np.abs(x).sum(axis=1) > 0)
    assert len(whole ^ exact(fine, x[fine], 10, 4)) <= 8  # rounding of equal cosines
    monkeypatch.setattr(ann, "QUERY_BLOCKS", 0.14)
    monkeypatch.setattr(ann, "AT_ONCE", 3)
    assert found(ann.neighbours(df, 10, 4, window=700, block=50)) == whole
    near = found(ann.neighbours(df, 10, 4, window=40, block=50))
    assert near == found(ann.neighbours(df, 10, 4, window=40, block=1000))


def test_norms_and_lengths(spark):
    rows = [(i, [v * 1e200 for v in x]) for i, x in enumerate(([1.0, 0.0], [1.0, 0.1], [0.0, 1.0]))] + [(10, [1.0, 2.0, 3.0]), (11, [1.0, 2.0, 3.5]), (12, [1e-300, 0.0])]
    got = [(r.query_id, r.vec_id, round(r.score, 9)) for r in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10, 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 12, 1.0), (0, 1, round(1 / 1.01**0.5, 9)), (10, 11, round(15.5 / (14 * 17.25) ** 0.5, 9))]


def test_awkward_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (50, None), (100, [0.0, 0.0]), (150, [nan, 1.0]), (200, [1.0, None]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (None, [1.0, 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [1.0, 2.0, 3.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"point": F.lit("x"), "rank": F.lit(1)})
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in ann.neighbour_report(df).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0)]
    assert ann.neighbour_report(df.limit(0)).count() == 0


def test_copies_of_one_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(400 + i, [1.0, 2.0, 3.0 + i]) for i in range(1, 20)]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 100, 5)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert found[0] == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5} and found[300] == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4}

import random

import pytest

from lumidex.operators import components, groups, similarity
from lumidex.operators.components import connected_components
from lumidex.settings import Settings

SCHEMA = "id long, path string, filename string, sha256 string, phash string, dhash string, color_sig array<int>, score double, width int, height int, size long, mtime double, status string, rotations array<string>"


def photo(id, phash, dhash=None, color=0, score=50.0, sha="", width=10, height=10, size=1000, mtime=1.0, status="ok", rotations=None):
    return (id, f"/p/{id}.jpg", f"{id}.jpg", sha or f"sha{id}", phash, phash if dhash is None else dhash, None if color is None else [color] * 48, score, width, height, size, mtime, status, rotations)


def frame(spark, *photos):
    return spark.createDataFrame(list(photos), SCHEMA)


def found(df, **settings):
    return [r.asDict() for r in groups.duplicate_groups(df, Settings(**settings)).orderBy("group_index").collect()]


@pytest.mark.parametrize("radius", [0, 1, 4, 8, 10, 11, 12, 15, 16, 18, 24, 32, 64])
def test_segments_find_what_brute_force_finds(spark, monkeypatch, radius):
    rng = random.Random(radius)
    codes = [rng.getrandbits(64) for _ in range(120)]
    codes += [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 20))) for c in codes]
    df = similarity.hashed(spark.createDataFrame([(i, f"{c:016x}") for i, c in enumerate(codes)], "id long, phash string"))
    want = {(a, b) for a in range(len(codes)) for b in range(a + 1, len(codes)) if (codes[a] ^ codes[b]).bit_count() <= radius}
    assert {(r.a, r.b) for r in similarity.hamming_pairs(df, df, radius).collect()} == want
    monkeypatch.setattr(similarity, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(similarity, "TILE_ROWS", 50)
    assert {(r.a, r.b) for r in similarity.hamming_pairs(df, df, radius).collect()} == want
    probe = df.where("id < 20")
    assert {(r.a, r.b) for r in similarity.hamming_pairs(probe, df, radius, ordered=False).collect()} == {p for a, b in want for p in ((a, b), (b, a)) if p[0] < 20} | {(a, a) for a in range(20)}


def test_vetoes(spark):
    same = "ff00ff00ff00ff00"
    assert len(found(frame(spark, photo(1, same), photo(2, same)))) == 1
    assert not found(frame(spark, photo(1, "0" * 16), photo(2, "f" * 16)))
    assert not found(frame(spark, photo(1, same, color=0), photo(2, same, color=255)))
    assert not found(frame(spark, photo(1, same, "0" * 16), photo(2, same, "f" * 16)), dhash_threshold=2)
    assert not found(frame(spark, photo(1, same, ""), photo(2, same, "")))
    assert not found(frame(spark, photo(1, same, color=None), photo(2, same, color=None)))
    assert not found(frame(spark, photo(1, same), photo(2, same, status="error")))
    assert not found(frame(spark))


def test_chain_and_exact(spark):
    chain = [photo(i, f"{h:016x}") for i, h in enumerate((0, 3, 15, 63))]
    assert [g["n"] for g in found(frame(spark, *chain), phash_threshold=4)] == [4]
    exact = found(frame(spark, photo(1, "0" * 16, sha="x"), photo(2, "f" * 16, sha="x")))
    assert (exact[0]["kind"], exact[0]["tightness"]) == ("exact", 100.0)
    assert found(frame(spark, photo(1, "0" * 16, sha="x"), photo(2, "0" * 16, sha="x")), group_exact=False)[0]["kind"] == "similar"


def test_keeper_order_and_statistics(spark):
    h = "0" * 16
    assert found(frame(spark, photo(1, h, score=70.001, width=5), photo(2, h, score=70.0, width=50)))[0]["best_id"] == 2
    assert found(frame(spark, photo(1, h, width=50), photo(2, h, mtime=0.5)), prefer_larger_on_tie=False)[0]["best_id"] == 2
    df = frame(spark, photo(1, h, score=90.0, size=1000), photo(2, h, size=400), photo(3, h, size=300), photo(4, "f" * 16, size=10), photo(5, "f" * 16, size=10))
    got = groups.group_statistics(groups.duplicate_groups(df)).first().asDict()
    assert got == {"groups": 2, "photos_in_groups": 5, "removable": 3, "wasted_bytes": 710, "exact_groups": 0}
    assert [g["wasted"] for g in found(df)] == [700, 10]


def test_rotations(spark):
    turned = frame(spark, photo(1, "0" * 16, rotations=["0" * 16, "f" * 16, "0" * 16, "0" * 16]), photo(2, "f" * 16, dhash="0" * 16))
    assert len(found(turned, match_rotations=True)) == 1
    assert not found(turned)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2060)] + [(None, 3), (5, 5)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_in_one_task_or_in_rounds(spark, monkeypatch, few):
    """Random graphs, a long path and a star, settled either way."""
    monkeypatch.setattr(components, "FEW_EDGES", few)
    rng = random.Random(few)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(120)]
    edges += [(1000 + i, 1001 + i) for i in rng.sample(range(90), 90)] + [(2000 + i, 1999) for i in range(50)] + [(7, 7), (None, 5)]
    top = {n: n for e in edges for n in e if n is not None}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in top if find(n) != n or any(find(m) == n for m in top if m != n)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0

import random

import brute  # noqa: F401
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumidex.llm import nearcopies
from lumidex.llm.common import groups_of
from lumidex.llm.simhash import BKForest


def plain_components(docs):
    """The least id reachable over pairs of texts with a five-word Jaccard of 0.8 or more, by comparing all pairs that share a shingle."""
    sets = {}
    for key, text in docs:
        words = text.lower().split()
        sets[key] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    top = {key: key for key in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    holders, pairs = {}, 0
    for key, own in sorted(sets.items()):
        shared = {}
        for s in own:
            for other in holders.setdefault(s, []):
                shared[other] = shared.get(other, 0) + 1
            holders[s].append(key)
        for other, n in shared.items():
            if n >= 0.8 * (len(own) + len(sets[other]) - n):
                pairs += 1
                a, b = find(key), find(other)
                top[max(a, b)] = min(a, b)
    return {key: find(key) for key in sets}, pairs


def test_stage_keeps_one_of_copies_at_eight_tenths(spark):
    rng = random.Random(3)
    docs = []
    for group in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        docs.append((10 * group, " ".join(words)))
        for copy in range(1, 1 + group % 4):
            edited = list(words)
            for _ in range(rng.randrange(1, 5)):
                edited[rng.randrange(150)] = f"new{rng.randrange(10**6)}"
            docs.append((10 * group + copy, " ".join(edited)))
    df = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in docs], brute.SCHEMA)
    want, pairs = plain_components(docs)
    assert pairs > 20
    assert {r.key: r.component for r in nearcopies.near_copies(df).collect()} == want
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == set(want.values())


def test_chains_across_components_are_joined(spark):
    """Ends of a chain are not alike, and the least member of a bucket need not be alike to all others of it."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    docs = []
    for step in range(12):
        docs.append((step, " ".join(words)))
        at = rng.randrange(190)
        words = [*words[:at], *[f"n{step}{i}" for i in range(8)], *words[at + 8 :]]
    df = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in docs], brute.SCHEMA)
    assert {r.key: r.component for r in nearcopies.near_copies(df).collect()} == plain_components(docs)[0]


def borderline(n, seed):
    """Copies of one text edited so that some pairs are alike and most are not, while nearly all share a bucket."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(160)]
    docs = []
    for key in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(160)] = f"x{rng.randrange(10**6)}"
        docs.append((key, " ".join(words)))
    return docs


@pytest.mark.parametrize("size", [None, 6000])
def test_a_group_of_unlike_copies_in_tiles(spark, monkeypatch, size):
    """With one part to a bucket and with many, every link is found once it is not implied."""
    if size:
        monkeypatch.setattr(nearcopies, "PART_BYTES", size)
    docs = borderline(150, 7) + [(1000 + k, t) for k, t in borderline(60, 8)] + [(2000 + i, f"short {i % 3} text") for i in range(9)]
    df = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in docs], brute.SCHEMA)
    want, _ = plain_components(docs)
    assert 5 < len(set(want.values())) < 150
    assert {r.key: r.component for r in nearcopies.near_copies(df).collect()} == want


@pytest.mark.parametrize("parts", [20_000, 7])
def test_crowded_buckets_meet_by_rare_shingles(spark, monkeypatch, parts):
    """The same links as by comparing all pairs, whichever way the texts meet."""
    monkeypatch.setattr(nearcopies, "DENSE", 2)
    monkeypatch.setattr(nearcopies, "PART_ROWS", parts)
    docs = borderline(150, 7) + [(1000 + k, t) for k, t in borderline(60, 8)] + [(3000 + k, t) for k, t in template(60, 9, 0.75)] + [(2000 + i, f"short {i % 3} text") for i in range(9)]
    df = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in docs], brute.SCHEMA)
    want, _ = plain_components(docs)
    assert 60 < len(set(want.values())) < 250
    assert {r.key: r.component for r in nearcopies.near_copies(df).collect()} == want


def template(n, seed, share):
    """Pages of one template: so much of their words is common, the rest their own."""
    rng = random.Random(seed)
    common = [f"w{rng.randrange(5000)}" for _ in range(200)]
    own = round(200 * (1 - share) / share)
    return [(key, " ".join(common[:100] + [f"{seed}x{rng.randrange(10**9)}" for _ in range(own)] + common[100:])) for key in range(n)]


def test_pages_of_a_template_never_meet(spark, monkeypatch):
    """Below 0.8 no pair of them is a candidate, however many they are."""
    monkeypatch.setattr(nearcopies, "DENSE", 64)
    docs = template(400, 5, 0.72)
    df = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in docs], brute.SCHEMA)
    asked = []
    verified = nearcopies._verified
    monkeypatch.setattr(nearcopies, "_verified", lambda pairs, *rest: asked.append(pairs.count()) or verified(pairs, *rest))
    assert {r.component for r in nearcopies.near_copies(df).collect()} == set(range(400))
    assert len(asked) == 3 and asked[1:] == [0, 0] and asked[0] <= 24 * 400


def test_rare_pairs_are_all_that_can_be_alike():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(2, 30))
        size = np.sort(rng.integers(5, 60, n))
        pos = (rng.random(n) * size / 5).astype(np.int64)
        code, comp = rng.permutation(100)[:n], rng.integers(0, 4, n)
        zero = np.zeros(n, np.int64)
        got = {tuple(r) for r in nearcopies.rare_pairs(code, comp, size, pos, zero, zero, zero).tolist()}
        want = set()
        for x in range(n):
            for y in range(n):
                m, k = size[x], size[y]
                if m <= k and pos[x] * 9 <= m and comp[x] != comp[y] and 5 * m >= 4 * k and 9 * min(m - pos[x], k - pos[y]) >= 4 * (m + k):
                    want.add((min(code[x], code[y]), max(code[x], code[y])))
        assert got == want


def test_a_fingerprint_is_the_majority_of_bits():
    digests = np.unique(np.random.default_rng(3).integers(0, 1 << 64, 1300, np.uint64))
    for n in (1, 2, 255, 256, 1021, len(digests)):
        whole = nearcopies.fingerprint(digests[:n], 4)
        assert (whole[:2] == nearcopies.fingerprint(digests[:n], 2)).all()
        one = [nearcopies.fingerprint(digests[i : i + 1], 4) for i in range(n)]
        for word in range(4):
            for bit in range(0, 64, 7):
                assert int(whole[word]) >> bit & 1 == (2 * sum(int(x[word]) >> bit & 1 for x in one) > n)
    cells = [int(whole[i // 64]) >> i % 64 & 1 for i in range(256)]
    assert nearcopies.places(whole, 9).tolist() == [(r << 9) + sum(cells[9 * r + i] << i for i in range(9)) for r in range(28)]


def test_a_forest_is_searched_as_by_comparing_all():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, words = int(rng.integers(1, 60)), int(rng.integers(1, 4))
        shard, comp = np.sort(rng.integers(0, 5, n)), rng.integers(0, 4, n)
        base = rng.integers(0, 1 << 64, (words, 4), np.uint64)
        codes = [b[rng.integers(0, 4, n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) for b in base]
        apart = sum(np.bitwise_count(c[:, None] ^ c[None, :]).astype(int) for c in codes)
        radius = int(rng.integers(0, 70))
        near = {(i, j) for i in range(n) for j in range(n) if i != j and shard[i] == shard[j] and apart[i, j] <= radius}
        found = [tuple(x) for at, node in BKForest(shard, codes).within(np.arange(n), radius) for x in zip(at.tolist(), node.tolist())]
        assert len(found) == len(near) and set(found) == near
        wide = {(i, j) for i in range(n) for j in range(i) if shard[i] == shard[j] and comp[i] != comp[j] and apart[i, j] <= nearcopies.RADIUS}
        assert {(max(x), min(x)) for at, node in nearcopies.pairs_across(shard, comp, codes) for x in zip(at.tolist(), node.tolist())} == wide


@pytest.mark.parametrize("rows", [8192, 40])
def test_trees_of_shards_find_pairs_at_eight_tenths(spark, monkeypatch, rows):
    """Every pair meets in a shard, whole shards or parts of them, and nothing unlike is linked."""
    monkeypatch.setattr(nearcopies, "TREE_ROWS", rows)
    rng = random.Random(6)
    docs = []
    for group in range(150):
        own = [f"g{group}w{i}" for i in range(rng.choice([8, 12, 40, 184]))]
        docs.append((2 * group, " ".join(own)))
        docs.append((2 * group + 1, " ".join([*own, *[f"n{group}x{i}" for i in range((len(own) - 4) // 4)]])))  # the likeness is 0.8
    df = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in docs], brute.SCHEMA)
    marked = nearcopies._marked(df, "doc_id", "text", nearcopies.run_bits(len(docs)))
    key = {r.code: r.key for r in marked.collect()}
    links = {tuple(sorted((key[r.a], key[r.b]))) for r in nearcopies._shard_links(marked.withColumn("fam", F.col("code"))).collect()}
    assert links == {(2 * g, 2 * g + 1) for g in range(150)}


def test_groups_of_sorted_batches():
    rng = random.Random(2)
    for _ in range(200):
        keys = sorted(rng.choices(range(6), k=rng.randint(0, 30)))
        rows, batches = pd.DataFrame({"k": keys, "n": range(len(keys))}), []
        while len(rows):
            m = rng.randint(0, 5)
            batches.append(rows.iloc[:m])
            rows = rows.iloc[m:]
        got = [(pdf["k"].iloc[lo], pdf["n"].iloc[lo:hi].tolist()) for pdf, ends in groups_of(iter(batches), ["k"]) for lo, hi in zip(ends, ends[1:])]
        assert got == [(k, [i for i, x in enumerate(keys) if x == k]) for k in sorted(set(keys))]


def test_wordless_and_equal_texts(spark):
    rows = [(r.key, r.component) for r in nearcopies.near_copies(brute.awkward(spark)).collect()]
    assert len(rows) == len(brute.AWKWARD)
    found = dict(rows)
    assert found[2] == found[3] and found[5] == found[6] == 5
    kept = nearcopies.keep_one(brute.awkward(spark))
    assert kept.columns == brute.awkward(spark).columns
    assert nearcopies.keep_one(brute.empty(spark)).count() == 0

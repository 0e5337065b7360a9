import hashlib
import math

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from lumidex.llm import urlfilter, veccodes
from lumidex.llm.common import unused, without

# vector codes


def plain_codes(rows):
    """``rows``: (vec_id, vector, label). From the definition, in Python's whole numbers."""
    kept = sorted(((v, e, x) for v, e, x in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    width = -(-max((len(e) for _, e, _ in kept), default=0) // 16)
    whole = [[math.floor(256 * c) for c in e] + [0] * (16 * width - len(e)) for _, e, _ in kept]
    parts = [[tuple(w[p * width : (p + 1) * width]) for w in whole] for p in range(16)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [list(x[:64]) for x in parts]

    def found():
        return [[min((apart(x, c), j) for j, c in enumerate(books[p])) for x in parts[p]] for p in range(16)]

    for _ in range(2):
        for p, near in enumerate(found()):
            for j in range(len(books[p])):
                mine = [x for x, (_, k) in zip(parts[p], near) if k == j]
                if mine:
                    books[p][j] = tuple(sum(c) // len(mine) for c in zip(*mine))
    near = found()
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    out = []
    for i, (v, _, x) in enumerate(kept):
        out.append((v, "".join(f"{near[p][i][1]:02x}" for p in range(16)), sum(near[p][i][0] for p in range(16)), x))
    return sorted(((v, code, e, sum(o[2] for o in out if o[3] == x), digest) for v, code, e, x in out), key=repr)


def coded(spark, rows, schema="vec_id long, embedding array<double>, label int"):
    return sorted((tuple(r) for r in veccodes.code_report(spark.createDataFrame(rows, schema)).collect()), key=repr)


@pytest.mark.parametrize("most,terms", [(3, 4), (200, 4), (2**20, 4), (2**27, 4), (2**26, 48), (60_000, 200)])
def test_screening_is_exact(most, terms):
    rng = np.random.default_rng(terms)
    book = rng.integers(-most, most + 1, (64, terms))
    book[40] = book[3]
    x = np.concatenate([rng.integers(-most, most + 1, (300, terms)), book, book[:32] + rng.integers(-1, 2, (32, terms)), (book[:32] + book[32:]) // 2])
    entry, apart = veccodes.nearest(x, book)
    every = ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    assert (entry == every.argmin(axis=1)).all() and (apart == every.min(axis=1)).all()
    assert len(veccodes.nearest(x[:0], book)[0]) == 0


def test_codes_against_plain_version(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(c) for c in rng.normal(0, 0.3, 32)], None if i % 7 == 0 else int(i % 3)) for i in rng.permutation(220)]
    rows += [(None, [0.5] * 32, 1), (3, [0.25] * 32, 1), (3, [0.25] * 32, 1), (900, None, 1), (901, [None] + [0.1] * 31, 1), (902, [float("nan")] + [0.1] * 31, 1), (903, [float("-inf")] + [0.1] * 31, 1), (904, [], 2), (905, [-0.001, 1000.5], None)]
    assert coded(spark, rows) == plain_codes(rows)


def test_few_vectors(spark):
    assert coded(spark, []) == []
    assert coded(spark, [(1, None, 1)]) == []
    rows = [(5, [1.0, -1.0, 0.0], 1), (2, [-0.5], 1)]
    assert coded(spark, rows) == plain_codes(rows)
    assert coded(spark, [(1, [], 1)]) == [(1, "00" * 16, 0, 0, hashlib.sha256(b"").hexdigest())]
    huge = coded(spark, [(1, [1e300, -1e300], 1), (2, [1e307 * 1.7, 0.0], 1)])
    assert len(huge) == 2 and all(r[2] >= 0 for r in huge)


def test_codes_with_other_columns(spark):
    rows = [(i, [0.01 * i, -0.02 * i], i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").selectExpr("*", "1 AS key", "2 AS code", "3 AS error", "4 AS vector", "5 AS found")
    assert sorted((tuple(r) for r in veccodes.code_report(df).collect()), key=repr) == plain_codes([(v, [float(np.float32(c)) for c in e], x) for v, e, x in rows])
    limit, veccodes.BROADCAST_LABELS = veccodes.BROADCAST_LABELS, 0
    try:
        assert veccodes.code_report(df).count() == 100
    finally:
        veccodes.BROADCAST_LABELS = limit


# URL filters

URLS = [
    "http://a.org/x", "http://a.org", "https://www.Example.ORG/es/1", "https://example.org/en/1", "https://example.org/en/10?x#y", "http://badexample.org/es/", "http://x.com/fr/", "http://x.com/de/2", "http://com/de/",
    "http://com.net/de/", "ftp://h.net/a/b?utm_source=q&b=2&a=1#top", "http://m.h.net/a/b/?a=1&b=2&ref=z", "http://h.net:80/a/b/index.html?b=2&a=1", "http://h.net/a/b", "no scheme", "", None, "x://y://z.org/p", "http://h.net?q=1", "http://H.net#f",
    "http://user@h.net/\u00e9\n/x", "://", "http://" + "a" * 50_000 + ".org/" + "b" * 50_000,
]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    host, tail = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    ends = [i for i in (tail.find(c) for c in "?#") if i >= 0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[: min(ends)] if ends else tail


def plain_rule(host, path):
    fit = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name), default=None)


def judged(spark, urls, listed, **limits):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 AS block", "'x' AS ROW", "2 AS word0", "3 AS possible", "4 AS listed", "5 AS Verdict")
    before = {k: getattr(urlfilter, k) for k in limits}
    for k, v in limits.items():
        setattr(urlfilter, k, v)
    try:
        found = urlfilter.filter_urls(df, spark.createDataFrame([(u,) for u in listed], "url string"))
        rows = found.collect()
    finally:
        for k, v in before.items():
            setattr(urlfilter, k, v)
    assert sorted(c.lower() for c in found.columns) == sorted({"page_id", "url", "block", "row", "word0", "possible", "listed", "host", "path", "rule", "verdict", "canonical"})
    assert all((r.block, r.ROW, r.word0, r.possible, r.listed) == (1, "x", 2, 3, 4) for r in rows)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict, r.canonical) for r in rows}


def test_rules_and_list(spark):
    listed = ["https://www.h.net/a/b/?a=1&b=2", None, "nothing", "http://x.com/de/2", "http://h.net/?q=1"]
    for limits in ({}, {"BROADCAST_BLOCKS": 0, "BROADCAST_URLS": 0}):
        got = judged(spark, URLS * 2, listed, **limits)
        assert len(got) == 2 * len(URLS)
        canon = {"h.net/a/b?a=1&b=2", "x.com/de/2", "h.net?q=1"}
        for i, url in enumerate(URLS * 2):
            host, path = plain_parts(url)
            rule = plain_rule(host, path)
            assert got[i][:2] == (host, path), url
            assert got[i][2:4] == ((rule.name, rule.verdict) if rule else (None, "block" if got[i][4] in canon else "allow")), url
        assert [got[i][3] for i in (10, 11, 12, 13, 18)] == ["block", "block", "block", "allow", "block"]


def test_filter_passes_all_listed_and_few_others(spark):
    known = spark.range(20_000).select(F.concat(F.lit("h.net/"), "id").alias("listed"))
    blocks = 20_000 * urlfilter.BITS // 512
    table = {r.block: tuple(r)[1:] for r in urlfilter.bloom_blocks(known, blocks).collect()}
    asked = spark.range(40_000).select("id", F.concat(F.lit("h.net/"), "id").alias("u"))
    rows = asked.select("id", urlfilter._block(F.col("u"), blocks).alias("block"), F.array(*urlfilter._masks(F.col("u"))).alias("masks")).collect()
    passed = [r.id for r in rows if r.block in table and all(w & m == m for w, m in zip(table[r.block], r.masks))]
    assert set(range(20_000)) <= set(passed) and len(passed) < 20_400
    assert all(1 <= sum(bin(m & (2**64 - 1)).count("1") for m in r.masks) <= urlfilter.PROBES for r in rows[:1000])


def test_no_pages_and_no_list(spark):
    assert judged(spark, [], ["http://a.net/"]) == {}
    assert {v[3] for v in judged(spark, ["http://a.net/", None], []).values()} == {"allow"}


def test_names():
    class Named:
        columns = ["a", "_Key", "_key_"]

    assert unused(Named, "_key", "_KEY", "b") == ["_key__", "_KEY___", "b"]
    assert without(Named, "A", "_key") == ["_key_"]

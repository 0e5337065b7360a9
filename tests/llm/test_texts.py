import hashlib
import random
import re
import zlib
from itertools import product

import brute
import numpy as np
import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumidex.llm import bpe, chat, ibf, langid, license_rules, licenses, linededup, mixing, queries, sharding, simhash
from lumidex.llm.common import NO_ID


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    oracle.same(queries.queries()[name](spark, oracle.DATA), queries.oracle_sql()[name], oracle.connect())


# licenses


def expansions(pattern):
    """All strings that a rule's pattern matches, its words alone."""
    from re import _parser

    def walk(items):
        out = [""]
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                more = [chr(arg)]
            elif name == "IN":
                more = [chr(b) for kind, x in arg for b in (range(x[0], x[0] + 1) if str(kind) == "RANGE" else [x])]
            elif name == "SUBPATTERN":
                more = walk(arg[3])
            elif name == "BRANCH":
                more = [s for branch in arg[1] for s in walk(branch)]
            elif name == "MAX_REPEAT":
                more = (["*empty*"] if arg[0] == 0 else []) + walk(arg[2])
                more = ["" if m == "*empty*" else m for m in more]
            else:
                raise AssertionError(name)
            out = [a + b for a, b in product(out, more)]
        return out

    return walk(_parser.parse(pattern))


def test_rules_hold_their_keyword():
    found = license_rules.rules()
    assert len(found) > 200
    for r in found:
        for text in expansions(r.pattern):
            assert r.keyword in text.split(), (r, text)


def test_license_report(spark):
    rows = {r.doc_id: r for r in licenses.license_report(brute.awkward(spark).where("doc_id IS NULL OR doc_id < 4")).collect() if r.n_words or r.doc_id}
    assert (rows[1].n_base, rows[1].first_word, rows[1].last_word, rows[1].base_labels) == (1, 9, 9, "mit")
    assert (rows[2].n_words, rows[2].n_base, rows[2].first_word, rows[2].labels, rows[2].score) == (0, 0, None, "", 0.0)
    assert (rows[None].n_base, rows[None].base_labels, rows[None].first_word, rows[None].last_word) == (2, "apache-2,cc-by-nc", 1, 6)
    text = "Released under the MIT License. Under the mit LICENSE!" * 3
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    want = [i for i in range(len(words)) if words[i : i + 4] == "under the mit license".split()]
    got = licenses.license_report(df).first()
    assert (got.n_words, got.n_base, got.first_word, got.last_word) == (len(words), len(want), want[0], want[-1])


def test_suppression(spark):
    df = spark.createDataFrame([("SPDX-License-Identifier: Apache-2.0; see Apache-2.0",), ("released under the GNU General Public License version 2",)], "text string")
    first, second = (r.detections for r in licenses.scan_licenses(df).collect())
    assert [d.label for d in first] == ["apache-2"] and first[0].priority == 1
    assert [d.label for d in second] == ["gpl-2"]
    assert licenses.scan_licenses(brute.empty(spark)).count() == 0


def test_overlapping_rules_are_brute_force(spark):
    """Random words of many rules in a row, so that matches overlap, contain one another and stand side by side."""
    rng = random.Random(11)
    rules = license_rules.rules()
    said = [rng.choice(expansions(r.pattern)) for r in rules for _ in range(2)]
    words = [w for x in said for w in x.split()]
    texts = [" ".join(rng.choice(said) if rng.random() < 0.6 else " ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 25))) for _ in range(250)]
    texts += [(rng.choice(said) + " ") * 40 for _ in range(20)] + ["", "MIT", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    n = 0
    for r in licenses.scan_licenses(df).collect():
        want = brute.license_detections(texts[r.doc_id], rules)
        assert sorted((d.first, d.last, d.priority, d.rule, d.label) for d in r.detections) == want, texts[r.doc_id]
        n += len(want)
    assert n > 1000


def test_a_text_of_very_many_matches(spark):
    text = "Released under the MIT License; see the Apache License, Version 2.0. " * 5000
    got = licenses.license_report(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert (got.n_words, got.n_base, got.first_word, got.last_word) == (60000, 10000, 1, 59995 - 0)


# sharding


def test_sharding(spark):
    rows = sharding.shard_report(brute.awkward(spark)).collect()
    assert len(rows) == len(brute.AWKWARD)
    assert sorted(r.size for r in rows) == sorted(1 + len((t or "").encode()) for _, t, *_ in brute.AWKWARD)
    assert sorted(r.text_crc32 for r in rows) == sorted(zlib.crc32((t or "").encode()) for _, t, *_ in brute.AWKWARD)
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"same text here")}) == 1
    assert sharding.shard_report(brute.empty(spark)).count() == 0


def test_shards_are_even(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = [r.b for r in sharding.shard_report(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 8 and max(sums) - min(sums) <= 64


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 10**6), max_size=60), st.integers(2, 8))
def test_differencing(sizes, k):
    parts = sharding.partition_sizes(sizes, k)
    assert len(parts) == len(sizes) and all(0 <= p < k for p in parts)
    sums = [sum(s for s, p in zip(sizes, parts) if p == j) for j in range(k)]
    assert not sizes or max(sums) - min(sums) <= max(sizes)
    assert sharding.partition_sizes([8, 7, 6, 5, 4], 2) in ([0, 1, 1, 0, 1], [0, 1, 1, 0, 0], [1, 0, 0, 1, 1], [1, 0, 0, 1, 0], [0, 1, 0, 1, 0], [0, 1, 0, 1, 1], [1, 0, 1, 0, 0], [1, 0, 1, 0, 1], [0, 0, 1, 1, 1], [1, 1, 0, 0, 0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), min_size=3, max_size=3), max_size=25))
def test_differencing_is_the_plain_one(partials):
    want = brute.differenced(partials)
    got = sharding.difference(partials)
    assert got == want


def test_shards_by_bundles(spark, monkeypatch):
    """Partial partitions combined in bundles of a few, over several levels, are as even, and every group is in one shard."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat(char(97 + int(id % 26)), int(20 + id * 37 % 900)) AS text").cache()
    sums = []
    for at_once in (4096, 9):
        monkeypatch.setattr(sharding, "AT_ONCE", at_once)
        rows = sharding.shard_report(docs)
        assert rows.groupBy("text_crc32").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0
        sums.append(sorted(r.b for r in rows.groupBy("shard").agg(F.sum("size").alias("b")).collect()))
        assert len(sums[-1]) == 8 and sum(sums[-1]) == sum(sums[0])
        assert sums[-1][-1] - sums[-1][0] <= 900


# line dedup


@pytest.mark.parametrize("min_words", [1, 3, 7, 12])
def test_line_dedup_is_brute_force(spark, min_words):
    rng = random.Random(min_words)
    pool = [" ".join(rng.choices("abcde", k=rng.randint(1, 4))) for _ in range(6)] + ["", "  "]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.9 else f"u{i} {rng.random()}" for _ in range(rng.randint(0, 14)))) for i in range(60)]
    docs += [(80, None), (81, "a b c\n" * 30), (81, "a b c\n" * 30), (82, ""), (83, "x y\np q\n" * 15)]
    want = brute.line_dedup(docs, min_words)
    rows = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words=min_words).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.text == want.get(r.doc_id)
        n = 0 if r.text is None else len(dict(docs)[r.doc_id].split("\n"))
        assert r.n_lines == n and 0 <= r.n_removed <= n


def test_line_dedup_awkward(spark):
    df = brute.awkward(spark)
    rows = linededup.dedup_lines(df)
    assert sorted(rows.columns) == sorted({*df.columns, "n_removed"}) and rows.count() == len(brute.AWKWARD)
    assert linededup.dedup_lines(brute.empty(spark)).count() == 0
    passage = " ".join(f"w{i}" for i in range(55))
    kept = {r.doc_id: r.text for r in linededup.keep_deduplicated(spark.createDataFrame([(1, f"a\n{passage}\nb"), (2, passage), (3, f"c\n{passage}")], "doc_id long, text string")).collect()}
    assert kept == {1: f"a\n{passage}\nb", 3: "c"}
    alone = spark.createDataFrame([(1, "a b c\n" * 30), (2, "x y\np q\n" * 15), (3, "x y\np q\n" * 40)], "doc_id long, text string")
    left = {r.doc_id: len(r.text.split()) for r in linededup.keep_deduplicated(alone).collect()}
    assert left == {1: 42, 2: 60}  # what is said over and over stays once as a run that counts
    strings = linededup.line_report(spark.createDataFrame([("b", passage), ("a", passage), (None, "z")], "doc_id string, text string"))
    assert {r.doc_id: r.n_removed for r in strings.collect()} == {"a": 0, "b": 1, None: 0}


# BPE


@pytest.fixture(scope="module")
def coders():
    import tiktoken

    tokens = bpe.read_ranks(queries.VOCABULARY)
    plain = tiktoken.Encoding("plain", pat_str=queries.public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    return bpe.DuckBpe(tokens, queries.public_tokenizers.PATTERN), plain


def test_bpe_is_the_library(coders):
    own, plain = coders
    rng = random.Random(2)
    letters = "ab cd\né中\U0001f600 \t  \x1c\x85 123'st don't"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 300))) for _ in range(200)]
    texts += ["", None, "a" * 3000, "ab" * 2000 + "c", "".join(rng.choices("abcdefgh", k=2000)), "!" * 500 + " " * 300 + "x", "".join(map(chr, range(0x3000))), "<|endoftext|>"]
    # words that go in pieces: without structure, with periods that do and do not divide the stride, of several scripts
    texts += ["".join(rng.choices("abcdefgh", k=n)) for n in (192, 193, 400, 30000)] + ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20000))]
    texts += [u * (6000 // len(u)) + v for u in ("a", "ab", "\u2014", "abc", "=-", "x" * 7 + "y", "\u0430\u0431\u0432\u0433\u0434", "\U0001f44d", " ", "\n") for v in ("", "!q")]
    texts += ["".join(rng.choices(["word", "ing", "\u00e9", "\u4e2d", "aaaa", "zz"], k=500)) for _ in range(20)]
    ids = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [plain.encode_ordinary(t or "") for t in texts]
    assert own.decode(ids) == [(t or "").encode() for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_bpe_round_trip(texts):
    own, plain = test_bpe_round_trip.coders
    ids = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [plain.encode_ordinary(t) for t in texts]
    assert own.decode(ids) == [t.encode() for t in texts]


@pytest.fixture(autouse=True)
def _hand_over(coders):
    test_bpe_round_trip.coders = coders


def test_latin_pattern_agrees():
    import regex

    whole, latin = regex.compile(queries.public_tokenizers.PATTERN), re.compile(bpe.latin_pattern(queries.public_tokenizers.PATTERN))
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(chr(rng.randrange(256)) if rng.random() < 0.5 else rng.choice(" a'ts\n1") for _ in range(12))
        assert whole.findall(text) == latin.findall(text)
    assert bpe.latin_pattern(r"\p{Lu}") is None


def test_bpe_columns(spark, coders):
    df, (_, plain) = brute.awkward(spark), coders
    args = (queries.VOCABULARY, queries.public_tokenizers.PATTERN)
    back = bpe.decode(bpe.encode(df, *args), *args)
    assert sorted(back.columns) == sorted({*df.columns, "bytes"})
    for r in back.collect():
        assert r.ids == plain.encode_ordinary(r.text or "") and bytes(r.bytes) == (r.text or "").encode()
    for r, (_, text, *_) in zip(bpe.round_trip_report(df, *args).collect(), brute.AWKWARD):
        raw = np.array(plain.encode_ordinary(text or ""), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert bpe.round_trip_report(brute.empty(spark), *args).count() == 0


# mixing


def test_mixing(spark):
    df = brute.awkward(spark)
    rows = mixing.mix_sources(df, epochs=3.0)
    assert sorted(rows.columns) == sorted({*df.columns, "place"})
    found = rows.collect()
    copies = {}
    for r in found:
        copies.setdefault(r.doc_id, []).append(r.copy)
    assert sorted(copies[5]) == list(range(len(copies[5]))) if 5 in copies else True
    assert {r.doc_id for r in mixing.mix_sources(df, {"b": 1.0}).collect()} <= {4, 5, 6}
    assert mixing.mix_sources(brute.empty(spark)).count() == 0
    assert mixing.mix_sources(df, {}).count() == 0


def test_rows_without_an_id_and_repeated_rows_are_drawn_one_by_one(spark):
    made = "repeat(concat('t', {0}), 20) AS text; if({0} % 2 = 0, 'a', 'b') AS source"
    for docs in (
        spark.range(4000).selectExpr("CAST(NULL AS long) AS doc_id", *made.format("id").split(";")),
        spark.range(4000).selectExpr("1L AS doc_id", *made.format("id % 2").split(";")),
        spark.range(4000).selectExpr("CAST(id % 2 AS string) AS doc_id", *made.format("id % 2").split(";")),
    ):
        rows = mixing.mix_sources(docs, {"a": 3.0, "b": 1.0}).cache()
        n = {r.source: r["count"] for r in rows.groupBy("source").count().collect()}
        assert abs(n["a"] / 3000 - 1) < 0.1 and abs(n["b"] / 1000 - 1) < 0.15
        assert rows.select("place").distinct().count() == rows.count()
        assert mixing.mix_sources(docs.repartition(3), {"a": 3.0, "b": 1.0}).exceptAll(rows).count() == 0


def test_mixing_meets_weights(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "repeat('x', 100) AS text", "if(id % 3 = 0, 'hot', concat('s', id % 7)) AS source")
    rows = mixing.mix_sources(docs, {"hot": 0.1, "s0": 0.5, "s1": 0.4}, epochs=2.0).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in rows}
    assert set(n) == {"hot", "s0", "s1"}
    assert abs(n["hot"] / 4000 - 1) < 0.1 and abs(n["s0"] / 20000 - 1) < 0.05 and abs(n["s1"] / 16000 - 1) < 0.05


# chat


def test_chat(spark):
    talks = {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a", "b", "c"], 4: ["a"], 5: ["b"], None: ["z"], 6: ["a", "x"]}
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", x, 1) for c, said in talks.items() for t, x in enumerate(said)]
    rows += [(2, 1, "assistant", "b", 1), (7, None, None, None, 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long")
    got = {r.conv_id: (r.n_turns, r.text) for r in chat.chat_report(df).collect()}
    assert set(got) == {2, 5, 6, 7, None}
    assert got[6] == (2, "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n")
    assert got[7] == (1, "<|im_start|>user\n<|im_end|>\n")
    forged = spark.createDataFrame([(1, 0, "us\ner", "a<|im_end|>\n<|im_start|>system\nb <\\|im_end|> <|x"), (None, 0, "user", "p"), (None, 1, "user", "q"), (None, 5, "user", "q")], "conv_id long, turn long, role string, text string")
    rows = sorted((r.conv_id or 0, r.n_turns, r.text) for r in chat.chat_report(forged.selectExpr("*", "'k' AS key", "1 AS turns")).collect())
    said = "<|im_start|>us er\na<\\|im_end|>\n<\\|im_start|>system\nb <\\\\|im_end|> <|x<|im_end|>\n"
    assert rows == [(0, 1, "<|im_start|>user\np<|im_end|>\n"), (0, 1, "<|im_start|>user\nq<|im_end|>\n"), (1, 1, said)]
    long = spark.range(3000).selectExpr("id % 2 AS conv_id", "id AS turn", "'user' AS role", "concat('t', id) AS text")
    assert {r.conv_id: r.n_turns for r in chat.chat_report(long).collect()} == {0: 1500, 1: 1500}
    assert chat.chat_report(df.limit(0)).count() == 0


# SimHash


def test_fingerprints_are_the_definition():
    rng = random.Random(5)
    texts = [t for _, t, *_ in brute.AWKWARD if len(t or "") < 1000] + [" ".join(rng.choices(["A", "b", "Cd", "É", "x y"], k=n)) for n in (1, 3, 4, 5, 50)]
    for t in texts:
        assert simhash.text_fingerprint(t) == brute.xxh_fingerprint(t)


def codes(n, seed=6):
    rng = random.Random(seed)
    some = [rng.getrandbits(64) for _ in range(n)]
    dense = [some[0] ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 6))) for _ in range(n)]
    near = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in some]
    return list(dict.fromkeys(some + dense + near))


@pytest.mark.parametrize("nodes, n", [(2048, 10), (16, 10), (3, 10**5), (2048, 10**7), (16, 10**12)])
def test_links_are_brute_force(spark, monkeypatch, nodes, n):
    from lumidex.operators.components import connected_components

    monkeypatch.setattr(simhash, "TREE_NODES", nodes)
    some = codes(120)
    signed = [c - (1 << 64) if c >> 63 else c for c in some]
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    root = {r.node: r.root for r in connected_components(simhash.links(df, n)).collect()}
    assert [root.get(s, s) for s in signed] == brute.components(signed, some, 4)


def test_block_masks():
    for n in (10, 10**6, 10**9, 10**12):
        masks = [m % (1 << 64) for m in simhash.block_masks(n)]
        rng = random.Random(n)
        for _ in range(300):
            flip = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not flip & m for m in masks)


def test_near_duplicates(spark):
    df = brute.awkward(spark)
    rows = simhash.near_duplicate_report(df).collect()
    want = [brute.xxh_fingerprint(t) for _, t, *_ in brute.AWKWARD]
    assert sorted(r.fingerprint for r in rows) == sorted(f"{w:016x}" for w in want)
    ids = [NO_ID if d is None else d for d, *_ in brute.AWKWARD]
    comp = brute.components(ids, want, 4)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id is None, r.component_id or 0) for r in rows) == sorted((d is None, d or 0, c == NO_ID, 0 if c == NO_ID else c) for (d, *_), c in zip(brute.AWKWARD, comp))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(set(comp))
    assert simhash.near_duplicate_report(brute.empty(spark)).count() == 0 and simhash.keep_one(brute.empty(spark)).count() == 0


# language


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    net = langid.fit(docs)
    odd = {r.doc_id: r for r in langid.identify(brute.awkward(spark), net).collect() if r.doc_id}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (2, 3, 8)) and odd[4].lang_pred != "und"
    assert langid.language_report(brute.empty(spark)).count() == 0
    assert {r.lang_pred for r in langid.language_report(docs.withColumn("lang", F.lit(None).cast("string")).limit(5)).collect()} == {"und"}


def test_gradients():
    """Backpropagation against finite differences."""
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 110, 90).astype(np.uint8)) for _ in range(3)]
    net = langid.train(texts, ["a", "b", "a"], steps=1)
    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rows, filled, owner = langid.pieces_of(texts)
    target = np.array([0, 1, 0])[owner]

    def loss():
        out = 0.0
        for row, n, lang in zip(rows, filled, target):
            p = brute.position_probabilities(w, bytes(row[:n]))
            out -= np.log(p[:, lang]).sum()
        return out / filled.sum()

    grads = langid._gradients(w, rows, filled, target)
    for k in ("fug", "rug", "fuc", "ruc", "vf", "vb", "fag", "rac"):
        for at in ((100, 2), (104, 5)) if k[1] == "a" else ((1, 1), (3, 0)):
            keep, step = w[k][at], 1e-4
            w[k][at] = keep + step
            up = loss()
            w[k][at] = keep - step
            down = loss()
            w[k][at] = keep
            assert abs((up - down) / (2 * step) - grads[k][at]) < 1e-6, k


@pytest.mark.parametrize("numbers", [langid.NUMBERS, 1])
def test_network_is_the_plain_one(monkeypatch, numbers):
    """Side by side in windows, or in strips of them, against one position after the other from end to end, for texts of any length."""
    monkeypatch.setattr(langid, "NUMBERS", numbers)
    rng = np.random.default_rng(4)
    lengths = (0, 1, 5, 63, langid.WINDOW - 1, langid.WINDOW, langid.WINDOW + 1, 200, 900, 2 * langid.WINDOW, 70 * langid.WINDOW + 3)
    texts = [bytes(rng.integers(97, 120, n).astype(np.uint8)) for n in lengths]
    net = langid.train([t for t in texts if t], list("abcabcabca"), steps=3)
    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    got = langid.document_probabilities(net, texts)
    for t, p in zip(texts, got):
        want = brute.position_probabilities(w, t).mean(axis=0) if t else np.zeros(3)
        assert np.abs(p - want).max() < 1e-4
    assert (got[0] == 0).all()


def test_states_are_carried_as_far_as_they_reach():
    """Units that hardly forget: the first bytes count up to the end of many windows."""
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(97, 120, n).astype(np.uint8)) for n in (3000, 1500, 40)]
    net = langid.train(texts, list("aba"), steps=2)
    for side in "fr":
        net.weights[side + "ag"][:, : langid.HIDDEN] -= 7  # the update gates are nearly shut
    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    for t, p in zip(texts, langid.document_probabilities(net, texts)):
        assert np.abs(p - brute.position_probabilities(w, t).mean(axis=0)).max() < 1e-4


def test_no_step_is_done_on_padding(monkeypatch):
    """Activations that are computed, against those of the bytes alone, for texts that leave most of their last window empty."""
    rng = np.random.default_rng(8)
    texts = [bytes(rng.integers(97, 120, n).astype(np.uint8)) for n in [600] * 20 + [1100] * 20]
    net = langid.train(texts[:4], list("abcd"), steps=2)
    done = []

    class Counting:
        def __getattr__(self, name):
            use = getattr(np, name)
            return (lambda x, **k: done.append(x.size) or use(x, **k)) if name in ("tanh", "exp") else use

    monkeypatch.setattr(langid, "np", Counting())
    langid.document_probabilities(net, texts)
    assert sum(done) < 1.25 * (2 * 3 * langid.HIDDEN + 4) * sum(map(len, texts))


def test_training_rows_are_bounded(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('ab ', 200) AS text", "if(id % 3 = 0, 'hot', concat('l', id % 40)) AS lang")
    counts = {r.lang: r["count"] for r in langid.training_pieces(docs, docs_per_lang=20).groupBy("lang").count().collect()}
    assert len(counts) == 41 and max(counts.values()) == 60 and counts["hot"] == 60


def test_the_fit_draws_from_whole_texts(spark, monkeypatch):
    """Each piece of a text is in the sample, or as likely as any other where there are too many."""
    text = "".join(chr(97 + i % 26) * 256 for i in range(100)) + "end"
    docs = spark.createDataFrame([(1, text, "x"), (2, "b", "y")], "doc_id long, text string, lang string")
    pieces = [r.piece for r in langid.training_pieces(docs).collect() if r.lang == "x"]
    assert sorted(pieces) == sorted([text[i : i + 256] for i in range(0, len(text), 256)])
    monkeypatch.setattr(langid, "PIECES_PER_LANG", 10)
    few = [r.piece for r in langid.training_pieces(docs).collect() if r.lang == "x"]
    assert len(few) == 10 and set(few) <= set(pieces)


# sketches


def likeness(a, b):
    pieces = lambda t: set(re.findall(ibf._PIECES, t or ""))
    a, b = pieces(a), pieces(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketches(spark):
    rows = sorted(ibf.version_report(brute.awkward(spark)).collect(), key=repr)
    order = sorted(brute.AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(rows) == len(order)
    by_id = {r.doc_id: r for r in rows}
    unique = [(d, t or "") for d, t, *_ in order if d is not None and [x[0] for x in order].count(d) == 1]
    for d, text in unique:
        at = [x[0] for x in order].index(d)
        if at + 1 == len(order):
            continue
        after = order[at + 1][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        r = by_id[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - likeness(text, edited)) < 1e-12 and abs(r.near_next - likeness(text, after)) < 1e-12
    assert ibf.version_report(brute.empty(spark)).count() == 0
    same = {r.fingerprint for r in rows if r.doc_id in (5, 6)}
    assert len(same) == 1


def test_peeling_finds_every_difference(spark):
    rng = random.Random(9)
    pairs = []
    for n in (0, 1, 5, 30, 200, 1500):
        a = [rng.getrandbits(63) for _ in range(n)]
        for share in (0.0, 0.5, 1.0):
            pairs.append((a, a[: int(n * share)] + [rng.getrandbits(63) for _ in range(n // 3)]))
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    df = df.withColumns({"sa": ibf.sketch(F.col("a")), "sb": ibf.sketch(F.col("b"))})
    for r in ibf.with_likeness(df, "near", "a", "b", "sa", "sb").collect():
        x, y = set(r.a), set(r.b)
        assert abs(r.near - (len(x & y) / len(x | y) if x | y else 1.0)) < 1e-12


def test_the_size_of_a_retry_is_computed_once(spark):
    """And not for each digest and place again: the power in it stands once in the plan for each retry."""
    df = spark.createDataFrame([([1, 2], [2, 3])], "a array<long>, b array<long>")
    df = df.withColumns({"sa": ibf.sketch(F.col("a")), "sb": ibf.sketch(F.col("b"))})
    plan = ibf.with_likeness(df, "near", "a", "b", "sa", "sb")._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("power(") == 1


def test_peeling_gives_up_a_sketch_without_a_single_digest(spark):
    """Too many digests for its cells: not done, nor after a digest that can be taken out."""
    many = list(range(1, 400))
    df = spark.createDataFrame([(many,), ([5, 6],), ([],)], "a array<long>")
    made = ibf._peeled(ibf.sketch(F.col("a")), F.lit(ibf.CELLS // 3).cast("long"))
    assert [r.p.done for r in df.select(made.alias("p")).collect()] == [False, True, True]


def plain_sketch(digests):
    """The cells of a fingerprint added up one by one, with the hashes as Spark gives them."""
    cells = {}
    for k, places, check in digests:
        for c in places:
            n, x, h = cells.get(c, (0, 0, 0))
            cells[c] = (n + 1, x ^ k, h ^ check)
    return cells


def test_sketches_and_not_sets_settle_likeness(spark):
    rows = ibf.version_report(spark.read.parquet(f"{oracle.DATA}/documents.parquet")).collect()
    took = [n for r in rows for n in (r.sketches_edited, r.sketches_next)]
    assert max(took) <= ibf.RETRIES and sum(n <= 2 for n in took) > 0.8 * len(took)


def test_written_fingerprint(spark):
    rng = random.Random(12)
    texts = ["", "one", "\n".join(f"line {i} {rng.random()}" for i in range(40)), " ".join(str(rng.random()) for _ in range(300)), "same\n" * 9]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    made = ibf.with_fingerprint(df).select("text", "fingerprint", ibf.paragraph_digests(F.col("text")).alias("d")).collect()
    third = ibf.CELLS // 3
    each = spark.createDataFrame([(d,) for r in made for d in r.d], "d long")
    facts = {r.d: ([j * third + r[f"p{j}"] for j in range(3)], r.check) for r in each.select("d", *[F.expr(f"int(pmod(xxhash64(d, {j}), {third})) AS p{j}") for j in range(3)], F.expr("xxhash64(d, 3) & 4294967295L AS check")).collect()}
    for r in made:
        pieces = set(re.findall(ibf._PIECES, r.text))
        assert len(r.d) == len(pieces) == int(r.fingerprint.split(":")[0])
        written = r.fingerprint.split(":")[1]
        got = {int(c[:2], 16): (int(c[2:10], 16), int(c[18:], 16), int(c[10:18], 16)) for c in (written[i : i + 34] for i in range(0, len(written), 34))}
        want = plain_sketch([(d % (1 << 64), *facts[d]) for d in r.d])
        assert got == {c: v for c, v in want.items() if any(v)}


def test_texts_of_very_many_paragraphs(spark):
    rng = random.Random(13)
    a, b = (["\n".join(f"{rng.getrandbits(60):x}" for _ in range(n)) for n in (20_000, 3)] for _ in range(2))
    df = spark.createDataFrame([(i, x + "\n" + y) for i, (x, y) in enumerate(zip(a, b))], "doc_id long, text string")
    rows = {r.doc_id: r for r in ibf.version_report(df).collect()}
    texts = [x + "\n" + y for x, y in zip(a, b)]
    assert abs(rows[0].near_next - likeness(texts[0], texts[1])) < 1e-12 and rows[0].near_edited > 0.5

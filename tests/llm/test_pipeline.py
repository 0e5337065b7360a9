import hashlib
import math
from collections import Counter

import brute
import numpy as np
from test_nearcopies import plain_components

import corpus_pipeline
from lumidex.llm import bpe, langid, mixing, queries


def poisson_count(mean, u):
    """The least n with a distribution function of u or more."""
    n, p = 0, math.exp(-mean)
    below = p
    while below < u:
        n += 1
        p *= mean / n
        below += p
    return n


def plain_mixture(rows):
    """How often each ``(doc_id, text, source)`` stands in the mixture; rows are distinct in these."""
    size = lambda t: max(1, len((t or "").encode()))
    total = Counter()
    for _, t, s in rows:
        total[s or ""] += size(t)
    weight = {s: b**mixing.POWER for s, b in total.items()}
    rate = {s: weight[s] / sum(weight.values()) * sum(total.values()) / total[s] for s in total}
    out = Counter()
    for d, t, s in rows:
        draws = max(1, math.ceil(rate[s or ""] / mixing.STEP))
        name = f"{'null' if d is None else d}|{hashlib.md5((t or '').encode()).hexdigest()}|{s or ''}"
        for j in range(draws):
            u = int(hashlib.md5(f"{mixing.SEED}|{name}|{j}".encode()).hexdigest()[:13], 16) / 2**52
            out[d, t, s] += poisson_count(rate[s or ""] / draws, u)
    return +out


def test_stages_against_plain_versions(spark, tmp_path):
    import tiktoken

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept, columns = docs, docs.columns
    outs = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, kept, "")
        made.write.parquet(str(tmp_path / name))
        before, kept = kept, spark.read.parquet(str(tmp_path / name))
        assert n == len(corpus_pipeline.STAGES) - 1 or kept.columns == columns
        outs.append((before, kept))
    (b, a), rest = outs[0], outs[1:]
    net = langid.fit(b)
    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    ids = {r.doc_id for r in a.collect()}
    for r in b.where("length(text) < 200").collect():
        text = r.text.encode()
        score = brute.position_probabilities(w, text).mean(axis=0).max() if any(c.isalpha() for c in r.text) else 0.0
        assert abs(score - langid.LEAST_SCORE) < 1e-3 or (r.doc_id in ids) == (score >= langid.LEAST_SCORE)
    assert len(ids) >= 0.97 * b.count()
    b, a = rest[0]
    want = brute.line_dedup(sorted((r.doc_id, r.text) for r in b.collect()), 40)
    original = {r.doc_id: r.text for r in b.collect()}
    assert {r.doc_id: r.text for r in a.collect()} == {k: t for k, t in want.items() if t.split() or t == original[k]}
    b, a = rest[1]
    assert sorted(r.doc_id for r in a.collect()) == sorted(set(plain_components([(r.doc_id, r.text) for r in b.collect()])[0].values()))
    b, a = rest[2]
    assert Counter((r.doc_id, r.text, r.source) for r in a.collect()) == plain_mixture([(r.doc_id, r.text, r.source) for r in b.collect()])
    b, a = rest[3]
    plain = tiktoken.Encoding("plain", pat_str=queries.public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(queries.VOCABULARY))}, special_tokens={})
    fact = lambda d, ids, digest: (d, tuple(ids), digest)
    want = Counter(fact(r.doc_id, plain.encode_ordinary(r.text or ""), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in b.collect())
    assert Counter(fact(r.doc_id, r.ids, r.decoded_sha256) for r in a.collect()) == want


def test_stages_stand_awkward_documents(spark):
    for name, stage in corpus_pipeline.STAGES:
        for df in (spark.createDataFrame(brute.AWKWARD, brute.SCHEMA), brute.empty(spark)):
            assert stage(spark, df, "").count() >= 0, name


def test_language_keeps_short_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rejected = docs.join(langid.keep_identified(docs), "doc_id", "left_anti")
    assert rejected.count() <= 0.01 * docs.count()

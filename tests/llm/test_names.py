"""Columns of the input may have any name that an operator uses inside: they come back with their values."""

import inspect
import re

import brute
import pytest

import corpus_pipeline
from lumidex.llm import bpe, chatrepair, common, ibf, langid, licenses, linededup, mixing, nearcopies, queries, sharding, simhash, urlfilter, veccodes
from lumidex.operators import components

MODULES = [bpe, chatrepair, common, components, ibf, langid, licenses, linededup, mixing, nearcopies, sharding, simhash, urlfilter, veccodes]
TAKEN = {"doc_id", "text", "lang", "source", "n_chars"}


def helper_names():
    """What the modules name columns, as their source tells, and what they give out."""
    found = {"_words", "_keywords", "_letters", "_found", "_name", "__k0", "__k1", "__spans"}
    for module in MODULES:
        said = inspect.getsource(module)
        found |= set(re.findall(r'(?:alias|withColumn|withColumnRenamed|lit|col)\("(\w+)"', said)) | set(re.findall(r'"(\w+)":', said))
    return sorted({n.lower() for n in found} - TAKEN)


def clashing(spark, form):
    names = [form(n) for n in helper_names()]
    df = spark.createDataFrame(brute.AWKWARD, brute.SCHEMA)
    return df.selectExpr("*", *[f"'{n}' AS `{n}`" for n in names]), names


def identified(df):
    return langid.identify(df, langid.fit(df))


OPERATORS = {
    "licenses": (licenses.scan_licenses, {"n_words", "detections"}),
    "language": (identified, {"lang_pred", "score"}),
    "lines": (linededup.dedup_lines, {"n_lines", "n_removed"}),
    "mixture": (mixing.mix_sources, {"copy", "place"}),
    "near copies": (nearcopies.keep_one, set()),
    "simhash": (simhash.keep_one, set()),
    "bpe": (lambda df: bpe.tokenised(df, queries.VOCABULARY, queries.public_tokenizers.PATTERN), {"n_tokens", "ids", "decoded_sha256"}),
} | {f"stage {name}": ((lambda df, f=f: f(df.sparkSession, df, "")), {"n_tokens", "ids", "decoded_sha256"} if name == "tokens" else set()) for name, f in corpus_pipeline.STAGES}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(spark, name):
    operator, replaced = OPERATORS[name]
    form = str.title if name.startswith("stage") else str.lower
    df, names = clashing(spark, form)
    rows = operator(df).collect()
    assert rows
    for r in rows:
        got = r.asDict()
        for n in names:
            if n.lower() not in replaced:
                assert got[n] == n, n
    assert {c.lower() for c in rows[0].asDict()} >= {c.lower() for c in names} | {"doc_id", "lang", "source", "n_chars"}

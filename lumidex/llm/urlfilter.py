"""URL filters: host and path rules, and beyond them a list of URLs behind a blocked Bloom filter.

A rule holds for its host and all subdomains where the path starts with the rule's; of several that
fit the longest decides. What no rule decides is blocked if its canonical form is listed. A canonical form has
no scheme, port of the scheme, ``www.`` or ``m.``, trailing slash or index page, tracking parameter or fragment, and its
parameters are in order.

The Bloom filter is a table of blocks of 512 bits. A URL's first hash names its block, a second one ``PROBES`` bits of it, so
that a test reads one row. Its size follows the number of listed URLs (``BITS`` bits for each). It
passes all listed URLs and few others; these possible hits alone go to an exact hash join with the
list, which removes the others. Up to ``BROADCAST_BLOCKS`` blocks (of under 100 bytes) the filter is
broadcast and no page moves; a larger one is joined by a shuffle, with the same result. The list
itself is broadcast up to ``BROADCAST_URLS`` URLs and shuffled beyond.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumidex.llm.common import unused, without
from lumidex.session import cut

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bits of the filter for each listed URL, words of a block, and bits that a URL sets in its block: 9 bits of a hash name one.
BITS = 16
WORDS = 8
PROBES = 7
BROADCAST_BLOCKS = 50_000
BROADCAST_URLS = 50_000
#: Parameters that tell where a visitor came from, and not what a page shows.
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid|sessionid)(=|$)"
_PARTS = "://([^/?#]*)([^?#]*)"
_QUERY = r"://[^?#]*\?([^#]*)"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))
#: Hosts with this label are reported as spam: their pages make up the list of the registered query.
REPORTED = "spam-farm"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case; empty for null and without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def canonical(url: Column) -> Column:
    """One form for the URLs of one page; empty for null and without ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)?$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"/(index\.html?)?$", "")
    pairs = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), _QUERY, 1), "&")
    query = F.array_join(F.array_sort(F.filter(pairs, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, of equally long ones the first; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.name))):
        name, verdict = (F.when(_fits(rule, host, path), F.lit(x)).otherwise(other) for x, other in ((rule.name, name), (rule.verdict, verdict)))
    return name, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _masks(url: Column) -> list[Column]:
    """The bits of a URL in each of its block's words: of every 9 bits of its hash, 3 name the word and 6 the bit."""
    digest = F.xxhash64(F.lit("bits"), url)
    places = [F.shiftrightunsigned(digest, 9 * i).bitwiseAND(F.lit(511)) for i in range(PROBES)]
    bit = lambda p, w: F.when(F.floor(p / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long"))
    return [reduce(lambda a, b: a.bitwiseOR(b), [bit(p, w) for p in places]) for w in range(WORDS)]


def bloom_blocks(listed: DataFrame, blocks: int, url: str = "listed") -> DataFrame:
    """``block, word0`` to ``word7``: the blocks that hold any URL of ``listed``."""
    rows = listed.select(_block(F.col(url), blocks).alias("block"), *[m.alias(f"word{w}") for w, m in enumerate(_masks(F.col(url)))])
    return rows.groupBy("block").agg(*[F.bit_or(f"word{w}").alias(f"word{w}") for w in range(WORDS)])


def filter_urls(df: DataFrame, listed: DataFrame, url: str = "url", list_url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``host, path, rule, verdict, canonical``: ``allow`` or ``block`` by the longest rule that fits, else by the list.

    ``listed`` has URLs to block in any form; null ones and such without ``://`` list nothing. A null
    URL, or one without ``://``, has empty host and path, no rule, and is allowed. Every row stays, repeated
    ones too; existing columns of the five names are replaced, others passed on.
    """
    new = ("host", "path", "rule", "verdict", "canonical")
    rest = without(df, *new)
    given = F.col(url)
    name, verdict = rule_of(host_of(given), path_of(given), rules)
    whole = df.select(F.struct(*rest).alias("row"), host_of(given).alias("host"), path_of(given).alias("path"), name.alias("rule"), verdict.alias("verdict"), canonical(given).alias("canonical"))
    known = cut(listed.select(canonical(F.col(list_url)).alias("listed")).where("listed != ''").distinct())
    count = known.count()
    blocks = max(1, -(-count * BITS // (64 * WORDS)))
    bloom = cut(bloom_blocks(known, blocks))
    bloom = F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom
    # a rule decides without the list: its rows look under no block
    asked = whole.withColumn("block", F.when(F.col("verdict").isNull() & (F.col("canonical") != ""), _block(F.col("canonical"), blocks)))
    decided, open_ = asked.where("block IS NULL").drop("block"), asked.where("block IS NOT NULL")
    all_set = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"word{w}"), F.lit(0).cast("long")).bitwiseAND(m) == m for w, m in enumerate(_masks(F.col("canonical")))])
    tested = open_.join(bloom, "block", "left").select("row", *new, all_set.alias("possible"))
    missed, possible = (tested.where(c).drop("possible") for c in (~F.col("possible"), F.col("possible")))
    exact = F.broadcast(known) if count <= BROADCAST_URLS else known.hint("shuffle_hash")
    hits = possible.join(exact, possible["canonical"] == exact["listed"], "left").withColumn("verdict", F.when(F.col("listed").isNotNull(), "block").otherwise("allow")).drop("listed")
    free = decided.unionByName(missed).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    return free.unionByName(hits).select("row.*", *new)


def url_report(df: DataFrame) -> DataFrame:
    """The fixed result of the registered query: what is listed are the pages of hosts reported as spam."""
    reported = df.select("url").where(F.array_contains(F.split(host_of(F.col("url")), r"\."), REPORTED))
    return filter_urls(df.select("page_id", "url"), reported).select("page_id", "host", "path", "rule", "verdict", "canonical")


def url_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The registered query over the view ``pages``, as DuckDB SQL: every rule is tried, and the list is a plain table."""
    given = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in rules)
    return f"""
WITH rules(h, p, said) AS (VALUES {given}),
parts AS (SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(coalesce(url, ''), '{_PARTS}', 1), '{_UPPER}', '{_UPPER.lower()}') AS host,
    regexp_extract(coalesce(url, ''), '{_PARTS}', 2) AS path, regexp_extract(coalesce(url, ''), '{_QUERY}', 1) AS query FROM pages),
formed AS (SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x != '' AND NOT regexp_matches(x, '{TRACKING}'))), '&') AS kept FROM parts),
urls AS (SELECT *, regexp_replace(regexp_replace(host, ':(80|443)?$', ''), '^(www|m)\\.', '') || regexp_replace(path, '/(index\\.html?)?$', '') || CASE WHEN kept != '' THEN '?' || kept ELSE '' END AS canonical FROM formed),
listed AS (SELECT DISTINCT canonical FROM urls WHERE list_contains(string_split(host, '.'), '{REPORTED}')),
best AS (SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(said, length(h || p)) AS said FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict, canonical
FROM urls LEFT JOIN best USING (r)
"""

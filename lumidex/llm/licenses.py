"""License scans: ordered signature rules over a text's words, behind a keyword prefilter.

A text is reduced to its lower-case words, each between two spaces of its own, so that a match of
one rule never takes a neighbour's boundary. One pass finds which keywords of the rules occur;
only rules whose keyword does are run. Each match is a detection with an interval of word places.
A detection is suppressed if another one of equal or higher priority contains its interval (of
equal intervals the higher priority, then the earlier rule stays); the base phrases have the
highest priority of all and always stay. Everything is a DataFrame expression on one row, so a
scan needs no shuffle.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumidex.llm.common import let, states_before, unused, without
from lumidex.llm.license_rules import rules

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands around a match; never part of a word.
_MARK = "\x01"
_DETECTION = "array<struct<first:int,last:int,priority:int,rule:int,label:string,confidence:double,base:boolean>>"


def _spaced(pattern: str) -> str:
    """The rule's pattern over words that have two spaces between them, and one at either end."""
    return f" (?:{pattern.replace(' ', '  ')}) "


@cache
def _keyword_pattern() -> str:
    """One pattern for all keywords, branching on the first letter."""
    by_letter: dict[str, list[str]] = {}
    for k in sorted({r.keyword for r in rules()}):
        by_letter.setdefault(k[0], []).append(k[1:])
    return " (" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by_letter.items()) + ") "


def canonical_words(text: Column) -> Column:
    """The words, each with a space before and after it; empty for null and for no word."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    joined = F.trim(F.regexp_replace(low, _BETWEEN, "  "))
    return F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit(" "), joined, F.lit(" ")))


def word_count(words: Column) -> Column:
    return ((F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit("")))) / 2).cast("int")


def _rule_table() -> Column:
    return F.array(*[F.struct(F.lit(r.keyword).alias("keyword"), F.lit(_spaced(r.pattern)).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.rule).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.confidence).alias("confidence"), F.lit(r.base).alias("base")) for r in rules()])


def _places(words: Column, rule: Column) -> Column:
    """The detections of one rule: marked in the text, which is then cut at the marks; every second piece is a match."""
    pieces = F.split(F.regexp_replace(words, rule["pattern"], F.lit(f"{_MARK}$0{_MARK}")), F.lit(_MARK), F.lit(-1))

    def found(sizes: Column) -> Column:
        def at(seen: Column) -> Column:
            here = lambda i: F.struct(seen[i].alias("first"), (seen[i] + sizes[i] - 1).alias("last"), rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["confidence"].alias("confidence"), rule["base"].alias("base"))
            return F.transform(F.sequence(F.lit(1), F.size(sizes) - 2, F.lit(2)), here)

        return F.when(F.size(sizes) < 3, F.array().cast(_DETECTION)).otherwise(let(states_before(sizes, F.lit(0), lambda seen, n: seen + n, "int"), at))

    return let(F.transform(pieces, word_count), found)


def _surviving(found: Column) -> Column:
    """Detections that no other of equal or higher priority contains, by a sweep from the left.

    ``reach[p]`` is the furthest end so far among priorities up to ``p``. In the order of the sweep
    all that can contain a detection come before it.
    """
    levels = 1 + max(r.priority for r in rules())
    order = F.sort_array(F.transform(found, lambda d: F.struct(d["first"].alias("first"), (-d["last"]).alias("back"), d["priority"].alias("priority"), d["rule"].alias("rule"), d.alias("d"))))

    def step(reach: Column, x: Column) -> Column:
        return F.transform(reach, lambda v, p: F.when(p >= x["priority"], F.greatest(v, -x["back"])).otherwise(v))

    def kept(order: Column) -> Column:
        before = states_before(order, F.array_repeat(F.lit(-1), levels), step, "array<int>")
        stays = lambda reach: F.filter(order, lambda x, i: x["d"]["base"] | (reach[i][x["priority"]] < -x["back"]))
        return F.transform(let(before, stays), lambda x: x["d"])

    return let(order, kept)


def scan_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words`` and ``detections`` (first and last word place, priority, rule, label, confidence, base).

    Null and empty texts have no words and no detections. Rows are independent: repeated rows give
    the same result twice. Existing columns of those names are replaced.
    """
    rest = without(df, "n_words", "detections")
    words, keywords = unused(df, "words", "keywords")
    rows = df.select(*rest, canonical_words(F.col(text)).alias(words))
    rows = rows.withColumn(keywords, F.array_distinct(F.regexp_extract_all(words, F.lit(_keyword_pattern()), F.lit(1))))
    chosen = F.filter(_rule_table(), lambda r: F.array_contains(F.col(keywords), r["keyword"]))
    found = F.flatten(F.transform(chosen, lambda r: _places(F.col(words), r)))
    none = F.array().cast(_DETECTION)
    found = F.when(F.size(keywords) == 0, none).otherwise(_surviving(found))
    return rows.select(*rest, word_count(F.col(words)).cast("long").alias("n_words"), found.alias("detections"))


def _labels(detections: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["label"]))), ",")


def license_report(df: DataFrame) -> DataFrame:
    """The fixed result of the registered query; ``score`` is the surest detection's confidence, 0 without any."""
    rows = scan_licenses(df.select("doc_id", "text")).drop("text")
    rows = rows.withColumn("base", F.filter("detections", lambda d: d["base"]))
    starts = F.transform("base", lambda d: d["first"].cast("long"))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _labels(F.col("base")).alias("base_labels"),
        _labels(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )


def license_sql() -> str:
    """The same result over the view ``documents``, as DuckDB SQL: rules joined on their keyword, suppression by an anti-join."""
    rows = ", ".join(f"({r.rule}, '{r.label}', '{r.keyword}', '{_spaced(r.pattern)}', {r.priority}, {r.confidence}::DOUBLE, {str(r.base).lower()})" for r in rules())
    return f"""
WITH rules(rule, label, keyword, pattern, priority, confidence, base) AS (VALUES {rows}),
low AS (SELECT row_number() OVER () AS r, doc_id,
        trim(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_BETWEEN}', '  ', 'g'), ' ') AS joined FROM documents),
docs AS (SELECT r, doc_id, CASE WHEN joined = '' THEN '' ELSE ' ' || joined || ' ' END AS words FROM low),
marked AS (SELECT r, rule, label, priority, confidence, base,
        string_split(regexp_replace(words, pattern, chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS pieces
        FROM docs JOIN rules ON contains(words, ' ' || keyword || ' ')),
cut AS (SELECT * EXCLUDE (pieces), unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM marked WHERE len(pieces) > 1),
counted AS (SELECT *, (length(piece) - length(replace(piece, ' ', ''))) // 2 AS n FROM cut),
placed AS (SELECT *, sum(n) OVER (PARTITION BY r, rule ORDER BY k) - n AS first FROM counted),
found AS (SELECT r, rule, label, priority, confidence, base, first, first + n - 1 AS last FROM placed WHERE k % 2 = 0),
kept AS (SELECT * FROM found x WHERE base OR NOT EXISTS (
        SELECT 1 FROM found y WHERE y.r = x.r AND y.first <= x.first AND y.last >= x.last AND y.priority <= x.priority
        AND NOT (y.first = x.first AND y.last = x.last AND y.priority = x.priority AND y.rule >= x.rule))),
summed AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(first) FILTER (WHERE base) AS first_word, max(first) FILTER (WHERE base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
        max(confidence) AS score FROM kept GROUP BY r)
SELECT doc_id, ((length(words) - length(replace(words, ' ', ''))) // 2)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
       first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM docs LEFT JOIN summed USING (r)
"""

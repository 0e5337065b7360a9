"""Vector codes: each of 16 parts of a vector becomes the number of the nearest entry of that part's codebook.

All is whole numbers, so results are exact: a component is ``floor(256 x)``, distances are squared
Euclidean ones, ties go to the lower index, and entries are replaced by floored means. The nearest
entry is screened for by a float32 matrix product. Its rounding error is bounded rigorously: with
``u = 2^-24``, a product of ``w`` terms whose factors were rounded to float32, in whatever order it is
summed, is off by at most ``g(w + 2) |x| |c|`` with ``g(n) = n u / (1 - n u)``; what is added to it in
float64 by a few parts in 2^51. So every entry has an interval that holds its true distance. Each
entry whose interval overlaps the best one's is evaluated again in int64, and ties are resolved
there.

The codebooks start as the parts of the least vectors, a bounded number. Every round reads all
vectors: a task gives out one row of sums for each entry at most, and what comes to the driver are the sums
of the entries, whose number does not depend on the input.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumidex.llm.common import id_back, id_key, short_batches
from lumidex.session import cut

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Labels up to which their table of sums (under 100 bytes a row) is broadcast; more are joined by a shuffle, with the same result.
BROADCAST_LABELS = 100_000
_U = 2.0**-24


def whole_numbers(vectors: list, width: int) -> np.ndarray:
    """``(rows, width)`` int64 components; shorter vectors are filled up with zeros.

    Components so large that a squared distance could pass 2^63 are held to the largest that cannot.
    """
    out = np.zeros((len(vectors), width))
    lengths = {len(v) for v in vectors}
    if len(lengths) == 1:
        out[:, : lengths.pop()] = np.array([np.asarray(v, np.float64) for v in vectors])
    else:
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
    most = math.isqrt(2**61 // max(1, width))
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * SCALE), -most, most).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` (int64) the index of the nearest row of ``book``, the lowest of equally near ones, and its squared distance."""
    terms = x.shape[1] + 2
    bound = terms * _U / (1 - terms * _U)
    product = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    square = (book * book).sum(axis=1).astype(np.float64)
    length = lambda v: np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
    # the distance without the row's own square, and how far off it can be
    score = square[None, :] - 2 * product
    off = 2 * bound * (1 + 2.0**-30) * length(x)[:, None] * length(book)[None, :] + 2.0**-51 * (square[None, :] + 2 * np.abs(product))
    best = (score + off).min(axis=1)
    rows, entries = np.nonzero(score - off <= best[:, None])  # each row has its best entry at least
    apart = x[rows] - book[entries]
    exact = (apart * apart).sum(axis=1)
    starts = np.searchsorted(rows, np.arange(len(x)))
    least = np.minimum.reduceat(exact, starts) if len(x) else exact
    first = np.flatnonzero(exact == least[rows])
    _, where = np.unique(rows[first], return_index=True)
    return entries[first[where]], least


def _cut_up(x: np.ndarray) -> np.ndarray:
    """``(parts, rows, width of a part)``."""
    return np.ascontiguousarray(x.reshape(len(x), PARTS, -1).swapaxes(0, 1))


def encode(vectors: list, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, parts)`` of entry numbers and of squared distances."""
    x = _cut_up(whole_numbers(vectors, PARTS * books.shape[2]))
    found = [nearest(x[p], books[p]) for p in range(PARTS)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _kept(df: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """``key, vector, label`` of the rows with a vector that holds finite numbers only."""
    short_batches(df.sparkSession)
    x = F.col(vector)
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    return df.where(x.isNotNull() & finite).select(id_key(df, id_col).alias("key"), x.cast("array<double>").alias("vector"), F.col(label).alias("label"))


def _round(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with every entry that is used replaced by the floored mean of its parts."""
    entries, width = books.shape[1:]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, width), np.int64)
        for pdf in batches:
            x = _cut_up(whole_numbers(pdf["vector"].tolist(), PARTS * width))
            for p in range(PARTS):
                found, _ = nearest(x[p], books[p])
                np.add.at(count[p], found, 1)
                np.add.at(total[p], found, x[p])
        p, e = np.nonzero(count)
        if len(p):
            yield pd.DataFrame({"part": p, "entry": e, "n": count[p, e], "total": total[p, e].tolist()})

    every = [F.sum(F.col("total")[i].cast("decimal(38,0)")) for i in range(width)]
    rows = kept.select("vector").mapInPandas(sums, "part int, entry int, n long, total array<long>").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*every).alias("total"))
    books = books.copy()
    for r in rows.collect():  # one row for each entry
        books[r["part"], r["entry"]] = [int(t) // r["n"] for t in r["total"]]
    return books


def codebooks(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS) -> np.ndarray:
    """``(parts, entries, width)``: fitted on all vectors, from the ``ENTRIES`` least ids (ties by the vector). No vector at all gives no entry."""
    kept = _kept(df, id_col, vector, id_col)
    width = -(-(kept.agg(F.max(F.size("vector"))).first()[0] or 0) // PARTS)
    first = [r.vector for r in kept.orderBy("key", "vector").select("vector").limit(ENTRIES).collect()]
    books = _cut_up(whole_numbers(first, PARTS * width)) if first else np.zeros((PARTS, 0, width), np.int64)
    for _ in range(rounds if first and width else 0):
        books = _round(kept, books)
    return books


def compress(df: DataFrame, books: np.ndarray, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``key, label, code, error``: 16 entry numbers as two hex digits each, and the squared distance of the vector from what they stand for.

    Rows whose vector is null or holds a null or a number that is not finite are left out; repeated rows and ids
    stay, a null id sorts before every other. Vectors shorter than the longest count as filled up
    with zeros, as do those whose length is no multiple of 16. Other columns are not read.
    """
    kept = _kept(df, id_col, vector, label)

    @F.pandas_udf("code string, error long")
    def coded(vectors: pd.Series) -> pd.DataFrame:
        entry, apart = encode(vectors.tolist(), books)
        return pd.DataFrame({"code": [row.tobytes().hex() for row in entry.astype(np.uint8)], "error": apart.sum(axis=1)})

    return kept.select("key", "label", coded("vector").alias("found")).select("key", "label", "found.code", "found.error")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_report(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """The fixed result of the registered query."""
    books = codebooks(df, id_col, vector)
    coded = cut(compress(df, books, id_col, vector, label))
    summed = cut(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    summed = F.broadcast(summed) if summed.count() <= BROADCAST_LABELS else summed
    named = coded.join(summed, coded["label"].eqNullSafe(summed["of"]))
    return named.select(id_back(df, id_col, "key").alias(id_col), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def code_sql(entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The registered query over the view ``embeddings``, as DuckDB SQL: every part is compared with every entry."""
    def assigned(n: int) -> str:
        return f"""far{n} AS (SELECT c.r, c.part, b.entry, sum((c.v - b.v) * (c.v - b.v))::BIGINT AS d FROM comps c JOIN book{n} b ON b.part = c.part AND b.pos = c.pos GROUP BY ALL),
near{n} AS (SELECT r, part, min(d) AS d, arg_min(entry, d * {entries} + entry) AS entry FROM far{n} GROUP BY ALL)"""

    def replaced(n: int) -> str:
        floor = "((sum(c.v) - ((sum(c.v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"
        return f"""means{n} AS (SELECT n.part, n.entry, c.pos, {floor} AS v FROM near{n} n JOIN comps c ON c.r = n.r AND c.part = n.part GROUP BY ALL),
book{n + 1} AS (SELECT b.part, b.entry, b.pos, coalesce(m.v, b.v) AS v FROM book{n} b LEFT JOIN means{n} m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)"""

    steps = ",\n".join(f"{assigned(n)},\n{replaced(n)}" for n in range(rounds))
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS FIRST, embedding) - 1 AS r, vec_id, label, embedding FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
wide AS (SELECT ceil(max(len(embedding)) / {PARTS}.0)::BIGINT AS w FROM kept),
comps AS (SELECT r, k // w AS part, k % w AS pos, floor({SCALE} * coalesce(embedding[k + 1], 0)::DOUBLE)::BIGINT AS v FROM kept, wide, range(0, {PARTS} * w) t(k)),
book0 AS (SELECT part, r AS entry, pos, v FROM comps WHERE r < {entries}),
{steps},
{assigned(rounds)},
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY r),
digest AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), digest
"""

"""Byte-level BPE in DuckDB, one in-process database in each Python worker.

Encoding: a text is split by a pattern; the distinct words of a batch become rows of token ids (at
first one id for each byte). A recursive query joins each word's adjacent positions with the merge
table, takes the leftmost pair of least rank and contracts it, until no word has a pair in the
table. Decoding: ids joined with the vocabulary, the bytes aggregated in order of position.

A word of more than ``2 STRIDE`` bytes is encoded by the same query in pieces, which overlap by half. Where
two neighbours hold the same token at the same place, the first one's tokens up to it and the
second one's from it on are joined. This gives the word's own encoding: a sequence of tokens is
the encoding of its bytes exactly if every two adjacent tokens are the encoding of theirs (the
first contraction across a token's edge would be made in that pair, too, as the order of
contractions in a part is that of the part alone), and every adjacent pair of the result stands in
one of the pieces. Neighbours without a common token are encoded again as one longer piece, so
the work is linear in the word but for such stretches (periods that do not divide ``STRIDE``).

Encoded words are kept for later batches, up to ``KEPT_WORDS`` of them; then, and between tasks, only the ones
met first stay, which costs time only.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, filterfalse, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumidex.llm.common import give_back, short_batches

#: Bytes from the start of one piece of a long word to that of the next; a piece has twice as many.
STRIDE = 96
#: Encoded words that a task keeps at most, and that stay beyond it: those met first, which are the frequent ones.
KEPT_WORDS = 400_000
STAYING_WORDS = 200_000
#: The states of one recursive query: token ids over all its steps, at most (a word of n bytes has n(n+1)/2), but for a single longer piece.
STATES_AT_ONCE = 4_000_000
#: Characters of the texts that are split together.
CHARS_AT_ONCE = 4_000_000
#: Words of a longer text that are encoded together.
WORDS_AT_ONCE = 200_000
#: Ids that one query decodes.
IDS_AT_ONCE = 600_000
#: What DuckDB may hold; it has nowhere to spill.
MEMORY = "192MB"

_RECURSIVE = """
WITH RECURSIVE state AS (
    SELECT w, toks, 0 AS step FROM words
    UNION ALL
    SELECT s.w, s.toks[:p.pos - 1] || [p.rank] || s.toks[p.pos + 2:], s.step + 1
    FROM state s JOIN (
        SELECT w, (least_pair >> 20)::INTEGER AS rank, (least_pair & 1048575)::INTEGER AS pos FROM (
            SELECT x.w, min((m.rank::BIGINT << 20) | x.pos) AS least_pair
            FROM (SELECT w, unnest(toks[:-2]) AS a, unnest(toks[2:]) AS b, generate_subscripts(toks[2:], 1) AS pos
                  FROM state WHERE len(toks) > 1) x
            JOIN merges m ON m.pair = (x.a::BIGINT << 20) | x.b
            GROUP BY x.w)
    ) p ON s.w = p.w
)
SELECT w, arg_max(toks, step) AS toks FROM state GROUP BY w ORDER BY w
"""

_DECODE = """
SELECT d, unhex(string_agg(v.hex, '' ORDER BY pos)) AS bytes
FROM (SELECT d, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM docs) JOIN vocab v USING (id)
GROUP BY d
"""


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def latin_pattern(pattern: str) -> str | None:
    """The pattern with its classes spelled out for the first 256 characters, for the faster ``re``.

    None if it has a property or escape other than letters, numbers and white space.
    """
    kinds = {r"\p{L}": "L", r"\p{N}": "N", r"\s": "s", r"\S": "S"}
    rest = re.sub(r"\\p\{[LN]\}|\\[sS]", "", pattern)
    if "\\" in rest:
        return None
    members = {"L": [], "N": [], "s": []}
    for i in range(256):
        kind = unicodedata.category(chr(i))[0]
        if kind in "LN":
            members[kind].append(i)
        elif chr(i) in "\t\n\v\f\r \x85\xa0":
            members["s"].append(i)
    text = {k: "".join(f"\\x{i:02x}" for i in v) for k, v in members.items()}
    out, inside, i = [], False, 0
    while i < len(pattern):
        kind = next((k for k in kinds if pattern.startswith(k, i)), None)
        if kind is None:
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
            continue
        name = kinds[kind]
        if name == "S" and inside:
            return None
        out.append(text[name] if inside else f"[^{text['s']}]" if name == "S" else f"[{text[name]}]")
        i += len(kind)
    return "".join(out)


class DuckBpe:
    """Encodes and decodes batches of texts; holds a DuckDB connection with merges and vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import duckdb
        import regex

        self.tokens = tokens
        self.pattern = regex.compile(pattern)
        latin = latin_pattern(pattern)
        self.latin = re.compile(latin) if latin else None
        rank = {t: i for i, t in enumerate(tokens) if t}
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.of_byte = np.array([rank.get(bytes([b]), 0) for b in range(256)], np.int32)
        pairs, ranks = [], []
        for token, r in rank.items():
            for cut in range(1, len(token)):
                a, b = rank.get(token[:cut]), rank.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append((a << 20) | b)
                    ranks.append(r)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self._put("merges", pa.table({"pair": pa.array(pairs, pa.int64()), "rank": pa.array(ranks, pa.int32())}))
        self._put("vocab", pa.table({"id": pa.array(range(len(tokens)), pa.int32()), "hex": pa.array([t.hex() for t in tokens])}))
        self.kept: dict[str, bytes] = {}

    def _put(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers; null as empty."""
        out: list[bytes] = []
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars + len(texts[hi] or "") <= CHARS_AT_ONCE):
                chars += len(texts[hi] or "")
                hi += 1
            if chars > CHARS_AT_ONCE:
                out.append(b"".join(self._ids([run])[0] for run in self._runs(texts[lo])))
            else:
                out += self._ids([self._splitter(t).findall(t) if t else [] for t in texts[lo:hi]])
            lo = hi
        return out

    def _splitter(self, text: str):
        if self.latin is not None:
            try:
                text.encode("latin-1")
                return self.latin
            except UnicodeEncodeError:
                pass
        return self.pattern

    def _runs(self, text: str) -> Iterator[list[str]]:
        """The words of a very long text, a bounded number at a time."""
        words = (m.group() for m in self._splitter(text).finditer(text))
        while run := list(islice(words, WORDS_AT_ONCE)):
            yield run

    def _ids(self, split: list[list[str]]) -> list[bytes]:
        """The ids of each list of words."""
        missing = set(filterfalse(self.kept.__contains__, chain.from_iterable(split)))
        if missing and len(self.kept) + len(missing) > KEPT_WORDS:
            self._thin()
            missing = set(filterfalse(self.kept.__contains__, chain.from_iterable(split)))
        self._learn(list(missing))
        found = self.kept.__getitem__
        out = [b"".join(map(found, words)) for words in split]
        for w in missing:
            if len(w) > STRIDE:
                del self.kept[w]
        return out

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        long = [i for i, b in enumerate(raw) if len(b) > 2 * STRIDE]
        plain = [i for i, b in enumerate(raw) if len(b) <= 2 * STRIDE]
        for i, ids in zip(plain, self._contracted([raw[i] for i in plain])):
            self.kept[words[i]] = ids
        for i, ids in zip(long, self._joined([raw[i] for i in long])):
            self.kept[words[i]] = ids

    def _contracted(self, words: list[bytes]) -> Iterator[bytes]:
        """The ids of each word, by the recursive query."""
        lo = 0
        while lo < len(words):
            hi, states = lo, 0
            while hi < len(words) and (hi == lo or states < STATES_AT_ONCE):
                states += len(words[hi]) * (len(words[hi]) + 1) // 2
                hi += 1
            part = words[lo:hi]
            starts = np.cumsum([0, *map(len, part)], dtype=np.int32)
            toks = pa.ListArray.from_arrays(pa.array(starts), pa.array(self.of_byte[np.frombuffer(b"".join(part), np.uint8)]))
            self._put("words", pa.table({"w": pa.array(range(len(part)), pa.int32()), "toks": toks}))
            got = self.db.sql(_RECURSIVE).to_arrow_table()["toks"].combine_chunks()
            ends = 4 * got.offsets.to_numpy()
            data = got.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            for a, b in zip(ends, ends[1:]):
                yield data[a:b]
            lo = hi

    def _joined(self, words: list[bytes]) -> list[bytes]:
        """The ids of long words, from overlapping pieces: piece ``k`` reaches from its start to that of the next but one."""
        starts = [list(range(0, max(1, len(w) - STRIDE), STRIDE)) for w in words]
        known: list[dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]] = [{} for _ in words]
        out: list[bytes | None] = [None] * len(words)
        while True:
            wanted = []
            for n, w in enumerate(words):
                if out[n] is None:
                    ends = [*starts[n][2:], len(w), len(w)][: len(starts[n])]
                    spans = list(zip(starts[n], ends))
                    known[n] = {s: known[n][s] for s in spans if s in known[n]}
                    wanted += [(n, s) for s in spans if s not in known[n]]
            for (n, (a, b)), ids in zip(wanted, self._contracted([words[n][a:b] for n, (a, b) in wanted])):
                toks = np.frombuffer(ids, "<u4")
                known[n][a, b] = toks, a + np.cumsum([0, *self.length[toks]])[:-1]
            for n in range(len(words)):
                if out[n] is None:
                    out[n], starts[n] = _stitched([known[n][s] for s in sorted(known[n])], starts[n])
            if all(x is not None for x in out):
                return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each row of ids (little-endian unsigned 32-bit integers) stands for."""
        step = 4 * IDS_AT_ONCE
        parts = [(d, x[at : at + step]) for d, x in enumerate(ids) for at in range(0, len(x), step)]
        out: list[list[bytes]] = [[] for _ in ids]
        lo = 0
        while lo < len(parts):
            hi, size = lo, 0
            while hi < len(parts) and (hi == lo or size + len(parts[hi][1]) <= step):
                size += len(parts[hi][1])
                hi += 1
            self._put("docs", pa.table({"d": pa.array(range(lo, hi), pa.int32()), "ids": _id_lists([x for _, x in parts[lo:hi]])}))
            got = self.db.sql(_DECODE).to_arrow_table()
            for part, b in sorted(zip(got["d"].to_pylist(), got["bytes"].to_pylist())):
                out[parts[part][0]].append(b)
            lo = hi
        return [b"".join(x) for x in out]

    def _thin(self) -> None:
        if len(self.kept) > STAYING_WORDS:
            self.kept = dict(islice(self.kept.items(), STAYING_WORDS))

    def rest(self) -> None:
        """Between tasks only the tables of the vocabulary and frequent words are held."""
        self._thin()
        for name in ("words", "docs"):
            self.db.execute(f"DROP TABLE IF EXISTS {name}")
        give_back()


def _stitched(pieces: list[tuple[np.ndarray, np.ndarray]], starts: list[int]) -> tuple[bytes | None, list[int]]:
    """The tokens of neighbouring pieces (ids and places) joined where they agree; where they do not, none, and every other such start left out."""
    parts, since, drop = [], 0, []
    for k, (ids, at) in enumerate(pieces):
        until = len(ids)
        if k + 1 < len(pieces):
            next_ids, next_at = pieces[k + 1]
            # tokens of both, keyed by place and id; the first that both hold at or after the cut so far
            mine = at[since:].astype(np.int64) << 24 | ids[since:]
            both = np.intersect1d(mine, next_at.astype(np.int64) << 24 | next_ids, assume_unique=True)
            if len(both):
                until = since + int(np.searchsorted(mine, both[0]))
                following = int(np.searchsorted(next_at, both[0] >> 24))
            else:
                if not drop or drop[-1] != k:
                    drop.append(k + 1)
                until = following = 0
        parts.append(ids[since:until])
        since = following if k + 1 < len(pieces) else 0
    if drop:
        return None, [s for k, s in enumerate(starts) if k not in set(drop)]
    return np.concatenate(parts).astype("<u4").tobytes(), starts


_WORKER: dict[bytes, DuckBpe] = {}


def _coder(tokens: list[bytes], pattern: str) -> DuckBpe:
    """One coder for each vocabulary in a Python worker, which serves many tasks."""
    key = hashlib.sha256(pattern.encode() + b"\0".join(tokens)).digest()
    if key not in _WORKER:
        _WORKER[key] = DuckBpe(tokens, pattern)
    return _WORKER[key]


def _per_batch(df: DataFrame, path: str, pattern: str, columns: dict[str, pa.DataType], schema: str, work) -> DataFrame:
    """Appends ``columns``, computed from each Arrow batch by ``work(coder, batch)``. The vocabulary is read on the driver."""
    short_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, pattern)
        try:
            for batch in batches:
                if batch.num_rows:
                    made = work(coder, batch)
                    arrays = [*(batch.column(n) for n in batch.schema.names if n not in columns), *(made[n] if isinstance(made[n], pa.Array) else pa.array(made[n], t) for n, t in columns.items())]
                    yield pa.RecordBatch.from_arrays(arrays, [*(n for n in batch.schema.names if n not in columns), *columns])
        finally:
            coder.rest()

    left = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in columns)
    return df.mapInArrow(run, f"{left}, {schema}" if left else schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``, the array of token ids of the whole text (null and empty texts: no ids).

    An existing column of that name is replaced; all other columns and all rows stay.
    """

    def work(coder: DuckBpe, batch: pa.RecordBatch) -> dict:
        got = coder.encode(batch.column(text).to_pylist())
        return {out: _id_lists(got)}

    return _per_batch(df, path, pattern, {out: pa.list_(pa.int32())}, f"`{out}` array<int>", work)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """Adds ``out``, the bytes that the ids stand for (null and empty ids: no bytes)."""

    def work(coder: DuckBpe, batch: pa.RecordBatch) -> dict:
        got = [np.array(x or [], "<u4").tobytes() for x in batch.column(ids).to_pylist()]
        return {out: coder.decode(got)}

    return _per_batch(df, path, pattern, {out: pa.binary()}, f"`{out}` binary", work)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encoded, and decoded from the ids alone, in one pass."""

    def work(coder: DuckBpe, batch: pa.RecordBatch) -> dict:
        ids = coder.encode(batch.column(text).to_pylist())
        back = coder.decode(ids)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        return {"n_tokens": [len(x) // 4 for x in ids], "ids_sha256": list(map(digest, ids)), "decoded_sha256": list(map(digest, back))}

    columns = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _per_batch(df, path, pattern, columns, "n_tokens long, ids_sha256 string, decoded_sha256 string", work)


def round_trip_report(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """The fixed result of the registered query."""
    return round_trip(df.select("doc_id", F.col("text")), path, pattern).drop("text")


def tokenised(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The rows with ``ids`` instead of the text, plus ``n_tokens`` and ``decoded_sha256`` of the text that the ids decode to.

    Null and empty texts have no ids. Columns of those names are replaced, others passed on.
    """

    def work(coder: DuckBpe, batch: pa.RecordBatch) -> dict:
        ids = coder.encode(batch.column(text).to_pylist())
        back = coder.decode(ids)
        return {"n_tokens": [len(x) // 4 for x in ids], "ids": _id_lists(ids), "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back]}

    columns = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded_sha256": pa.string()}
    return _per_batch(df, path, pattern, columns, "n_tokens long, ids array<int>, decoded_sha256 string", work).drop(text)


def _id_lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))

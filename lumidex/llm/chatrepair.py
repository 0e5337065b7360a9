"""Repair of conversations to ``(s?(ua)+)?``: an optional system turn, then user and assistant in turns, at the least cost.

Edits: a row is kept (0), gets the role user or assistant (1) or is deleted (2), and an empty turn of
the user or assistant is inserted anywhere (5). Blank rows and such as repeat role and text of an
earlier one have to be deleted; a truncated row that is not deleted costs 5 more.

The grammar has four states: at the start, after the system turn, after a user's, after an
assistant's. For each row a word holds cost layers in the manner of Wu and Manber: layer ``k`` is
the bit set of the states from which the rows from here on can be repaired for ``k`` more than the
base cost. An edit moves all states and layers of the word at once by shifts. States differ in cost by at most
``SPREAD``, since insertions lead from any to any other, so layers below the first that holds a state are dropped, which
raises the base, those from ``SPREAD`` on hold all states, and a word has a few layers at any length. The first layer
that holds the start state gives the cost; the trace through the words takes at each turn the first
in ASCII order of the edits that stay on that cost, which gives the least audit.

A conversation's rows are sorted into one task, as its turns are repaired in order. Their facts come first, a byte for
each, then their texts, which stream past: so a task holds some bytes for each row of one conversation, and no texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumidex.llm.common import id_back, id_key, short_batches

#: The grammar: states 0 to 3, the state that a role's initial leads to, and where a conversation may end.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Most that two states differ in cost: from the start, the system turn, and from there two insertions.
SPREAD = 12
LAYERS = SPREAD + DELETE + 2
_INITIALS = "sua"
_FULL = (1 << 4 * LAYERS) - 1
_FROM = {c: sum(1 << s for s in range(4) if c in NEXT[s]) for c in _INITIALS}
_TO = {"s": 1, "u": 2, "a": 3}
_ONES = sum(1 << 4 * k for k in range(LAYERS))
#: Rows in one batch of results, and characters of its texts.
OUT_ROWS, OUT_CHARS = 500, 1 << 21
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
_SPACE = r"[^\x20\x09-\x0D]"


def _led(word: int, initial: str) -> int:
    """All states and layers from which a turn with the initial leads into the word's."""
    return (word >> _TO[initial] & _ONES) * _FROM[initial]


def _inserted(word: int) -> int:
    for _ in range(2):
        word |= (_led(word, "u") | _led(word, "a")) << 4 * INSERT & _FULL
    return word


def _settled(word: int) -> tuple[int, int]:
    """The word from its first layer that holds a state on, with what the base rises by."""
    rise = 0
    while not word & 15:
        word >>= 4
        rise += 1
    return word | _FULL & ~((1 << 4 * SPREAD) - 1), rise


def last_word() -> int:
    """The word after the last row."""
    return _settled(_inserted(_ONES * sum(1 << s for s in FINAL)))[0]


@lru_cache(maxsize=1 << 16)
def before(word: int, kind: int) -> tuple[int, int]:
    """The word before a row, from that after it, with the rise of the base. ``kind`` is the row's initial and four times its fault."""
    initial, fault = kind % 4, kind // 4
    out = word << 4 * DELETE
    if fault in (FINE, TRUNCATED):
        more = CUT if fault == TRUNCATED else 0
        out |= (_led(word, "u") | _led(word, "a")) << 4 * (REROLE + more)
        if initial < 3:
            out |= _led(word, _INITIALS[initial]) << 4 * (KEEP + more)
    return _settled(_inserted(out & _FULL))


def _layer(word: int, state: int) -> int:
    """The first layer that holds the state."""
    at = word >> state & _ONES
    return ((at & -at).bit_length() - 1) // 4


@lru_cache(maxsize=1 << 16)
def trace(word: int, kind: int, state: int) -> tuple[str, int]:
    """The edits at a row, insertions before it included, that stay on the least cost, first in ASCII order; and the state after them."""
    here, rise = before(word, kind)
    initial, fault = kind % 4, kind // 4
    more = CUT if fault == TRUNCATED else 0
    audit = ""
    while True:
        cost = rise + _layer(here, state)
        if cost == DELETE + _layer(word, state):
            return audit + "D", state
        role = _wanted(state)
        if _layer(here, state) == INSERT + _layer(here, _TO[role]):
            audit, state = audit + "I", _TO[role]
            continue
        kept = NEXT[state].get(_INITIALS[initial]) if initial < 3 else None
        if kept is not None and cost == KEEP + more + _layer(word, kept):
            return audit + "K", kept
        return audit + "R", _TO[role]


def _wanted(state: int) -> str:
    """The initial that an inserted turn or a new role has in a state."""
    return "a" if state == 2 else "u"


def repair(kinds: bytes) -> tuple[int, str]:
    """Cost and audit of a conversation's rows."""
    word, base, words = last_word(), 0, []
    for kind in reversed(kinds):
        words.append(word)
        word, rise = before(word, kind)
        base += rise
    state, audit = 0, []
    for kind in kinds:
        edits, after = trace(words.pop(), kind, state)
        audit.append(edits)
        state = after
    cost = base + _layer(word, 0)
    while state not in FINAL:
        audit.append("I")
        state = _TO[_wanted(state)]
    return cost, "".join(audit)


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, dropped`` of the rows after damage told by a checksum of id and turn: dropped, emptied, without marks, repeated, or the user's.

    A null counts as one space, in the checksum, the role and the text. Dropped rows are marked, so that their conversation stays known.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said(conv), F.lit(":"), said(turn)).cast("binary")) % 20
    told = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"), fate.alias("fate"))
    broken = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = told.select("conv", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), broken.alias("text"), (F.col("fate") == 0).alias("dropped"), F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return rows.drop("_copy")


def _ordered(df: DataFrame, conv: str, turn: str, role: str, text: str, dropped: Column) -> DataFrame:
    """Each conversation in one partition: first the facts of its rows in order (phase 0), then their texts in the same order (phase 1)."""
    said = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = df.select(id_key(df, conv).alias("key"), F.col(turn).cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"), dropped.alias("dropped"))
    rows = rows.withColumn("tie", F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)))
    solid = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    blank = ~F.col("text").rlike(_SPACE)
    initial = F.when(F.startswith("role", F.lit("s")), 0).when(F.startswith("role", F.lit("u")), 1).when(F.startswith("role", F.lit("a")), 2).otherwise(3)
    fault = F.when(blank, BLANK).when(~F.substring(solid, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    facts = rows.select("key", "turn", "role", "tie", "dropped", initial.alias("initial"), fault.alias("fault"))
    # blank rows are no duplicates: they need not meet
    apart = F.when(F.col("dropped") | (F.col("fault") == BLANK), F.monotonically_increasing_id())
    again = F.row_number().over(Window.partitionBy("key", "tie", "apart").orderBy("turn")) > 1
    facts = facts.withColumn("apart", apart).withColumn("fault", F.when(F.col("apart").isNull() & again, DUPLICATE).otherwise(F.col("fault")))
    kind = F.when(F.col("dropped"), -1).otherwise(F.col("initial") + 4 * F.col("fault")).cast("int")
    none = F.lit(None)
    facts = facts.select("key", F.lit(0).alias("phase"), "turn", F.when(~F.col("dropped"), F.col("role")).alias("role"), "tie", kind.alias("kind"), none.cast("string").alias("text"))
    texts = rows.where("NOT dropped").select("key", F.lit(1).alias("phase"), "turn", "role", "tie", none.cast("int").alias("kind"), "text")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return facts.unionByName(texts).repartition(parts, "key").sortWithinPartitions("key", "phase", "turn", "role", "tie")


class _Conversation:
    """One conversation as its rows stream past."""

    def __init__(self, key: int | str):
        self.key, self.kinds, self.turns = key, bytearray(), (None, None, 0)
        self.audit, self.at, self.state, self.place = None, 0, 0, 0

    def fact(self, turn: int | None, kind: int) -> None:
        if kind < 0:
            return
        self.kinds.append(kind)
        first, last, distinct = self.turns
        if turn is not None and turn != last:
            self.turns = (turn if first is None else first, turn, distinct + 1)

    def head(self) -> dict:
        """The conversation's own row, before its turns."""
        kinds, (first, last, distinct) = bytes(self.kinds), self.turns
        cost, self.audit = repair(kinds)
        faults = [sum(kinds.count(i + 4 * f) for i in range(4)) for f in range(4)]
        fine = {(0, 1), (1, 2), (2, 1)}
        illegal = sum((a % 4, b % 4) not in fine for a, b in zip(kinds, kinds[1:]))
        gaps = 0 if first is None else last - first + 1 - distinct
        return {"key": self.key, "place": 0, "gaps": gaps, "blank": faults[BLANK], "duplicate": faults[DUPLICATE], "truncated": faults[TRUNCATED], "illegal": illegal, "cost": cost, "audit": self.audit}

    def _turn(self, edit: str, role: str, text: str) -> dict:
        self.place += 1
        self.state = NEXT[self.state][role[0]]
        return {"key": self.key, "place": self.place, "edit": edit, "role": role, "text": text}

    def inserted(self) -> Iterator[dict]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._turn("I", ROLES[_wanted(self.state)], "")

    def row(self, role: str, text: str) -> Iterator[dict]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._turn(edit, role if edit == "K" else ROLES[_wanted(self.state)], text)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    now = None
    for batch in batches:
        for key, phase, turn, role, kind, text in zip(*(batch.column(c).to_pylist() for c in ("key", "phase", "turn", "role", "kind", "text"))):
            if now is None or now.key != key:
                yield from _ended(now)
                now = _Conversation(key)
            if phase == 0:
                now.fact(turn, kind)
            else:
                if now.audit is None:
                    yield now.head()
                yield from now.row(role, text)
    yield from _ended(now)


def _ended(now: _Conversation | None) -> Iterator[dict]:
    if now is not None:
        if now.audit is None:
            yield now.head()
        yield from now.inserted()


def _in_batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row.get("text") or "") + len(row.get("audit") or "")
        if len(held) >= OUT_ROWS or chars >= OUT_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


_FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", dropped: Column | None = None) -> DataFrame:
    """Every conversation repaired: a row of facts (``place`` 0: ``gaps, blank, duplicate, truncated, illegal, cost, audit``), then its turns (``place`` from 1: ``edit, role, text``).

    ``key`` stands for the conversation's id; a conversation's rows follow each other in one
    partition. Rows go by turn, a null turn first, then by role and the text's digest; rows that
    are equal count each. A null id is one conversation, a null role or text one space. Rows for
    which ``dropped`` holds only make their conversation known: one that has no others has zeros,
    an empty audit and no turns. An empty table gives no rows; other columns are not read.
    """
    short_batches(df.sparkSession)
    rows = _ordered(df, conv, turn, role, text, F.lit(False) if dropped is None else dropped)
    kinds = {"key": dict(rows.dtypes)["key"], "place": "bigint", "edit": "string", "role": "string", "text": "string", **dict.fromkeys(_FACTS, "bigint"), "audit": "string"}
    schema = pa.schema([(c, _arrow(k)) for c, k in kinds.items()])
    return rows.mapInArrow(lambda batches: _in_batches(_repaired(batches), schema), ", ".join(f"{c} {k}" for c, k in kinds.items()))


def with_digests(repaired: DataFrame) -> DataFrame:
    """``key``, the facts and ``repaired_sha256``, the digest of a conversation's ``role:text``, joined by line ends: its turns stream past in order."""
    kinds = {"key": dict(repaired.dtypes)["key"], **dict.fromkeys(_FACTS, "bigint"), "audit": "string", "repaired_sha256": "string"}
    schema = pa.schema([(c, _arrow(k)) for c, k in kinds.items()])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        head, digest = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["place"] == 0:
                    if head is not None:
                        yield head | {"repaired_sha256": digest.hexdigest()}
                    head, digest = {c: row[c] for c in ("key", *_FACTS, "audit")}, hashlib.sha256()
                else:
                    digest.update(("\n" * (row["place"] > 1) + f"{row['role']}:{row['text']}").encode("utf-8", "surrogatepass"))
        if head is not None:
            yield head | {"repaired_sha256": digest.hexdigest()}

    return repaired.mapInArrow(lambda batches: _in_batches(digested(batches), schema), ", ".join(f"{c} {k}" for c, k in kinds.items()))


def repair_report(df: DataFrame) -> DataFrame:
    """The fixed result of the registered query: conversations damaged, then repaired."""
    found = with_digests(repair_conversations(damaged(df), "conv", dropped=F.col("dropped")))
    return found.select(id_back(damaged(df), "conv", "key").alias("conv_id"), *_FACTS, "audit", "repaired_sha256")

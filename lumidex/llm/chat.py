"""Chat formatting of logged conversations, after snapshots that a longer log contains are collapsed.

Every prefix of a conversation's turns has a rolling digest: the digest of the prefix before it,
the role and the text. A conversation is a snapshot of a longer one if its whole digest is among
the digests of proper prefixes; an anti-join leaves the maximal ones. Of equal conversations the
one with the least id stays. Both sides of the anti-join are distinct before they meet, so a
first turn or a conversation that many logs share is one row.

A turn without a conversation's id is a conversation by itself, so these are no group. Turns are shuffled once,
by conversation; digests, anti-join and rendering read that same exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumidex.llm.common import id_back, id_key, states_before

#: How a turn is written. Where a text or role holds what begins a mark, it gets one more backslash, so that no text can write a mark.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_BEGUN = r"<(\\*)\|im_"
NO_ROLE = "user"


def _turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``key, alone, turns``: one conversation's turns in order; repeated rows once, ties by role and text. ``alone`` names turns without an id."""
    role_, text_ = F.coalesce(F.col(role), F.lit(NO_ROLE)), F.coalesce(F.col(text), F.lit(""))
    alone = F.when(F.col(conv).isNull(), F.md5(F.concat_ws("|", F.coalesce(F.col(turn).cast("string"), F.lit("-")), F.length(role_), role_, text_))).otherwise("")
    row = F.struct(F.col(turn).alias("turn"), role_.alias("role"), text_.alias("text"))
    return df.groupBy(id_key(df, conv).alias("key"), alone.alias("alone")).agg(F.sort_array(F.collect_set(row)).alias("turns"))


def _digests(turns: Column) -> Column:
    """The rolling digest of each prefix, shortest first."""
    step = lambda last, t: F.md5(F.concat(last, F.lit("\x1f"), F.length(t["role"]).cast("string"), F.lit("\x1f"), t["role"], t["text"]))
    # the digest before one turn more than there are is that of the whole
    return F.slice(states_before(F.concat(turns, F.slice(turns, 1, 1)), F.lit(""), step, "string"), 2, F.size(turns))


def _maximal(turns: DataFrame) -> DataFrame:
    """``key, alone`` of the conversations that are no snapshot and no later copy of another."""
    hashed = turns.select("key", "alone", _digests(F.col("turns")).alias("digests"))
    whole = hashed.groupBy(F.size("digests").alias("n"), F.element_at("digests", -1).alias("digest")).agg(F.min(F.struct("key", "alone")).alias("least"))
    parts = hashed.select(F.posexplode(F.slice("digests", 1, F.size("digests") - 1)).alias("n", "digest")).select((F.col("n") + 1).alias("n"), "digest").distinct()
    return whole.join(parts, ["n", "digest"], "left_anti").select("least.key", "least.alone")


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, n_turns, text`` of each maximal conversation, written turn by turn.

    Turns go by number, a null number first; a null role is a user's, a null text empty. Rows that
    repeat all four columns count once; a row with a null id is a conversation of one turn. Marks
    inside a text or role are written with a backslash after ``<`` (one more, if there are some), a
    line's end in a role as a space. An empty table gives no rows; other columns are not read.
    """
    turns = _turns(df, conv, turn, role, text)
    mine = turns.join(_maximal(turns), ["key", "alone"], "left_semi")
    plain = lambda x: F.regexp_replace(x, _BEGUN, r"<$1\\|im_")
    line = lambda t: F.concat(F.lit(OPEN), F.translate(plain(t["role"]), "\n", " "), F.lit("\n"), plain(t["text"]), F.lit(CLOSE), F.lit("\n"))
    return mine.select(id_back(df, conv, "key").alias("conv"), F.size("turns").alias("n_turns"), F.array_join(F.transform("turns", line), "").alias("text"))


def chat_report(df: DataFrame) -> DataFrame:
    """The result of the registered query."""
    return format_chats(df).withColumnRenamed("conv", "conv_id")


def chat_sql() -> str:
    """The same over the view ``conversations``, as DuckDB SQL that compares the turns themselves."""
    plain = lambda x: f"regexp_replace({x}, '<(\\\\*)\\|im_', '<\\1\\\\|im_', 'g')"
    return f"""
WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, '{NO_ROLE}') AS role, coalesce(text, '') AS text FROM conversations),
logs AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS said FROM turns WHERE conv_id IS NOT NULL GROUP BY conv_id
         UNION ALL SELECT NULL, [{{'role': role, 'text': text}}] FROM (SELECT DISTINCT role, text FROM turns WHERE conv_id IS NULL))
SELECT conv_id, len(said)::INTEGER AS n_turns,
       list_reduce(list_transform(said, lambda t: '{OPEN}' || translate({plain("t.role")}, chr(10), ' ') || chr(10) || {plain("t.text")} || '{CLOSE}' || chr(10)), lambda a, b: a || b) AS text
FROM logs x
WHERE NOT EXISTS (SELECT 1 FROM logs y WHERE len(y.said) > len(x.said) AND y.said[1] = x.said[1] AND y.said[1:len(x.said)] = x.said)
  AND NOT EXISTS (SELECT 1 FROM logs y WHERE y.said = x.said AND (y.conv_id < x.conv_id OR y.conv_id IS NULL AND x.conv_id IS NOT NULL))
"""

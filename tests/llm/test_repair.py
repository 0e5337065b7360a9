import hashlib
import random
import re
import zlib
from collections import Counter

import brute
import oracle
from pyspark.sql import functions as F

from lumidex.llm import chatrepair, queries

COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
ORDER = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    """``(conv, turn, role, text)`` after damage, and all ids."""
    out = []
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        role, text = said(role), said(text)
        fate = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out, {r[0] for r in rows}


def faults(rows):
    """The first fault of each ``(role, text)``."""
    seen, out = set(), []
    for role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_repairs(rows, found, most):
    """Every audit up to a cost with the turns that it leaves: ``cost, audit, turns``."""
    out = []

    def go(i, cost, audit, turns):
        if cost > most:
            return
        if i == len(rows):
            out.append((cost, audit, tuple(turns)))
        for role in ("user", "assistant"):
            go(i, cost + 5, audit + "I", [*turns, (role, "")])
        if i < len(rows):
            go(i + 1, cost + 2, audit + "D", turns)
            if found[i] in ("", "truncated"):
                more = 5 if found[i] else 0
                go(i + 1, cost + more, audit + "K", [*turns, rows[i]])
                for role in ("user", "assistant"):
                    go(i + 1, cost + 1 + more, audit + "R", [*turns, (role, rows[i][1])])

    go(0, 0, "", [])
    return [x for x in out if ORDER.fullmatch("".join(r[:1] or "-" for r, _ in x[2]))]


def least_repair(rows, found):
    """The same by a table of the least ``(cost, audit, turns)`` of each grammar state, row by row."""
    follow = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]

    def insertions(best):
        for _ in range(2):
            for s, (cost, audit, turns) in list(best.items()):
                role = "assistant" if s == 2 else "user"
                new = (cost + 5, audit + "I", turns + ((role, ""),))
                to = follow[s][role[0]]
                if to not in best or new < best[to]:
                    best[to] = new
        return best

    best = {0: (0, "", ())}
    for row, fault in zip(rows, found):
        # an insertion may stand before any edit, so that states after insertions go on as well
        after = {}
        for s, (cost, audit, turns) in insertions(dict(best)).items():
            options = [(s, (cost + 2, audit + "D", turns))]
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                if row[0][:1] in follow[s]:
                    options.append((follow[s][row[0][0]], (cost + more, audit + "K", turns + (row,))))
                role = "assistant" if s == 2 else "user"
                options.append((follow[s][role[0]], (cost + 1 + more, audit + "R", turns + ((role, row[1]),))))
            for to, new in options:
                if to not in after or new < after[to]:
                    after[to] = new
        best = after
    return min(v for s, v in insertions(best).items() if s in (0, 3))


def plain_report(rows, repair=least_repair):
    damaged, ids = plain_damage(rows)
    out = {}
    for conv in ids:
        mine = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).digest()))
        said = [(r[2], r[3]) for r in mine]
        found = faults(said)
        turns = {r[1] for r in mine if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[:1] for r, _ in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, left = repair(said, found)
        count = Counter(found)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest)
    return out


def reported(spark, rows, schema="conv_id long, turn long, role string, text string"):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in chatrepair.repair_report(spark.createDataFrame(rows, schema)).collect()}


def test_layers_against_all_edits():
    rng = random.Random(1)
    for _ in range(300):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b", "", "c!"])) for _ in range(rng.randrange(5))]
        found = faults(rows)
        kinds = bytes("sua".find(r[:1] or "-") % 4 + 4 * ["", "truncated", "blank", "duplicate"].index(f) for (r, _), f in zip(rows, found))
        cost, audit = chatrepair.repair(kinds)
        best = min((c, a) for c, a, _ in all_repairs(rows, found, 2 * len(rows)))
        assert (cost, audit) == best == least_repair(rows, found)[:2], (rows, found)


def test_layers_on_long_conversations():
    rng = random.Random(2)
    for n in (50, 400, 3000):
        rows = [(rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", f"{i}.", f"{i}", ""])) for i in range(n)]
        found = faults(rows)
        kinds = bytes("sua".find(r[:1]) + 4 * ["", "truncated", "blank", "duplicate"].index(f) for (r, _), f in zip(rows, found))
        assert chatrepair.repair(kinds) == least_repair(rows, found)[:2]


def test_table_against_plain_version(spark):
    df = spark.read.parquet(f"{oracle.DATA}/conversations.parquet")
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.op11_repair(spark, oracle.DATA).collect()}
    assert got == plain_report([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


def test_awkward_conversations(spark):
    rng = random.Random(3)
    rows = [(None, None, None, None), (None, 1, "user", "hi."), (None, None, "", ""), (7, 3, "user", "same."), (7, 3, "user", "same."), (7, 3, "assistant", "tie?"), (7, 2**60, "assistant", "\u00a0"), (8, None, "user", "x" * 200_000 + "."), (-(2**62), -5, "User", "é!")]
    rows += [(rng.randrange(9, 15), rng.choice([None, *range(8)]), rng.choice([None, "user", "assistant", "system", "tool"]), rng.choice([None, "", "so.", "then", "  \n", "what? \t"])) for _ in range(150)]
    assert reported(spark, rows) == plain_report(rows)
    clash = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS key", "2 AS KIND", "3 AS phase", "4 AS tie", "5 AS dropped", "6 AS conv", "7 AS fate", "8 AS apart")
    assert {r.conv_id: r.audit for r in chatrepair.repair_report(clash).collect()} == {k: v[6] for k, v in plain_report(rows).items()}
    assert reported(spark, []) == {}
    named = [("a", 1, "user", "hi."), ("a", 2, "assistant", "yes."), (None, 1, "user", "hm"), ("", 1, "user", "hm")]
    assert reported(spark, named, "conv_id string, turn int, role string, text string") == plain_report(named)


def test_conversations_whose_rows_are_all_dropped(spark):
    lost = [c for c in range(200) if zlib.crc32(f"{c}:1".encode()) % 20 == 0]
    got = reported(spark, [(c, 1, "user", "hi.") for c in lost])
    assert lost and got == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in lost}


def test_repaired_turns(spark):
    """The operator itself gives the turns, and leaves an undamaged conversation alone."""
    df = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "assistant", "b."), (2, 0, "assistant", "c."), (2, 5, "assistant", "c.")], brute_schema())
    rows = sorted((r.key, r.place, r.edit, r.role, r.text) for r in chatrepair.repair_conversations(df).where("place > 0").collect())
    assert rows == [(1, 1, "K", "user", "a."), (1, 2, "K", "assistant", "b.")]
    facts = {r.key: (r.gaps, r.duplicate, r.cost, r.audit) for r in chatrepair.repair_conversations(df).where("place = 0").collect()}
    assert facts == {1: (0, 0, 0, "KK"), 2: (4, 1, 4, "DD")}


def brute_schema():
    return "conv_id long, turn long, role string, text string"

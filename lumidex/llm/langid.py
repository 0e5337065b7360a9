"""Language identification with a bidirectional gated recurrent network over bytes, in numpy.

In each direction a gated recurrent unit runs over a text's UTF-8 bytes: ``z = s(A_z[byte] + h U_z)``,
``r = s(A_r[byte] + h U_r)``, ``c = tanh(A_c[byte] + (r h) U_c)``, ``h += z (c - h)``. The two states
of a position give a distribution over the languages; the mean over all positions is the
document's distribution. Every byte of a text is read, and each state follows from all bytes before it.

Texts are cut into windows that run side by side, first from a state of zero. Then each
window starts again from the last state of the one before it, and goes on until its states are those that it had; where they differ up to its
end, the next window starts once more. So the states are those of a run from end to end, within ``NEAR``, for texts of any length, while
few steps are done twice, as a unit forgets. Of texts too long to be held a strip is done at once, with ``OVER`` windows on
either side.

The network is trained by backpropagation through time, with every position labelled by its document's language,
on at most ``docs_per_lang`` labelled documents of each language. Of their whole texts, cut into pieces, at most ``PIECES_PER_LANG``
are drawn, each as likely as any other, so that the fit costs the same at any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumidex.llm.common import give_back, short_batches, unused, without

WINDOW = 512
#: Steps after which a window that starts again is compared with what it was, and how near states are equal.
CHECKED = 32
NEAR = 1e-3
#: Windows on either side of a strip of a very long text.
OVER = 8
HIDDEN = 8
#: Labelled documents that the fit reads at most: of each language, and of all together (but one of each language at least).
DOCS_PER_LANG = 400
DOCS = 40_000
#: Pieces of their texts that it draws at most, likewise, characters of a piece, and bytes of a window in training.
PIECES_PER_LANG = 5_000
PIECES = 100_000
PIECE_CHARS = 256
TRAIN_WINDOW = 64
#: Languages up to which their table (under 100 bytes a row) is broadcast; more are joined by a shuffle, with the same result.
BROADCAST_LANGS = 10_000
#: Times the wanted documents that are ranked.
MARGIN = 8
#: Numbers that the states or the probabilities of the windows that run side by side take at most.
NUMBERS = 12_000_000
UNKNOWN = "und"


@dataclass
class Network:
    langs: list[str]
    weights: dict[str, np.ndarray]


def pieces_of(texts: list[bytes], window: int = TRAIN_WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Separate windows of bytes (padded with zero), the bytes in each, and the text each is of."""
    counts = np.array([-(-len(t) // window) for t in texts], np.int64)
    block = b"".join(t + b"\0" * (-len(t) % window) for t in texts)
    rows = np.frombuffer(block, np.uint8).reshape(-1, window)
    owner = np.repeat(np.arange(len(texts)), counts)
    filled = np.full(len(rows), window, np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    last = np.cumsum(counts) - 1
    some = counts > 0
    filled[last[some]] = lengths[some] - (counts[some] - 1) * window
    return rows, filled, owner


def _sigmoid_in_place(x: np.ndarray) -> None:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5


def _run(w: dict[str, np.ndarray], side: str, columns: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, list]:
    """States of one direction for training, from zero, in that direction's order of steps: (steps, windows, hidden), and what backpropagation needs of each step.

    Where ``live`` (steps, windows) is false the state stays as it is.
    """
    ag, ac, ug, uc = (w[side + k] for k in ("ag", "ac", "ug", "uc"))
    hidden = ac.shape[1]
    steps, n = columns.shape
    states = np.empty((steps, n, hidden), ac.dtype)
    h = np.zeros((n, hidden), ac.dtype)
    tape = []
    for t in range(steps):
        g = ag[columns[t]] + h @ ug
        _sigmoid_in_place(g)
        z, r = g[:, :hidden], g[:, hidden:]
        c = np.tanh(ac[columns[t]] + (r * h) @ uc)
        tape.append((h, z, r, c))
        np.add(h, (c - h) * z * live[t][:, None], out=states[t])
        h = states[t]
    return states, tape


def _position_probabilities(w: dict[str, np.ndarray], forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """``forward`` and ``backward`` are the states of the same positions, in order of the text."""
    logits = forward @ w["vf"]
    logits += backward @ w["vb"]
    logits += w["b"]
    logits -= logits.max(axis=-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=-1, keepdims=True)
    return logits


@dataclass
class _Direction:
    """One direction's weights as ``_states`` wants them: the gates one after the other with their sign turned, and the candidate's."""

    gates: np.ndarray
    candidate: np.ndarray
    from_state_gates: np.ndarray
    from_state_candidate: np.ndarray


def _direction(w: dict[str, np.ndarray], side: str) -> _Direction:
    halves = lambda x: -np.stack(np.split(x, 2, axis=1))
    return _Direction(halves(w[side + "ag"]), w[side + "ac"], halves(w[side + "ug"]), w[side + "uc"])


def _states(d: _Direction, columns: np.ndarray, live: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """States of one direction, in that direction's order of steps: (steps, windows, hidden).

    In step ``t`` the first ``live[t]`` windows have a byte; the states of the others are zero. ``start``: the states before the first step, else zero.
    Every array of a step is dense, as short strided rows take numpy many times longer, and each gate is ``1 / (1 + exp(-x))`` by which is divided.
    """
    steps, n = columns.shape
    hidden = d.candidate.shape[1]
    states = np.empty((steps, n, hidden), d.candidate.dtype)
    h = np.zeros((n, hidden), d.candidate.dtype) if start is None else start
    rooms = [np.empty(k * n * hidden, d.candidate.dtype) for k in (2, 2, 1, 1)]
    with np.errstate(over="ignore"):  # a gate that is shut: x / inf is 0
        for t in range(steps):
            k = live[t]
            at, before = columns[t, :k].astype(np.intp), h[:k]
            g, u = (x[: 2 * k * hidden].reshape(2, k, hidden) for x in rooms[:2])
            c, m = (x[: k * hidden].reshape(k, hidden) for x in rooms[2:])
            for j in range(2):
                np.take(d.gates[j], at, axis=0, out=g[j], mode="clip")
                np.dot(before, d.from_state_gates[j], out=u[j])
            g += u
            np.exp(g, out=g)
            g += 1
            np.divide(before, g[1], out=m)
            np.dot(m, d.from_state_candidate, out=c)
            np.take(d.candidate, at, axis=0, out=m, mode="clip")
            c += m
            np.tanh(c, out=c)
            c -= before
            c /= g[0]
            np.add(before, c, out=states[t, :k])
            states[t, k:] = 0
            h = states[t]
    return states


def _carried(d: _Direction, columns: np.ndarray, live: np.ndarray, after: np.ndarray) -> np.ndarray:
    """States of one direction as ``_states`` gives them, each window begun with the last state of the one before it: ``after`` names the next window, -1 if there is none."""
    states = _states(d, columns, live)
    ends = np.flatnonzero(after >= 0)
    while len(ends):  # windows whose last state is news to the next one
        ends = ends[np.argsort(after[ends])]
        at, h = after[ends], states[-1][ends]
        for t in range(0, len(columns), CHECKED):
            until = min(t + CHECKED, len(columns))
            again = _states(d, columns[t:until, at], np.searchsorted(at, live[t:until]), start=h)
            moved = np.abs(again[-1] - states[until - 1, at]).max(axis=1) > NEAR
            states[t:until, at] = again
            at, h = at[moved], again[-1][moved]
            if not len(at):
                break
        ends = at[after[at] >= 0]
    return states


def _sums(w: dict[str, np.ndarray], forward: np.ndarray, backward: np.ndarray, live: np.ndarray, counts: np.ndarray | None) -> np.ndarray:
    """Each window's distributions of its positions added up, (windows, languages): of all, or of the steps from ``counts[0]`` up to ``counts[1]``.

    Languages come first while they are added up: a maximum or a sum over the few languages of one position is slow.
    """
    sums = np.zeros((len(w["b"]), forward.shape[1]))
    for t in range(len(forward)):
        k = live[t]
        logits = forward[t, :k] @ w["vf"]
        logits += backward[t, :k] @ w["vb"]
        p = np.add(logits.T, w["b"][:, None], order="C")
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        if counts is not None:
            p *= (counts[0, :k] <= t) & (t < counts[1, :k])
        sums[:, :k] += p
    return sums.T


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """The mean over all positions of each text; zeros for an empty text."""
    total = np.zeros((len(texts), len(net.langs)))
    at_once = max(4 * OVER, NUMBERS // (WINDOW * max(2 * HIDDEN, len(net.langs))))
    # (text, from, to, first and last byte that count): whole texts, or strips of them
    strips = []
    for i, t in enumerate(texts):
        step = (at_once - 2 * OVER) * WINDOW if len(t) > at_once * WINDOW else max(1, len(t))
        strips += [(i, max(0, lo - OVER * WINDOW), min(len(t), lo + step + OVER * WINDOW), lo, min(len(t), lo + step)) for lo in range(0, len(t), step)]
    strips.sort(key=lambda s: s[2] - s[1])
    windows = lambda s: -(-(s[2] - s[1]) // WINDOW)
    while strips:
        part, held = [], 0
        while strips and (not part or held + windows(strips[-1]) <= at_once):
            part.append(strips.pop())
            held += windows(part[-1])
        _add_strips(net, texts, part, total)
    lengths = np.array([max(1, len(t)) for t in texts])
    return total / lengths[:, None]


def _add_strips(net: Network, texts: list[bytes], part: list[tuple[int, int, int, int, int]], total: np.ndarray) -> None:
    """Adds up the distributions of the strips' positions that count; strips are in order of length, the longest first."""
    steps = min(WINDOW, part[0][2] - part[0][1])
    spans = [(k, lo, min(lo + steps, s[2])) for k, s in enumerate(part) for lo in range(s[1], s[2], steps)]
    owner, lo, hi = (np.array([x[j] for x in spans]) for j in range(3))
    # whole windows first, so that those with a byte in a step are always the first ones and no step is done on padding
    order = np.argsort(lo - hi, kind="stable")
    rank = np.empty(len(spans) + 1, np.int64)
    rank[order], rank[-1] = np.arange(len(spans)), -1
    same = np.r_[owner[1:] == owner[:-1], False]
    follows = rank[np.where(same, np.arange(1, len(spans) + 1), -1)][order]
    leads = rank[np.where(np.r_[False, same[:-1]], np.arange(-1, len(spans) - 1), -1)][order]
    owner, lo, hi = owner[order], lo[order], hi[order]
    columns = np.frombuffer(b"".join(texts[part[k][0]][a:b].ljust(steps, b"\0") for k, a, b in zip(owner, lo, hi)), np.uint8).reshape(-1, steps).T
    live = np.searchsorted(lo - hi, -np.arange(steps))
    forward = _carried(_direction(net.weights, "f"), np.ascontiguousarray(columns), live, follows)
    # the padding of a last window comes first backward, and leaves the state at zero
    backward = _carried(_direction(net.weights, "r"), np.ascontiguousarray(columns[::-1]), live[::-1], leads)
    first, last = (np.array([part[k][j] for k in owner]) for j in (3, 4))
    counts = None if (first <= lo).all() and (hi <= last).all() else np.stack([first - lo, last - lo])
    np.add.at(total, [part[k][0] for k in owner], _sums(net.weights, forward, backward[::-1], live, counts))


def train(texts: list[bytes], labels: list[str], steps: int = 400, batch: int = 256, rate: float = 0.02, seed: int = 7) -> Network:
    """Fits by Adam on position labels. No text at all gives a network that knows no language."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    init = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    w = {s + k: init(n, m * HIDDEN) for s in "fr" for k, n, m in (("ag", 256, 2), ("ac", 256, 1), ("ug", HIDDEN, 2), ("uc", HIDDEN, 1))}
    w |= {"vf": init(HIDDEN, len(langs)), "vb": init(HIDDEN, len(langs)), "b": np.zeros(len(langs), np.float32)}
    rows, filled, owner = pieces_of(texts)
    if not len(rows):
        return Network(langs, w)
    target = np.array([langs.index(x) for x in labels])[owner]
    share = np.bincount(target, minlength=len(langs)).astype(float)
    weight = (1 / share)[target] / (1 / share)[target].sum()
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    for step in range(1, steps + 1):
        pick = rng.choice(len(rows), batch, p=weight)
        grads = _gradients(w, rows[pick], filled[pick], target[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1))) * min(1.0, 1 / (norm + 1e-9))
        for k, g in grads.items():
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w[k] -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Network(langs, w)


def _gradients(w: dict[str, np.ndarray], rows: np.ndarray, filled: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    steps = rows.shape[1]
    columns = np.ascontiguousarray(rows.T)
    live = np.arange(steps)[:, None] < filled[None, :]
    # the padding comes after the text; backward it comes first and leaves the state at zero
    runs, lives = {"f": columns, "r": columns[::-1]}, {"f": live, "r": live[::-1]}
    out = {s: _run(w, s, c, lives[s]) for s, c in runs.items()}
    d = _position_probabilities(w, out["f"][0], out["r"][0][::-1])
    d[:, np.arange(len(target)), target] -= 1
    d[~live] = 0
    d /= filled.sum()
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    grads["b"] = d.sum(axis=(0, 1))
    for s, v in (("f", "vf"), ("r", "vb")):
        ds = d if s == "f" else d[::-1]
        states, tape = out[s]
        grads[v] = np.einsum("tbh,tbl->hl", states, ds)
        dh = np.zeros_like(states[0])
        gates, cand = np.empty((*states.shape[:2], 2 * HIDDEN), states.dtype), np.empty_like(states)
        for t in range(steps - 1, -1, -1):
            h, z, r, c = tape[t]
            on = lives[s][t][:, None]
            dh = dh + ds[t] @ w[v].T
            cand[t] = dh * z * (1 - c * c) * on
            dm = cand[t] @ w[s + "uc"].T  # of r h
            gates[t, :, :HIDDEN] = dh * (c - h) * z * (1 - z) * on
            gates[t, :, HIDDEN:] = dm * h * r * (1 - r)
            grads[s + "ug"] += h.T @ gates[t]
            grads[s + "uc"] += (r * h).T @ cand[t]
            dh = dh * (1 - z * on) + dm * r + gates[t] @ w[s + "ug"].T
        np.add.at(grads[s + "ag"], runs[s].ravel(), gates.reshape(-1, 2 * HIDDEN))
        np.add.at(grads[s + "ac"], runs[s].ravel(), cand.reshape(-1, HIDDEN))
    return grads


def in_fold(id_col: str = "doc_id") -> Column:
    """Held out: the checksum of the id, written as text, is divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_pieces(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """``lang, piece``: pieces of at most ``docs_per_lang`` documents of each language outside the fold, and at most ``DOCS`` of all but for one of each.

    Rows with a null id, null or empty text or null language are no examples. From each language's count follows the
    share of its documents that is ranked at all, ``MARGIN`` times what is wanted, so what meets in
    a task does not grow with the input. The chosen texts are cut up whole, and of a language's pieces those with the least hashes
    are drawn, ``PIECES_PER_LANG`` at most. The languages are counted on the driver, which holds an output of the network for each.
    """
    rows = df.where(~in_fold(id_col) & F.col(id_col).isNotNull() & F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(id_col).cast("string").alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.groupBy("lang").count().collect()
    wanted = min(docs_per_lang, max(1, DOCS // max(1, len(counts))))
    shares = df.sparkSession.createDataFrame(pa.table({"lang": pa.array([r["lang"] for r in counts], pa.string()), "share": pa.array([min(1.0, MARGIN * wanted / r["count"]) * 2**30 for r in counts], pa.float64())}))
    shares = F.broadcast(shares) if len(counts) <= BROADCAST_LANGS else shares
    some = rows.join(shares, "lang").where(F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(2**30)) < F.col("share"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    chosen = some.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= wanted)
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE_CHARS).cast("int"))
    each = chosen.select("lang", "key", F.posexplode(F.transform(starts, lambda i: F.substring("text", i * PIECE_CHARS + 1, F.lit(PIECE_CHARS)))).alias("at", "piece"))
    drawn = Window.partitionBy("lang").orderBy(F.xxhash64("key", "at"), "key", "at", "piece")
    pieces = min(PIECES_PER_LANG, max(1, PIECES // max(1, len(counts))))
    return each.withColumn("nth", F.row_number().over(drawn)).where(F.col("nth") <= pieces).select("lang", "piece")


def fit(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> Network:
    """Trains on the bounded sample of ``training_pieces``."""
    rows = sorted((r.lang, r.piece) for r in training_pieces(df, id_col, text, lang, docs_per_lang).collect())
    return train([p.encode("utf-8", "surrogatepass") for _, p in rows], [x for x, _ in rows])


def identify(df: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the document's probability of it) to every row.

    ``und`` with score 0 if the text is null, empty or has no letter, or no language is known.
    Existing columns of those names are replaced.
    """
    rest = without(df, "lang_pred", "score")
    if not net.langs:
        return df.select(*rest, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    short_batches(df.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            for texts in batches:
                p = document_probabilities(net, [(t or "").encode("utf-8", "surrogatepass") for t in texts])
                best = p.argmax(axis=1)
                yield pd.DataFrame({"lang_pred": [net.langs[i] for i in best], "score": np.clip(p[np.arange(len(p)), best], 0, 1)})
        finally:
            give_back()

    letters, found = unused(df, "letters", "found")
    known = df.select(*rest, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(letters))
    known = known.withColumn(found, predict(F.when(F.col(letters), F.col(text))))
    return known.select(
        *rest,
        F.when(F.col(letters), F.col(f"{found}.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col(letters), F.col(f"{found}.score")).otherwise(0.0).alias("score"),
    )


#: Under this probability of the best language a document is rejected; of four languages chance gives 0.25.
LEAST_SCORE = 0.4


def keep_identified(df: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents whose language is told with at least that probability; columns unchanged."""
    marked = identify(df.select(F.struct(*df.columns).alias("row"), "text"), fit(df))
    return marked.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")


def language_report(df: DataFrame) -> DataFrame:
    """The fixed result of the registered query."""
    net = fit(df)
    return identify(df.select("doc_id", "text"), net).select("doc_id", in_fold().alias("held_out"), "lang_pred", "score")

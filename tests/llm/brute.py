"""Plain single-machine versions that the operators are held against."""


def line_dedup(docs, min_words):
    """``docs``: (key, text) in document order. The text of each key without lines that stand in a run said before, clear of it."""
    seqs, seen = [], set()
    for key, text in docs:
        if key not in seen and text is not None:
            seen.add(key)
            lines = text.split("\n")
            seqs.append((key, lines, [p for p, x in enumerate(lines) if x.split()]))
    said, dead = {}, set()  # runs, and all places where they end, in order
    for n, (_, lines, at) in enumerate(seqs):
        for a in range(len(at)):
            words = 0
            for b in range(a, len(at)):
                words += len(lines[at[b]].split())
                if words >= min_words:
                    places = said.setdefault(tuple(lines[p] for p in at[a : b + 1]), [])
                    if any(m < n or end < a for m, end in places):
                        dead.update((n, p) for p in range(at[a], [*at, len(lines)][b + 1]))
                    places.append((n, b))
    return {key: "\n".join(x for p, x in enumerate(lines) if (n, p) not in dead) for n, (key, lines, _) in enumerate(seqs)}


#: Rows that every operator has to stand: nulls in every column, empty and long texts, ties, repeated rows.
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog. Under the MIT License.\nMore of it.", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "An apache license, version 2 and CC BY-NC 4.0", "en", None, 5),
    (4, "word " * 30000, "en", "b", 150000),
    (5, "same text here", "en", "b", 14),
    (6, "same text here", "de", "b", 14),
    (6, "same text here", "de", "b", 14),
    (None, None, "fr", "c", None),
    (7, "x" * 60000, "fr", "", 60000),
    (8, "12345 !!! \t\n\n  ", "fr", "c", 9),
    (9, "été \U0001f600 中文 \u0085 \x1c end", "fr", "c", 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    """With extra columns whose names operators use inside or give out."""
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    return df.selectExpr("*", "1 AS key", "'x' AS fp", "2 AS shard", "'s' AS score", "3 AS copy", "'i' AS ids", "4 AS n_lines", "5 AS detections", "6 AS k0", "'f' AS fingerprint", "7 AS component")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def xxh_fingerprint(text):
    """Bit by bit, from the definition."""
    import re

    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, codes, radius):
    """The least id reachable over codes within the radius, by comparing all of them."""
    top = list(range(len(codes)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(x, least.get(find(i), x))
    return [least[find(i)] for i in range(len(codes))]


def position_probabilities(w, forward, backward=None):
    """The language network, one byte after the other. ``backward``: the bytes of the other direction if they differ.

    Gives the positions that both hold: the last of ``forward`` from where ``backward`` starts.
    """
    import numpy as np

    def states(side, text):
        n = w[side + "ac"].shape[1]
        h, out = np.zeros(n), []
        for byte in text:
            g = 1 / (1 + np.exp(-(w[side + "ag"][byte] + h @ w[side + "ug"])))
            c = np.tanh(w[side + "ac"][byte] + (g[n:] * h) @ w[side + "uc"])
            h = h + g[:n] * (c - h)
            out.append(h)
        return out

    backward = forward if backward is None else backward
    f, r = states("f", forward), states("r", backward[::-1])[::-1]
    n = max(k for k in range(min(len(f), len(r)) + 1) if forward[len(forward) - k :] == backward[:k])
    logits = np.array([x @ w["vf"] + y @ w["vb"] + w["b"] for x, y in zip(f[len(f) - n :], r)])
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def license_detections(text, rules):
    """``(first, last, priority, rule, label)`` of each rule's matches that no other contains, by comparing all of them."""
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = []
    for r in rules:
        pattern, at = re.compile(f" (?:{r.pattern}) "), 0
        spaced = " " + " ".join(words) + " "
        while m := pattern.search(spaced, at):
            first = spaced.count(" ", 0, m.start())
            found.append((first, first + len(m.group().split()) - 1, r.priority, r.rule, r.label, r.base))
            at = m.end() - 1  # the space after a match can stand before the next
    kept = []
    for x in found:
        over = [y for y in found if y[0] <= x[0] and y[1] >= x[1] and y[2] <= x[2] and (y[:2] != x[:2] or (y[2], y[3]) < (x[2], x[3]))]
        if x[5] or not over:
            kept.append(x[:5])
    return sorted(kept)


def differenced(partials):
    """Karmarkar-Karp over a plain list: the two of largest spread (ties: the earlier made) become one, until one is left."""
    if not partials:
        return []
    k = len(partials[0])
    made = []  # (sums largest first, for each of them the partials' parts in it)
    for n, sums in enumerate(partials):
        order = sorted(range(k), key=lambda j: (-sums[j], j))
        made.append([[sums[j] for j in order], [[(n, j)] for j in order], n])
    count = len(made)
    while len(made) > 1:
        made.sort(key=lambda x: (x[0][-1] - x[0][0], x[2]))
        (a, in_a, _), (b, in_b, _), *made = made
        sums, parts = [a[j] + b[k - 1 - j] for j in range(k)], [in_a[j] + in_b[k - 1 - j] for j in range(k)]
        order = sorted(range(k), key=lambda j: (-sums[j], j))
        made.append([[sums[j] for j in order], [parts[j] for j in order], count])
        count += 1
    out = [[0] * k for _ in partials]
    for shard, members in enumerate(made[0][1]):
        for n, j in members:
            out[n][j] = shard
    return out

"""The registered queries of the photo index as DuckDB SQL, over the raw test tables."""

from __future__ import annotations

from lumidex.settings import METRICS, Settings, Weights

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _unit(x: str) -> str:
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x}))"


def _sum(values: str) -> str:
    return f"list_reduce({values}, lambda a, b: a + b)"


def _mean(values: str) -> str:
    return f"({_sum(values)} / len({values}))"


def _variance(values: str, mean: str) -> str:
    squares = f"list_transform({values}, lambda x: (x - {mean}) * (x - {mean}))"
    return f"({_sum(squares)} / len({values}))"


def _hex(bits: str) -> str:
    one = lambda i: f"{bits}[4 * n + {i + 1}]"
    return f"array_to_string(list_transform(range(0, 16), lambda n: substr('0123456789abcdef', (1 + 8 * {one(0)} + 4 * {one(1)} + 2 * {one(2)} + {one(3)})::BIGINT, 1)), '')"


def r(x: str, digits: int = 6) -> str:
    return f"(floor(({x}) * {10.0**digits} + 0.5) / {10.0**digits})"


def _ramp(x: str, low: float, high: float) -> str:
    return f"(CASE WHEN {x} > 0 THEN {_unit(f'(log10({x}) - log10({low})) / (log10({high}) - log10({low}))')} ELSE 0.0 END)"


def _plateau(x: str, low: float, high: float, falloff: float) -> str:
    return _unit(f"1.0 - greatest({low} - {x}, {x} - {high}, 0.0) / {falloff}")


#: The cosine transform of 32 points, folded for cells that are repeated four times, from its definition.
_M = "list_transform(range(0, 8), lambda k: list_transform(range(0, 8), lambda c: (CASE WHEN k = 0 THEN sqrt(1 / 32.0::DOUBLE) ELSE sqrt(2 / 32.0::DOUBLE) END) * (" + " + ".join(f"cos(pi() * (2 * (4 * c + {x}) + 1) * k / 64)" for x in range(4)) + ")))"
#: Bits of ``g`` that are brighter than their left neighbour, on rows of eight widened to nine by repeating cells.
_DBITS = "list_transform(range(0, 64), lambda i: ({g}[(i // 8) * 8 + (i % 8 + 1) * 8 // 9 + 1] > {g}[(i // 8) * 8 + (i % 8) * 8 // 9 + 1])::INTEGER)"
_BLOCK = lambda p, side: [f"{p}[2 * (i // {side // 2}) * {side} + 2 * (i % {side // 2}) + {k}]" for k in (1, 2, side + 1, side + 2)]


def _laplacian(p: str, side: int) -> str:
    inner = side - 2
    at = f"((i // {inner}) + 1) * {side} + i % {inner} + 2"
    return f"list_transform(range(0, {inner * inner}), lambda i: {p}[{at} - {side}] + {p}[{at} + {side}] + {p}[{at} - 1] + {p}[{at} + 1] - 4 * {p}[{at}])"


def _median(s: str) -> str:
    return f"((list_sort({s})[(len({s}) + 1) // 2] + list_sort({s})[(len({s}) + 2) // 2]) / 2)"


def _box(p: str) -> str:
    start = "(2 * (i // 12)) * 8 + 2 * ((i // 3) % 4)"
    return f"(({p}[{start} + 1] + {p}[{start} + 2] + {p}[{start} + 9] + {p}[{start} + 10]) / 4)"


PLANES = f"""
base AS (SELECT vec_id, list_transform(embedding, lambda v: {_unit('0.5 + v::DOUBLE')}) AS gray, text AS body, n_chars, lang, source
         FROM embeddings JOIN documents ON vec_id = doc_id),
planes AS (SELECT * FROM base
    UNION ALL SELECT vec_id + 1000000, list_transform(gray, lambda v: {_unit('v * 1.02::DOUBLE')}), body || '#1', n_chars + 2, lang, source FROM base WHERE vec_id % 10 = 0
    UNION ALL SELECT vec_id + 2000000, list_transform(gray, lambda v, i: CASE WHEN (i - 1) % 23 = 7 THEN {_unit('v + 0.05::DOUBLE')} ELSE v END), body || '#2', n_chars + 2, lang, source
              FROM base WHERE vec_id % 15 = 0),
named AS (SELECT *, 'IMG_' || lpad(vec_id::VARCHAR, 7, '0') || CASE vec_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' ELSE '.JPG' END AS filename FROM planes),
facts AS (SELECT vec_id + 1 AS id, '/photos/' || source || '/' || lang || '/' || filename AS path, filename, n_chars AS size,
    (1600000000 + (vec_id % 10000) * 3600)::DOUBLE + 0.5 AS mtime, sha256(body) AS sha256,
    (640 + vec_id * 37 % 4000)::INTEGER AS width, (480 + vec_id * 53 % 3000)::INTEGER AS height,
    CASE WHEN vec_id % 3 = 1 THEN 'PNG' ELSE 'JPEG' END AS format,
    CASE WHEN vec_id % 7 != 0 THEN make_timestamp((1577836800 + (vec_id % 10000) * 18000) * 1000000) END AS taken_at,
    CASE vec_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Canon EOS R5' WHEN 2 THEN 'NIKON Z 6' WHEN 3 THEN 'Sony_A7' ELSE 'Pixel 9' END AS camera,
    CASE WHEN vec_id % 4 != 0 THEN (100 * pow(2, vec_id % 7))::INTEGER END AS iso,
    CASE vec_id % 9 WHEN 0 THEN 'delete' WHEN 1 THEN 'keep' ELSE 'none' END AS mark, (vec_id % 6)::INTEGER AS rating,
    CASE WHEN vec_id % 23 = 22 THEN 'error' ELSE 'ok' END AS status,
    gray, gray AS red, list_reverse(gray) AS green, list_transform(gray, lambda v: 1 - v) AS blue FROM named)"""

ANALYSED = f"""
h0 AS (SELECT *, {_M} AS m, {_mean('gray')} AS mean_luma FROM facts),
h1 AS (SELECT *, list_transform(range(0, 64), lambda i: {_sum('list_transform(range(0, 8), lambda y: m[i // 8 + 1][y + 1] * gray[y * 8 + i % 8 + 1])')}) AS half FROM h0),
h2 AS (SELECT *, list_transform(range(0, 64), lambda i: {_sum('list_transform(range(0, 8), lambda x: half[(i // 8) * 8 + x + 1] * m[i % 8 + 1][x + 1])')}) AS freq FROM h1),
h3 AS (SELECT *, list_sort([0.0::DOUBLE] || freq[2:64]) AS ordered FROM h2),
h4 AS (SELECT *, list_transform(freq, lambda v: (v > (ordered[32] + ordered[33]) / 2)::INTEGER) AS pbits,
    list_transform(gray, lambda v: (v > mean_luma)::INTEGER) AS abits,
    {_DBITS.format(g='gray')} AS dbits,
    {_laplacian('gray', 8)} AS lap,
    list_transform(list_transform(range(0, 16), lambda i: ({' '.join(s + x for s, x in zip(('', '- ', '- ', '+ '), _BLOCK('gray', 8)))}) / 2), lambda v: abs(v)) AS band,
    list_transform(range(0, 16), lambda i: ({' + '.join(_BLOCK('gray', 8))}) / 4) AS small,
    list_transform(range(0, 64), lambda i: red[i + 1] * 255 - green[i + 1] * 255) AS rg,
    list_transform(range(0, 64), lambda i: 0.5 * (red[i + 1] * 255 + green[i + 1] * 255) - blue[i + 1] * 255) AS yb,
    list_transform(gray, lambda v: least(63, floor(v * 64))::INTEGER) AS bins,
    list_transform(range(0, 48), lambda i: floor(least(255.0, greatest(0.0, (CASE i % 3 WHEN 0 THEN {_box('red')} WHEN 1 THEN {_box('green')} ELSE {_box('blue')} END) * 255)))::INTEGER) AS color_sig
    FROM h3),
h5 AS (SELECT *, {_hex('pbits')} AS phash0, {_hex('dbits')} AS dhash0, {_hex('abits')} AS ahash0, {_mean('lap')} AS lap_mean, {_laplacian('small', 4)} AS lap2, {_mean('rg')} AS rg_mean, {_mean('yb')} AS yb_mean FROM h4),
h6 AS (SELECT *, {_variance('lap', 'lap_mean')} AS laplacian_variance, {_variance('gray', 'mean_luma')} AS gray_var, {_mean('lap2')} AS lap2_mean,
    len(list_filter(gray, lambda v: v < 0.02)) / 64.0 AS shadow_clip, len(list_filter(gray, lambda v: v > 0.98)) / 64.0 AS highlight_clip,
    sqrt({_variance('rg', 'rg_mean')} + {_variance('yb', 'yb_mean')}) + 0.3 * sqrt(rg_mean * rg_mean + yb_mean * yb_mean) AS colorfulness,
    {_median('band')} / 0.6745 AS noise_sigma, width::BIGINT * height / 1e6 AS megapixels,
    {_sum("list_transform(list_sort(list_distinct(bins)), lambda k: -(len(list_filter(bins, lambda x: x = k)) / 64.0) * log2(len(list_filter(bins, lambda x: x = k)) / 64.0))")} AS entropy FROM h5),
h7 AS (SELECT *, sqrt(gray_var) AS contrast_std, CASE WHEN laplacian_variance > 0 THEN sqrt(laplacian_variance) / greatest(sqrt(gray_var), 0.06) ELSE 0.0 END AS edge_strength,
    sqrt({_variance('lap2', 'lap2_mean')}) AS structure FROM h6),
h8 AS (SELECT *, CASE WHEN noise_sigma > 0 AND structure > 1e-5 THEN noise_sigma / structure ELSE 0.0 END AS grain_ratio FROM h7),
h9 AS (SELECT *, {_ramp('edge_strength', 0.10, 0.62)} AS m_sharpness,
    {_unit(_plateau('mean_luma', 0.34, 0.62, 0.34) + ' * (1 - ' + _unit('2.2 * greatest(0.0, highlight_clip - 0.015) + 1.2 * greatest(0.0, shadow_clip - 0.02)') + ')')} AS m_exposure,
    {_plateau('contrast_std', 0.16, 0.32, 0.20)} AS m_contrast, {_unit('colorfulness / 70.0')} AS m_colorfulness, 1 - {_ramp('grain_ratio', 0.09, 0.22)} AS m_noise,
    {_ramp('greatest(megapixels, 1e-6)', 0.3, 24.0)} AS m_resolution, {_unit('entropy / 5.6')} AS m_detail FROM h8),
h10 AS (SELECT *, list_filter([CASE WHEN mean_luma < 0.16 THEN 'dark' END, CASE WHEN mean_luma > 0.82 THEN 'bright' END, CASE WHEN highlight_clip > 0.12 THEN 'blown highlights' END,
    CASE WHEN contrast_std < 0.055 THEN 'flat' END, CASE WHEN grain_ratio > 0.17 AND noise_sigma > 0.008 THEN 'noisy' END, CASE WHEN entropy < 2.0 THEN 'empty' END,
    CASE WHEN m_sharpness < 0.22 THEN 'blurry' END, CASE WHEN iso > 3200 THEN 'ISO ' || iso END], lambda f: f IS NOT NULL) AS all_flags FROM h9),
photos AS (SELECT * EXCLUDE (color_sig), CASE WHEN status = 'ok' THEN color_sig END AS color_sig, CASE WHEN status = 'ok' THEN phash0 ELSE '' END AS phash,
    CASE WHEN status = 'ok' THEN dhash0 ELSE '' END AS dhash, CASE WHEN status = 'ok' THEN ahash0 ELSE '' END AS ahash,
    CASE WHEN status = 'ok' THEN all_flags ELSE [] END AS flags,
    CASE WHEN status = 'ok' THEN floor(SCORE) / 100 ELSE 0.0 END AS score FROM h10)"""


#: The weights of a score, and another choice of them.
_WEIGHTS = {"sharpness": 3.0, "exposure": 2.0, "contrast": 1.5, "colorfulness": 1.0, "noise": 1.5, "resolution": 1.5, "detail": 1.0}
_OTHER = {"sharpness": 1.0, "exposure": 0.0, "contrast": 2.0, "colorfulness": 5.0, "noise": 0.0, "resolution": 4.0, "detail": 0.5}


def _weighted(weights: dict[str, float]) -> str:
    return "(" + " + ".join(f"({w}::DOUBLE / {sum(weights.values())}::DOUBLE) * m_{m}" for m, w in weights.items()) + ")"


_SCORE = _unit(f"{_weighted(_WEIGHTS)} * CASE WHEN iso > 3200 THEN 0.97::DOUBLE ELSE 1.0 END") + " * 100 * 100 + 0.5"
ANALYSED = ANALYSED.replace("floor(SCORE)", f"floor({_SCORE})")

#: The named orders.
ORDERS = {
    "score": f"score DESC, translate(filename, '{_UPPER}', '{_LOWER}')",
    "score_asc": f"score, translate(filename, '{_UPPER}', '{_LOWER}')",
    "name": f"translate(filename, '{_UPPER}', '{_LOWER}')",
    "name_desc": f"translate(filename, '{_UPPER}', '{_LOWER}') DESC",
    "date": "taken_at DESC NULLS LAST, mtime DESC",
    "date_asc": "taken_at NULLS FIRST, mtime",
    "size": "size DESC",
    "size_asc": "size",
    "resolution": "width::BIGINT * height DESC",
    "folder": f"translate(path, '{_UPPER}', '{_LOWER}')",
}


def _halves(h: str) -> str:
    return f"('0x' || {h})::UBIGINT"


def _pairs(threshold: int) -> str:
    return f"""near AS (SELECT x.id AS a, y.id AS b, bit_count(xor({_halves('x.phash')}, {_halves('y.phash')}))::INTEGER AS distance,
    bit_count(xor({_halves('x.dhash')}, {_halves('y.dhash')}))::INTEGER AS d_distance,
    list_reduce(list_transform(range(1, 49), lambda i: abs(x.color_sig[i] - y.color_sig[i])::DOUBLE), lambda s, v: s + v) / 48 / 255 AS c_distance
    FROM photos x JOIN photos y ON x.id < y.id AND x.status = 'ok' AND y.status = 'ok' AND bit_count(xor({_halves('x.phash')}, {_halves('y.phash')})) <= {threshold})"""


def _groups(s: Settings) -> str:
    return f"""{_pairs(s.phash_threshold)},
links AS (SELECT a, b FROM near WHERE d_distance <= {s.dhash_threshold} AND c_distance <= {s.color_threshold}
    UNION SELECT x.id, y.id FROM photos x JOIN photos y ON x.sha256 = y.sha256 AND x.id < y.id AND x.status = 'ok' AND y.status = 'ok'),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS node, a AS root FROM edges UNION SELECT edges.b, reach.root FROM reach JOIN edges ON edges.a = reach.node),
comp AS (SELECT node AS id, min(root) AS root FROM reach GROUP BY node),
members AS (SELECT root, p.*, row_number() OVER w AS place, first_value(phash) OVER w AS first_phash FROM comp JOIN photos p USING (id)
    WINDOW w AS (PARTITION BY root ORDER BY score DESC, filename, p.id)),
keyed AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY floor(score * 100 + 0.5) / 100 DESC, width::BIGINT * height DESC, size DESC, mtime, id) AS best FROM members),
summed AS (SELECT root, count(*) AS n, CASE WHEN count(DISTINCT sha256) = 1 THEN 'exact' ELSE 'similar' END AS kind,
    max(CASE WHEN best = 1 THEN id END) AS best_id, (sum(size) - max(CASE WHEN best = 1 THEN size END))::BIGINT AS wasted,
    avg(CASE WHEN place > 1 THEN 100 * (1 - bit_count(xor({_halves('first_phash')}, {_halves('phash')})) / 64.0) END) AS likeness,
    max(CASE WHEN place = 1 THEN score END) AS lead_score, max(CASE WHEN place = 1 THEN filename END) AS lead_name, max(CASE WHEN place = 1 THEN id END) AS lead_id
    FROM keyed GROUP BY root),
groups AS (SELECT row_number() OVER (ORDER BY wasted DESC, n DESC, lead_score DESC, lead_name, lead_id)::INTEGER AS group_index, root, kind, best_id,
    CASE WHEN kind = 'exact' THEN 100.0::DOUBLE ELSE {r('likeness', 1)} END AS tightness, n, wasted FROM summed)"""


def full(select: str, *parts: str) -> str:
    """A statement over ``photos``."""
    head = ",".join(["WITH RECURSIVE " + PLANES.strip(), ANALYSED, *("\n" + p for p in parts)])
    return f"{head}\n{select}"


def _like(column: str, needle: str) -> str:
    return f"translate({column}, '{_UPPER}', '{_LOWER}') LIKE '%{needle.lower()}%'"


def _manifest(rank: str) -> str:
    cast = lambda x: f"coalesce({x}, '')"
    metrics = ", ".join(f"coalesce(CASE WHEN status = 'ok' THEN {r('m_' + m, 4)} END, 0.0) AS metric_{m}" for m in METRICS)
    return f"""SELECT {rank} AS rank, printf('%04d_', {rank}) || filename AS exported_as, path AS source, {r('score', 2)} AS score,
    CASE WHEN score >= 85 THEN 'A' WHEN score >= 72 THEN 'B' WHEN score >= 58 THEN 'C' WHEN score >= 42 THEN 'D' WHEN score >= 25 THEN 'E' ELSE 'F' END AS grade,
    rating, width, height, {r('megapixels', 2)} AS megapixels, size AS bytes, format, camera, {cast('iso::VARCHAR')} AS iso,
    {cast("strftime(taken_at, '%Y-%m-%dT%H:%M:%S')")} AS taken_at, array_to_string(flags, ' ') AS flags, {cast('group_index::VARCHAR')} AS duplicate_group,
    CASE WHEN best_id IS NULL THEN '' WHEN best_id = id THEN 'keeper' ELSE 'duplicate' END AS group_role, {metrics}"""


GRADE = "CASE WHEN score >= 85 THEN 'A' WHEN score >= 72 THEN 'B' WHEN score >= 58 THEN 'C' WHEN score >= 42 THEN 'D' WHEN score >= 25 THEN 'E' ELSE 'F' END"
#: Another choice of weights, for the queries that score anew.
OTHER_WEIGHTS = Weights(**_OTHER)
#: A wider radius, at which the edited copies meet.
WIDE = Settings(phash_threshold=15)


def _import(select: str) -> str:
    """A batch of photos (ids from 1,000,000) against an index of the others."""
    return full(select, "batch AS (SELECT * FROM photos WHERE status = 'ok' AND (id > 1000000 OR id % 5 = 2))", "known AS (SELECT * FROM photos WHERE status = 'ok' AND id <= 1000000 AND id % 5 != 2)")


def statements() -> dict[str, str]:
    ok = "status = 'ok'"
    out = {}
    for name, order in ORDERS.items():
        extra = ", score, " + GRADE + " AS grade" if name == "score" else ""
        out[f"rank_{name}"] = full(f"SELECT id, filename{extra}, (row_number() OVER (ORDER BY {order}, id))::INTEGER AS rank FROM photos WHERE {ok}")
    out["search_path"] = full(f"SELECT id, path FROM photos WHERE {ok} AND ({_like('path', 'SRC1/')} OR {_like('camera', 'SRC1/')})")
    out["search_wildcard"] = full(f"SELECT id, camera FROM photos WHERE {ok} AND ({_like('path', 'y_a')} OR {_like('camera', 'y_a')})")
    out["filter_flag"] = full(f"SELECT id, array_to_string(flags, ',') AS flags FROM photos WHERE {ok} AND list_contains(flags, 'noisy')")
    out["filter_score"] = full(f"SELECT id, score FROM photos WHERE {ok} AND score >= 66 AND score <= 74")
    out["filter_mark"] = full(f"SELECT id, mark FROM photos WHERE {ok} AND mark = 'keep'")
    out["topk"] = full(f"SELECT id, score FROM photos WHERE {ok} ORDER BY {ORDERS['score']}, id LIMIT 25")
    out["above_score"] = full("SELECT id, score FROM photos WHERE score >= 75")
    out["lookup_id"] = full("SELECT id, path, status FROM photos WHERE id = 44")
    out["signatures"] = full(f"SELECT path, size, mtime FROM photos WHERE {ok}")
    out["digests"] = full("SELECT sha256, arg_max(path, id) AS path FROM photos WHERE sha256 != '' GROUP BY sha256")
    out["stats_global"] = full(f"""SELECT count(*) FILTER (WHERE {ok}) AS total, coalesce(sum(size) FILTER (WHERE {ok}), 0)::BIGINT AS bytes,
        {r(f'coalesce(avg(score) FILTER (WHERE {ok}), 0)', 4)} AS mean_score, coalesce(sum(width::BIGINT * height) FILTER (WHERE {ok}), 0)::BIGINT / 1e6 AS megapixels,
        count(*) FILTER (WHERE NOT {ok}) AS errors FROM photos""")
    out["stats_marks"] = full("SELECT mark, count(*) AS n FROM photos GROUP BY mark")
    out["stats_count"] = full(f"SELECT count(*) AS photos, count(*) FILTER (WHERE {ok}) AS usable FROM photos")
    out["percentile"] = full(f"SELECT id, {r('100.0 * (rank() OVER (ORDER BY score) - 1) / count(*) OVER ()', 1)} AS percentile FROM photos WHERE {ok}")
    out["grade"] = full(f"SELECT {GRADE} AS grade, CASE WHEN score >= 72 THEN 'good' WHEN score >= 50 THEN 'warn' ELSE 'bad' END AS band, count(*) AS n FROM photos WHERE {ok} GROUP BY ALL")
    for h in ("ahash", "dhash", "phash"):
        out[h] = full(f"SELECT id, {h} FROM photos")
    out["color_sig"] = full("SELECT id, array_to_string(color_sig, ',') AS color_sig FROM photos WHERE status = 'ok'")
    turn = "list_transform(range(0, 64), lambda i: {p}[(i % 8) * 8 + (7 - i // 8) + 1])"
    out["luma"] = full(f"SELECT id, {r(_mean('list_transform(range(1, 65), lambda i: 0.2126 * red[i] + 0.7152 * green[i] + 0.0722 * blue[i])'))} AS luma FROM facts")
    out["rotated_dhash"] = full(
        f"SELECT id, {_hex('dbits')} AS dhash_90 FROM b",
        f"t AS (SELECT id, {turn.format(p='gray')} AS g FROM facts)",
        f"b AS (SELECT id, {_DBITS.format(g='g')} AS dbits FROM t)",
    )
    for t in (10, 15, 18):
        out[f"hamming_pairs_t{t}"] = full("SELECT a, b, distance FROM near", _pairs(t))
    out["hamming_pairs_segments"] = out["hamming_pairs_t10"]
    out["color_verify"] = full(f"SELECT a, b, distance, d_distance, {r('c_distance')} AS c_distance FROM near WHERE d_distance <= 16 AND c_distance <= 0.28", _pairs(15))
    out["exact_groups"] = full(f"SELECT sha256, min(id) AS first_id, count(*) AS n FROM photos WHERE {ok} GROUP BY sha256 HAVING count(*) > 1")
    columns = "group_index, root, kind, best_id, tightness, n, wasted"
    out["dup_groups"] = full(f"SELECT {columns} FROM groups", _groups(Settings()))
    out["dup_groups_wide"] = full(f"SELECT {columns} FROM groups", _groups(WIDE))
    out["group_members"] = full("SELECT group_index, kind, id, place::INTEGER AS place, id = best_id AS is_best FROM groups JOIN members USING (root)", _groups(WIDE))
    out["group_keeper"] = full("SELECT root, best_id FROM groups", _groups(WIDE))
    out["group_kind"] = full("SELECT kind, count(*) AS n FROM groups GROUP BY kind", _groups(WIDE))
    out["group_tightness"] = full("SELECT root, tightness FROM groups", _groups(WIDE))
    out["group_stats"] = full(
        "SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS photos_in_groups, coalesce(sum(n - 1), 0)::BIGINT AS removable, coalesce(sum(wasted), 0)::BIGINT AS wasted_bytes, count(*) FILTER (WHERE kind = 'exact') AS exact_groups FROM groups", _groups(WIDE)
    )
    out["keepers_only"] = full(f"SELECT id FROM photos WHERE {ok} AND id NOT IN (SELECT id FROM members JOIN groups USING (root) WHERE id != best_id)", _groups(WIDE))
    out["repaired_groups"] = full(
        "SELECT (dense_rank() OVER (ORDER BY group_index))::INTEGER AS group_index, id FROM (SELECT *, count(*) OVER (PARTITION BY group_index) AS c FROM left_) WHERE c > 1",
        _groups(WIDE), "left_ AS (SELECT group_index, id FROM groups JOIN members USING (root) WHERE id % 4 != 1)",
    )
    out["review_marks"] = full("SELECT id, CASE WHEN best_id IS NULL THEN mark WHEN best_id = id THEN 'none' ELSE 'delete' END AS mark FROM photos LEFT JOIN (SELECT id, best_id FROM members JOIN groups USING (root)) USING (id)", _groups(WIDE))
    score = f"floor({_unit(_weighted(_OTHER))} * 100 * 100 + 0.5) / 100"
    out["rescore"] = full(f"SELECT id, CASE WHEN {ok} THEN {score} ELSE score END AS score FROM photos")
    out["analyse"] = full("SELECT id, phash, dhash, ahash, score, array_to_string(flags, ',') AS flags FROM photos")
    out["score"] = full("SELECT id, score FROM photos")
    out["metrics"] = full(f"SELECT id, {', '.join(f'{r("m_" + m)} AS {m}' for m in METRICS)} FROM photos WHERE {ok}")
    out["flags"] = full("SELECT id, array_to_string(flags, ',') AS flags FROM photos")
    measures = {"entropy": "entropy", "laplacian": "laplacian_variance", "edge": "edge_strength", "noise_sigma": "noise_sigma", "grain": "grain_ratio", "colorfulness": "colorfulness"}
    for name, column in measures.items():
        out[name] = full(f"SELECT id, {r(column)} AS {column} FROM photos")
    out["exposure"] = full(f"SELECT id, {r('mean_luma')} AS mean_luma, {r('shadow_clip')} AS shadow_clip, {r('highlight_clip')} AS highlight_clip, {r('contrast_std')} AS contrast_std FROM photos")
    fresh = f"(SELECT path, size + 7 AS size, mtime + 60 AS mtime FROM photos WHERE id % 3 = 0 UNION ALL SELECT '/photos/new/' || filename, size, mtime FROM photos WHERE id % 50 = 1)"
    out["upsert"] = full(
        f"SELECT coalesce(p.id, (SELECT max(id) FROM photos) + f.nth) AS id, coalesce(p.path, f.path) AS path, coalesce(f.size, p.size) AS size, coalesce(f.mtime, p.mtime) AS mtime, coalesce(p.mark, 'none') AS mark, coalesce(p.rating, 0)::INTEGER AS rating FROM photos p FULL JOIN f ON f.path = p.path",
        f"f AS (SELECT *, row_number() OVER (PARTITION BY path LIKE '/photos/new/%' ORDER BY path) AS nth FROM {fresh})",
    )
    out["scan_diff"] = full(
        f"SELECT f.path, f.size, f.mtime, CASE WHEN p.status = 'ok' AND p.size = f.size AND abs(p.mtime - f.mtime) < 1e-6 THEN 'skip' WHEN p.path IS NOT NULL THEN 'update' ELSE 'add' END AS action FROM found f LEFT JOIN photos p ON p.path = f.path",
        "found AS (SELECT CASE WHEN id % 11 = 0 THEN '/photos/new/' || filename ELSE path END AS path, size + CASE WHEN id % 6 = 0 THEN 1 ELSE 0 END AS size, mtime FROM photos)",
    )
    out["prune"] = full("SELECT id, path FROM photos WHERE NOT (starts_with(path, '/photos/src1/') AND id % 2 = 0 AND id % 3 != 0)")
    out["mark_ids"] = full("SELECT id, CASE WHEN id % 8 = 0 THEN 'keep' ELSE mark END AS mark FROM photos")
    out["bulk_scores"] = full("SELECT id, CASE WHEN id % 4 = 0 THEN (id % 100)::DOUBLE ELSE score END AS score FROM photos")
    out["delete_paths"] = full("SELECT id FROM photos WHERE id % 9 != 4")
    out["import_exact"] = _import("SELECT b.path, CASE WHEN k.sha256 IS NOT NULL OR row_number() OVER (PARTITION BY b.sha256 ORDER BY b.id) > 1 THEN 'duplicate' ELSE 'import' END AS outcome FROM batch b LEFT JOIN (SELECT DISTINCT sha256 FROM known) k ON k.sha256 = b.sha256")
    out["import_similar"] = full(
        "SELECT id, outcome FROM go WHERE k > 0",
        "near AS (" + _pairs(WIDE.phash_threshold).removeprefix("near AS (")[:-1] + ")",
        f"linked AS (SELECT a, b FROM near WHERE d_distance <= {WIDE.dhash_threshold} AND c_distance <= {WIDE.color_threshold})",
        "both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked)",
        "fresh AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM photos WHERE status = 'ok' AND (id > 1000000 OR id % 5 = 2))",
        "ties AS (SELECT f.id, f.k, coalesce(list(b.b) FILTER (WHERE b.b IS NOT NULL), []) AS around, coalesce(bool_or(o.id IS NULL AND b.b IS NOT NULL), false) AS known FROM fresh f LEFT JOIN both_ways b ON b.a = f.id LEFT JOIN fresh o ON o.id = b.b GROUP BY f.id, f.k)",
        "go AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS id, NULL::VARCHAR AS outcome UNION ALL SELECT t.k, CASE WHEN t.known OR list_has_any(t.around, go.taken) THEN go.taken ELSE list_append(go.taken, t.id) END, t.id, CASE WHEN t.known OR list_has_any(t.around, go.taken) THEN 'similar' ELSE 'import' END FROM go JOIN ties t ON t.k = go.k + 1)",
    )
    nth = "row_number() OVER (PARTITION BY id % 300 ORDER BY id) - 1"
    out["free_names"] = full(f"SELECT id, '/out/' || printf('%03d', id % 300) || CASE WHEN {nth} = 0 THEN '' ELSE '-' || ({nth})::VARCHAR END || '.jpg' AS target FROM facts")
    when = "coalesce(taken_at, make_timestamp((mtime * 1000000)::BIGINT))"
    out["import_paths"] = full(f"SELECT id, '/library/' || strftime({when}, '%Y') || '/' || strftime({when}, '%Y-%m') || '/' || filename AS by_date, '/library/photos' || substr(path, 8) AS by_source, '/library/' || filename AS flat FROM photos")
    out["export_names"] = full(f"SELECT id, printf('%04d_', (row_number() OVER (ORDER BY {ORDERS['score']}, id))::INTEGER) || filename AS by_rank, printf('%03d_', round_even(score, 0)::INTEGER) || filename AS by_score, strftime({when}, '%Y-%m-%d_') || filename AS by_date FROM photos WHERE {ok}")
    out["manifest"] = full(
        _manifest(f"(row_number() OVER (ORDER BY {ORDERS['score']}, id))::INTEGER") + f" FROM photos LEFT JOIN (SELECT id, group_index, best_id FROM members JOIN groups USING (root)) USING (id) WHERE {ok}", _groups(WIDE)
    )
    out["labels"] = full(f"SELECT id, {r('width::BIGINT * height / 1e6')} AS megapixels, CASE WHEN size >= 1024 THEN CASE WHEN size >= 102400 THEN ((size * 2 + 1024) // 2048)::VARCHAR || ' KB' ELSE ((size * 20 + 1024) // 2048 // 10)::VARCHAR || '.' || ((size * 20 + 1024) // 2048 % 10)::VARCHAR || ' KB' END ELSE printf('%d B', size) END AS human_size, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, {r('size / (width::BIGINT * height)', 9)} AS bytes_per_pixel, CASE WHEN width // gcd(width, height) > 30 OR height // gcd(width, height) > 30 THEN printf('%d.%02d:1', (width * 200 + height) // (height * 2) // 100, (width * 200 + height) // (height * 2) % 100) ELSE (width // gcd(width, height))::VARCHAR || ':' || (height // gcd(width, height))::VARCHAR END AS aspect FROM photos")
    # hashes of turned planes: (id, q) for q quarters
    frame = lambda source: [
        f"q0 AS ({source})",
        f"q1 AS (SELECT id, 0 AS q, g FROM q0 UNION ALL SELECT id, 1, {turn.format(p='g')} FROM q0)",
        f"q2 AS (SELECT id, q, g FROM q1 UNION ALL SELECT id, q + 2, {turn.format(p=turn.format(p='g').replace('lambda i', 'lambda j').replace('i ', 'j '))} FROM q1)",
        f"q3 AS (SELECT id, q, {_M} AS m, g FROM q2)",
        f"q4 AS (SELECT id, q, m, list_transform(range(0, 64), lambda i: {_sum('list_transform(range(0, 8), lambda y: m[i // 8 + 1][y + 1] * g[y * 8 + i % 8 + 1])')}) AS half FROM q3)",
        f"q5 AS (SELECT id, q, list_transform(range(0, 64), lambda i: {_sum('list_transform(range(0, 8), lambda x: half[(i // 8) * 8 + x + 1] * m[i % 8 + 1][x + 1])')}) AS freq FROM q4)",
        "q6 AS (SELECT id, q, freq, list_sort([0.0::DOUBLE] || freq[2:64]) AS ordered FROM q5)",
        "q7 AS (SELECT id, q, list_transform(freq, lambda v: (v > (ordered[32] + ordered[33]) / 2)::INTEGER) AS bits FROM q6)",
        f"turned AS (SELECT id, q, {_hex('bits')} AS h FROM q7)",
    ]
    out["rotated_phash"] = full("SELECT id, max(h) FILTER (WHERE q = 1) AS phash_90, max(h) FILTER (WHERE q = 2) AS phash_180, max(h) FILTER (WHERE q = 3) AS phash_270 FROM turned GROUP BY id", *frame("SELECT id, gray AS g FROM facts"))
    out["rotated_pairs"] = full(
        f"SELECT x.id AS a, y.id AS b, min(bit_count(xor({_halves('x.h')}, {_halves('y.h')})))::INTEGER AS distance FROM turned x JOIN turned y ON x.id < y.id AND (x.q = 0 OR y.q = 0) AND bit_count(xor({_halves('x.h')}, {_halves('y.h')})) <= 6 GROUP BY ALL",
        *frame(f"SELECT id, gray AS g FROM facts WHERE {ok} AND id <= 1000000 UNION ALL SELECT id + 5000000, {turn.format(p='gray')} FROM facts WHERE {ok} AND id <= 1000000 AND id % 7 = 0"),
    )
    out["import_matches"] = full(
        "SELECT id, match FROM (SELECT fresh AS id, old AS match, row_number() OVER (PARTITION BY fresh ORDER BY score DESC, old) AS nth FROM met) WHERE nth = 1",
        _pairs(WIDE.phash_threshold),
        f"alike AS (SELECT a, b FROM near WHERE d_distance <= {WIDE.dhash_threshold} AND c_distance <= {WIDE.color_threshold})",
        "sides AS (SELECT a AS fresh, b AS old FROM alike UNION ALL SELECT b, a FROM alike)",
        "met AS (SELECT fresh, old, p.score FROM sides JOIN photos p ON p.id = old WHERE (fresh > 1000000 OR fresh % 5 = 2) AND NOT (old > 1000000 OR old % 5 = 2))",
    )
    out["import_present"] = full("SELECT id, CASE WHEN id % 6 = 0 THEN 'duplicate' ELSE 'import' END AS outcome, CASE WHEN id % 6 = 0 THEN '/library/' || filename END AS match FROM facts")
    out["outside_library"] = full("SELECT id FROM facts WHERE NOT starts_with(path, '/photos/src1/')")
    out["export_folders"] = full(
        f"SELECT p.id, '/out/' || CASE WHEN group_index IS NULL THEN '' ELSE printf('group-%03d/', group_index) END || printf('%04d_', (row_number() OVER (ORDER BY {ORDERS['score'].replace('filename', 'p.filename').replace('score', 'p.score')}, p.id))::INTEGER) || p.filename AS target FROM photos p LEFT JOIN (SELECT id, group_index FROM members JOIN groups USING (root)) g ON g.id = p.id WHERE p.status = 'ok'",
        _groups(WIDE),
    )
    out["export_preview"] = full(f"SELECT count(*) AS photos, coalesce(sum(size), 0)::BIGINT AS bytes, {r('coalesce(sum(width::BIGINT * height / 1e6), 0)')} AS megapixels, {r('coalesce(avg(score), 0)', 4)} AS mean_score FROM photos WHERE score >= 70")
    out["captions"] = full("""SELECT id, camera AS label, concat_ws('  ', width || 'x' || height || '  ' || printf('%.1f MP', width::BIGINT * height / 1e6), nullif(camera, ''), strftime(taken_at, '%Y-%m-%d')) AS summary,
        CASE WHEN id % 4 IN (0, 1) THEN strftime(taken_at, '%Y-%m-%d %H:%M:%S') WHEN id % 4 = 2 THEN strftime(taken_at, '%Y-%m-%d 00:00:00') END AS parsed,
        sha1(path || '|256|' || floor(mtime)::BIGINT) AS thumbnail FROM facts""")
    out["metrics_json"] = out["metrics"]

    def boxes(height: int, width: int) -> str:
        cell = f"flatten(list_transform(range((i // {width}) * 8 // {height}, (i // {width} + 1) * 8 // {height}), lambda y: list_transform(range((i % {width}) * 8 // {width}, (i % {width} + 1) * 8 // {width}), lambda x: gray[y * 8 + x + 1])))"
        return f"array_to_string(list_transform(range(0, {height * width}), lambda i: floor(list_avg({cell}) * 1e6 + 0.5)::BIGINT), ',')"

    out["area_resize"] = full(f"SELECT id, {boxes(5, 3)} AS tall, {boxes(2, 7)} AS wide FROM facts")

    def filtered(plane: str, before: int, after: int, kernel: str, reach: int) -> str:
        """Weights of a filter between two sizes, from its definition: ``o`` the new cell, ``i`` the old one."""
        step, stretch = f"({before} / {after}.0::DOUBLE)", f"greatest(1.0::DOUBLE, {before} / {after}.0::DOUBLE)"
        x = f"abs((i + 0.5 - (o + 0.5) * {step}) / {stretch})"
        inside = f"i >= floor((o + 0.5) * {step} - {reach} * {stretch} + 0.5) AND i < floor((o + 0.5) * {step} + {reach} * {stretch} + 0.5)"
        return f"{plane} AS (SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM (SELECT o, i, {kernel.format(x=x)} AS w FROM range(0, {after}) a(o), range(0, {before}) b(i) WHERE {inside}))"

    sinc = lambda x: f"(CASE WHEN {x} = 0 THEN 1.0 ELSE sin(pi() * {x}) / (pi() * {x}) END)"
    kernels = {
        "triangle": ("greatest(0.0, 1 - {x})", 1),
        "cubic": ("(CASE WHEN {x} < 1 THEN 1.5 * {x} ** 3 - 2.5 * {x} ** 2 + 1 WHEN {x} < 2 THEN -0.5 * ({x} ** 3 - 5 * {x} ** 2 + 8 * {x} - 4) ELSE 0.0 END)", 2),
        "lanczos": (f"(CASE WHEN {{x}} < 3 THEN {sinc('{x}')} * {sinc('({x} / 3)')} ELSE 0.0 END)", 3),
    }

    def resized(name: str, height: int, width: int, kernel: str) -> list[str]:
        wide = f"{name}_across AS (SELECT id, y, c.o AS x, sum(c.w * gray[y * 8 + c.i + 1]) AS v FROM facts, range(0, 8) r(y), {name}_x c GROUP BY ALL)"
        tall = f"{name}_down AS (SELECT id, d.o AS y, x, sum(d.w * v) AS v FROM {name}_across a JOIN {name}_y d ON d.i = a.y GROUP BY ALL)"
        row = f"{name} AS (SELECT id, string_agg(floor(v * 1e6 + 0.5)::BIGINT::VARCHAR, ',' ORDER BY y, x) AS {name} FROM {name}_down GROUP BY id)"
        return [filtered(f"{name}_x", 8, width, *kernels[kernel]), filtered(f"{name}_y", 8, height, *kernels[kernel]), wide, tall, row]

    out["resample"] = full("SELECT id, smaller, shrunk, larger FROM smaller JOIN shrunk USING (id) JOIN larger USING (id)", *resized("smaller", 5, 3, "triangle"), *resized("shrunk", 3, 4, "lanczos"), *resized("larger", 11, 13, "cubic"))
    out["group_labels"] = full("SELECT root, CASE kind WHEN 'exact' THEN 'Identical' ELSE 'Similar' END || ' - ' || n || ' photos' AS label FROM groups", _groups(WIDE))
    out["free_names_taken"] = full(
        "SELECT w.id, '/out/' || w.k || CASE WHEN f.n = 0 THEN '' ELSE '-' || f.n END || '.jpg' AS target FROM wishes w JOIN free f ON f.k = w.k AND f.nth = w.nth",
        "wishes AS (SELECT id, id % 3 AS k, row_number() OVER (PARTITION BY id % 3 ORDER BY id) AS nth FROM facts)",
        "taken AS (SELECT DISTINCT id % 3 AS k, CASE WHEN id % 8 = 1 THEN 0 ELSE id % 1000 END AS n FROM facts WHERE id % 4 = 1)",
        "free AS (SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY n) AS nth FROM (SELECT k, n FROM range(0, 3) x(k), range(0, (SELECT count(*) FROM facts) + 1001) y(n)) a ANTI JOIN taken USING (k, n))",
    )
    out["all_paths"] = full("SELECT path FROM photos")
    out["edited_rows"] = full("SELECT id, CASE WHEN id = 7 THEN '/moved/new.jpg' ELSE path END AS path, CASE WHEN id = 7 THEN 'new.jpg' ELSE filename END AS filename, CASE WHEN id = 3 THEN 'keep' ELSE 'none' END AS mark, CASE id WHEN 5 THEN 5 WHEN 6 THEN 0 ELSE rating END::INTEGER AS rating FROM facts")
    return out

"""Technical quality as Columns over planes of doubles in 0..1, row by row, ``side`` x ``side``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumidex.functions.numbers import clamp, let, log_ramp, mean, median, plateau, variance
from lumidex.settings import METRICS, Weights

BINS = 64


def _cells(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _row(i: Column, width: int) -> Column:
    return F.floor(i / width).cast("int")


def luma(red: Column, green: Column, blue: Column) -> Column:
    return F.transform(_cells(64), lambda i: 0.2126 * F.get(red, i) + 0.7152 * F.get(green, i) + 0.0722 * F.get(blue, i))


def laplacian(gray: Column, side: int = 8) -> Column:
    """The four-neighbour second difference at inner cells; none for planes under 3 cells."""
    if side < 3:
        return F.array().cast("array<double>")
    inner = side - 2

    def one(i: Column) -> Column:
        at = (_row(i, inner) + 1) * side + i % inner + 1
        return F.get(gray, at - side) + F.get(gray, at + side) + F.get(gray, at - 1) + F.get(gray, at + 1) - 4 * F.get(gray, at)

    return F.transform(_cells(inner * inner), one)


def laplacian_variance(gray: Column, side: int = 8) -> Column:
    return variance(laplacian(gray, side))


def edge_strength(gray: Column, side: int = 8) -> Column:
    """Edge energy against contrast."""
    strength = lambda energy: F.when(energy > 0, F.sqrt(energy) / F.greatest(F.sqrt(variance(gray)), F.lit(0.06))).otherwise(0.0)
    return let(laplacian_variance(gray, side), strength)


def _blocks(gray: Column, side: int, one) -> Column:
    half = side // 2

    def at(i: Column) -> Column:
        start = 2 * _row(i, half) * side + 2 * (i % half)
        return one(F.get(gray, start), F.get(gray, start + 1), F.get(gray, start + side), F.get(gray, start + side + 1))

    return F.transform(_cells(half * half), at) if half else F.array().cast("array<double>")


def diagonal_band(gray: Column, side: int = 8) -> Column:
    """The finest diagonal detail of each 2 x 2 block."""
    return _blocks(gray, side, lambda a, b, c, d: (a - b - c + d) / 2)


def noise_sigma(gray: Column, side: int = 8) -> Column:
    return median(F.transform(diagonal_band(gray, side), lambda v: F.abs(v))) / 0.6745


def halved(gray: Column, side: int = 8) -> Column:
    return _blocks(gray, side, lambda a, b, c, d: (a + b + c + d) / 4)


def grain_ratio(gray: Column, side: int = 8) -> Column:
    """Finest detail against the edges that survive halving; 0 where there is neither."""
    measured = F.struct(noise_sigma(gray, side).alias("fine"), F.sqrt(laplacian_variance(halved(gray, side), side // 2)).alias("structure"))
    return let(measured, lambda m: F.when((m["fine"] > 0) & (m["structure"] > 1e-5), m["fine"] / m["structure"]).otherwise(0.0))


def colorfulness(red: Column, green: Column, blue: Column) -> Column:
    rg = F.zip_with(red, green, lambda r, g: r * 255 - g * 255)
    half = F.zip_with(red, green, lambda r, g: 0.5 * (r * 255 + g * 255))
    yb = F.zip_with(half, blue, lambda s, b: s - b * 255)
    square = lambda x: x * x
    both = F.struct(rg.alias("rg"), yb.alias("yb"))
    strength = lambda c: F.sqrt(variance(c["rg"]) + variance(c["yb"])) + 0.3 * F.sqrt(let(mean(c["rg"]), square) + let(mean(c["yb"]), square))
    return let(both, strength)


def entropy(gray: Column) -> Column:
    """Bits of the 64-bin histogram over 0..1; values outside do not count, 1 is in the last bin."""
    bins = F.transform(F.filter(gray, lambda v: (v >= 0) & (v <= 1)), lambda v: F.least(F.lit(BINS - 1), F.floor(v * BINS).cast("int")))

    def bits(b: Column) -> Column:
        share = lambda k: F.size(F.filter(b, lambda x: x == k)) / F.size(b)
        return F.aggregate(F.sort_array(F.array_distinct(b)), F.lit(0.0), lambda s, k: s - share(k) * F.log2(share(k)))

    return let(bins, bits)


def share(gray: Column, test) -> Column:
    return F.size(F.filter(gray, test)) / F.size(gray)


def raw_metrics(gray: Column, red: Column, green: Column, blue: Column, megapixels: Column, side: int = 8) -> dict[str, Column]:
    return {
        "edge_strength": edge_strength(gray, side),
        "laplacian_variance": laplacian_variance(gray, side),
        "mean_luma": mean(gray),
        "shadow_clip": share(gray, lambda v: v < 0.02),
        "highlight_clip": share(gray, lambda v: v > 0.98),
        "contrast_std": F.sqrt(variance(gray)),
        "colorfulness": colorfulness(red, green, blue),
        "noise_sigma": noise_sigma(gray, side),
        "grain_ratio": grain_ratio(gray, side),
        "megapixels": megapixels,
        "entropy": entropy(gray),
    }


def metrics(raw: Column) -> dict[str, Column]:
    """The seven metrics, 0 to 1, from a struct of raw measures."""
    clip = clamp(2.2 * F.greatest(F.lit(0.0), raw["highlight_clip"] - 0.015) + 1.2 * F.greatest(F.lit(0.0), raw["shadow_clip"] - 0.02))
    return {
        "sharpness": log_ramp(raw["edge_strength"], 0.10, 0.62),
        "exposure": clamp(plateau(raw["mean_luma"], 0.34, 0.62, 0.34) * (1 - clip)),
        "contrast": plateau(raw["contrast_std"], 0.16, 0.32, 0.20),
        "colorfulness": clamp(raw["colorfulness"] / 70.0),
        "noise": 1 - log_ramp(raw["grain_ratio"], 0.09, 0.22),
        "resolution": log_ramp(F.greatest(raw["megapixels"], F.lit(1e-6)), 0.3, 24.0),
        "detail": clamp(raw["entropy"] / 5.6),
    }


def flags(raw: Column, measured: Column, iso: Column) -> Column:
    """Findings in a fixed order."""
    said = [
        (raw["mean_luma"] < 0.16, F.lit("dark")),
        (raw["mean_luma"] > 0.82, F.lit("bright")),
        (raw["highlight_clip"] > 0.12, F.lit("blown highlights")),
        (raw["contrast_std"] < 0.055, F.lit("flat")),
        ((raw["grain_ratio"] > 0.17) & (raw["noise_sigma"] > 0.008), F.lit("noisy")),
        (raw["entropy"] < 2.0, F.lit("empty")),
        (measured["sharpness"] < 0.22, F.lit("blurry")),
        (iso > 3200, F.concat(F.lit("ISO "), iso.cast("string"))),
    ]
    return F.array_compact(F.array(*[F.when(test, text) for test, text in said]))


def metrics_json(measured: Column) -> Column:
    """The metrics as a JSON object; an empty one where there are none."""
    return F.coalesce(F.to_json(measured), F.lit("{}"))


def metrics_from_json(text: Column) -> Column:
    """Metrics of a JSON object; those that are missing or no numbers, or all of a text that is no object, are null."""
    return F.from_json(text, "struct<" + ",".join(f"{m}:double" for m in METRICS) + ">")


def weighted(measured: Column, weights: Weights) -> Column:
    """The weighted sum of metrics, a missing one as 0, in their fixed order."""
    shares = weights.normalised()
    out = F.lit(0.0)
    for m in METRICS:
        out = out + F.lit(shares[m]) * F.coalesce(measured[m], F.lit(0.0))
    return out


def score(measured: Column, iso: Column, weights: Weights | None = None) -> Column:
    """0 to 100, less 3 % above ISO 3200, to two digits half up."""
    whole = weighted(measured, weights or Weights()) * F.when(iso > 3200, 0.97).otherwise(1.0)
    return F.floor(clamp(whole) * 100 * 100 + 0.5) / 100


def rescore(measured: Column, weights: Weights) -> Column:
    """As ``score``, from stored metrics only: without the ISO factor."""
    return F.floor(clamp(weighted(measured, weights)) * 100 * 100 + 0.5) / 100

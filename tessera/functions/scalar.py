"""Scalar functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(x: Column | float) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def sha_hex(text: Column) -> Column:
    return F.sha2(text.cast("string"), 256)


def hash_fraction(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256 as a fraction of 16**16, in [0, 1)."""
    return F.conv(F.substring(sha_hex(text), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def hash_bucket(text: Column, buckets: int) -> Column:
    """The first 8 hex digits of the SHA-256 modulo buckets."""
    return stable_seed(text) % F.lit(buckets)


def stable_seed(text: Column) -> Column:
    return F.conv(F.substring(sha_hex(text), 1, 8), 16, 10).cast("bigint")


def slug(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def humanise(name: Column) -> Column:
    """Underscores as spaces, first letter upper case."""
    spaced = F.regexp_replace(name, "_", " ")
    return F.concat(F.upper(F.substring(spaced, 1, 1)), spaced.substr(F.lit(2), F.length(spaced)))


def decision(category: str, score: Column, threshold: float) -> Column:
    return F.when(score >= F.lit(float(threshold)), F.lit(f"likely {category}")).otherwise(F.lit(f"unlikely {category}"))


def canonical_text(text: Column) -> Column:
    """The text provider's canonical form: trimmed, lower case, white space as one blank."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def gaussian(x: Column, mean: float, deviation: float) -> Column:
    z = (as_double(x) - F.lit(float(mean))) / F.lit(float(deviation))
    return F.exp(F.lit(-0.5) * z * z)


def half_gaussian(x: Column, mean: float, low: float, high: float, floor: float = 1e-12) -> Column:
    """A Gaussian with one deviation below the mean and another above it."""
    x = as_double(x)
    z = F.when(x < F.lit(float(mean)), (x - F.lit(float(mean))) / F.lit(float(low))).otherwise((x - F.lit(float(mean))) / F.lit(float(high)))
    return F.greatest(F.exp(F.lit(-0.5) * z * z), F.lit(floor))


def double_exponential(x: Column, offset: float, scale: float, centre: float, width: float, peak: float) -> Column:
    """Asymmetric desirability: (o + a * exp(1 - exp(-u) - u)) / peak with u = (x - b) / c."""
    u = (as_double(x) - F.lit(float(centre))) / F.lit(float(width))
    return (F.lit(float(offset)) + F.lit(float(scale)) * F.exp(-F.exp(-u) - u + F.lit(1.0))) / F.lit(float(peak))


def geometric_mean(values: list[Column]) -> Column:
    """0 if any value is not positive and finite."""
    good = F.lit(True)
    total = F.lit(0.0)
    for v in values:
        good = good & (v > 0) & ~F.isnan(v) & (v < F.lit(float("inf")))
        total = total + F.ln(F.when(v > 0, v).otherwise(F.lit(1.0)))
    return F.when(good, F.exp(total / F.lit(float(len(values))))).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column, empty: float) -> Column:
    """Of two arrays as sets; `empty` where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(float(empty))).otherwise(F.size(F.array_intersect(a, b)).cast("double") / union)


def smoothed_enrichment(positive: Column, positives: Column, negative: Column, negatives: Column, add: float = 0.5, total: float = 1.0) -> Column:
    """(hits + add) / (n + total) of the positives over the same of the negatives."""
    rate = lambda hits, n: (hits + F.lit(add)) / (n + F.lit(total))
    return rate(positive, positives) / rate(negative, negatives)

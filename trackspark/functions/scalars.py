"""Scalar rules: folds, probabilities, budgets, text slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackspark.schema import BUDGET_ALPHA


def embryo(name: Column) -> Column:
    return F.split_part(name, F.lit("_"), F.lit(1))


def hash_fold(name: Column, k: Column) -> Column:
    """SHA-1 of the name, read as one base-16 integer, modulo ``k`` (Horner's rule)."""
    digits = F.split(F.sha1(name), "")
    k = k.cast("bigint")
    return F.aggregate(
        digits, F.lit(0).cast("bigint"),
        lambda acc, d: F.when(d == "", acc).otherwise(
            (acc * 16 + F.conv(d, 16, 10).cast("bigint")) % k),
    )


def sanitise_probability(p: Column) -> Column:
    """Non-finite or missing -> 0; outside [0, 1] -> logistic of the clamped value."""
    clamped = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), p))
    logistic = F.lit(1.0) / (F.lit(1.0) + F.exp(-clamped))
    finite = p.isNotNull() & ~F.isnan(p) & (F.abs(p) != F.lit(float("inf")))
    return (F.when(~finite, F.lit(0.0))
            .when((p < 0.0) | (p > 1.0), logistic)
            .otherwise(p))


def link_threshold(jaccard: Column) -> Column:
    """A link pays off when its probability exceeds J / (1 + J)."""
    return jaccard / (F.lit(1.0) + jaccard)


def budget_multiplier(ratio: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(BUDGET_ALPHA) * ratio)


def clip_prior(p: Column, high: float = 0.95) -> Column:
    return F.least(F.greatest(p, F.lit(1e-4)), F.lit(high))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def log_feature(name: str) -> Column:
    """Counts (``n…``) enter as log1p, intensity fractions as a floored log."""
    col = F.col(name).cast("double")
    return F.log1p(col) if name.startswith("n") else F.log(F.greatest(col, F.lit(1e-6)))


def sampled_frames(n_t: Column, fractions=(0.25, 0.5, 0.75)) -> Column:
    """Distinct frame numbers at the given fractions of a movie, half-even rounded."""
    picks = [
        F.least(n_t - 1, F.greatest(F.lit(0), F.rint(F.lit(float(f)) * n_t).cast("bigint")))
        for f in fractions
    ]
    return F.array_sort(F.array_distinct(F.array(*picks)))


def slugify(text: Column, limit: int = 60) -> Column:
    base = F.when(text.isNull() | (text == ""), F.lit("untitled")).otherwise(text)
    hyphenated = F.regexp_replace(F.lower(base), "[^a-z0-9]+", "-")
    trimmed = F.regexp_replace(hyphenated, "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(trimmed, 1, limit), "-+$", "")
    return F.when(cut == "", F.lit("untitled")).otherwise(cut)


def escape_pipes(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def score_text(value: Column) -> Column:
    """Four decimals, or ``nan`` when missing."""
    return F.coalesce(F.format_string("%.4f", value), F.lit("nan"))

"""Numeric and array column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Category groups and the facts each group is described by.
CATEGORY_SUBSETS = {
    "meat": [
        "Bacon", "Bratwurst", "Breakfast_Sausages", "Burgers", "Chicken_Strips",
        "Breaded_Chicken_Filet", "Unbreaded_Chicken_Breast", "Deli_Ham", "Deli_Turkey",
        "Hot_Dogs", "Meatballs", "Nuggets", "Pulled_Pork", "Steak",
    ],
    "nonsweet_dairy": ["Butter", "Cream_Cheese", "Sour_Cream", "Creamer", "Milk", "Barista_Milk"],
    "cheese": ["Cheddar_Cheese", "Mozzarella"],
    "sweet_dairy": ["Ice_Cream_Hard_Serve", "Yogurt"],
}
# Factors to grams.
TO_GRAMS = {"mg": 0.001, "mcg": 0.000001, "g": 1.0}


def round_half_even(c: Column, digits: int) -> Column:
    """scale, round ties to even, scale back, as array libraries do."""
    f = F.lit(float(10 ** digits))
    return F.rint(c * f) / f


def one_decimal(x: Column) -> Column:
    """Text with one decimal, decided by the exact binary value; exact ties go to even."""
    k = F.rint(x * F.lit(20.0))
    low = F.floor(k / 2).cast("double")
    past = (k - x * F.lit(16.0)) - x * F.lit(4.0)  # k - 20 x without rounding
    near_tie = (F.when(past < 0, low + 1).when(past > 0, low)
                .otherwise(F.when(low % 2 == 0, low).otherwise(low + 1)))
    return F.format_string("%.1f", F.when(k % 2 == 0, k / 2).otherwise(near_tie) / F.lit(10.0))


def inverse_rank_weights(n: Column) -> Column:
    """1/(i+1) for i < n, scaled to sum one."""
    raw = F.transform(F.sequence(F.lit(1), n), lambda i: F.lit(1.0) / i)
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 0, F.transform(raw, lambda x: x / total)).otherwise(F.array().cast("array<double>"))


def one_hot(c: Column, levels: Sequence) -> Column:
    """Indicator array; NULL for a value outside the levels."""
    levels = list(levels)
    return F.when(c.isin(levels), F.array(*[F.when(c == v, 1.0).otherwise(0.0) for v in levels]))


def per_100g(facts: Sequence[tuple[Column, str]], serving: Column, fill: float | None = 0.0) -> Column:
    """X11: facts (column, unit) per 100 g in grams; NULL item if every fact is unknown."""
    scale = F.when(serving > 0, F.lit(100.0) / serving).otherwise(F.lit(1.0))
    vals = [c * scale * F.lit(TO_GRAMS[u]) for c, u in facts]
    if fill is not None:
        vals = [F.coalesce(v, F.lit(fill)) for v in vals]
    unknown = F.lit(True)
    for c, _ in facts:
        unknown = unknown & c.isNull()
    return F.when(~unknown, F.array(*vals))


def by_subset(c: Column, vectors: Mapping[object, Column]) -> Column:
    """Pick the vector of the subset a row belongs to; NULL without a subset."""
    out = F.lit(None)
    for name, v in vectors.items():
        out = F.coalesce(F.when(c == name, v), out)
    return out


def subset_of(category: Column, subsets: Mapping[str, Sequence] = CATEGORY_SUBSETS) -> Column:
    cases = F.lit(None).cast("string")
    for name, cats in subsets.items():
        cases = F.coalesce(F.when(category.isin(list(cats)), F.lit(name)), cases)
    return cases


def intervals_overlap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Closed intervals; an unknown bound never overlaps."""
    known = lo_a.isNotNull() & hi_a.isNotNull() & lo_b.isNotNull() & hi_b.isNotNull()
    return F.coalesce(known & (F.greatest(lo_a, lo_b) <= F.least(hi_a, hi_b)), F.lit(False))


def expit(z: Column) -> Column:
    """X16"""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def log_weight(c: Column, floor: float = 1e-6) -> Column:
    """log1p of the non-negative value plus a floor; unknown counts as zero."""
    return F.log1p(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))) + F.lit(floor)

"""String and JSON column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from prefrank.functions.numeric import one_decimal

# Processing words that are dropped from a component name before matching.
MODIFIERS = [
    "Isolate", "Concentrate", "Extract", "Powder", "Flour", "Starch",
    "Modified", "Hydrolyzed", "Textured", "Vital", "Refined", "Enriched",
    "Expeller Pressed", "Expeller-Pressed", "Cold Pressed", "Virgin",
    "Extra Virgin", "High Oleic", "Low Erucic Acid", "Hydrogenated",
    "Defatted", "Dried", "Fermented", "Autolyzed", "Inactive",
    "Filtered", "Purified", "Distilled", "Rehydrated", "Toasted",
    "Roasted", "Ground", "Whole Grain", "Whole", "Raw",
]
# Name prefixes and suffixes stripped to make further aliases.
STRIP_PREFIXES = [
    "ground ", "raw ", "dried ", "dehydrated ", "fresh ", "whole ",
    "organic ", "natural ", "refined ", "crude ", "powdered ",
    "frozen ", "cooked ", "roasted ", "toasted ", "fermented ",
]
STRIP_SUFFIXES = [
    " powder", " extract", " concentrate", " isolate", " puree",
    " paste", " juice", " oil", " flour", " starch", " fiber",
    " seed", " seeds", " kernel", " kernels", " flakes",
]
# Words that mark an animal ingredient.
ANIMAL_WORDS = [
    "beef", "pork", "chicken", "turkey", "lamb", "fish", "salmon",
    "shrimp", "milk", "cream", "butter", "cheese", "whey",
    "casein", "lactose", "gelatin", "lard", "tallow",
]
# Fixed value: a brand name in front of the first colon.
BRAND_PREFIX = r"^[A-Za-z][A-Za-z\s'’.&®™️()-]*?:\s*"


def pipe_list(c: Column) -> Column:
    """X1: 'a | b |' -> [a, b]."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def ingredient_set(c: Column) -> Column:
    """Drop (...) parts, split at commas, lower, trim, keep tokens longer than one letter, once each."""
    flat = F.regexp_replace(F.coalesce(c, F.lit("")), r"\([^)]*\)", "")
    return F.array_distinct(F.filter(
        F.transform(F.split(flat, ","), lambda x: F.lower(F.trim(x))), lambda x: F.length(x) > 1))


def strip_brand(c: Column) -> Column:
    """X5"""
    return F.regexp_replace(c, BRAND_PREFIX, "")


def strip_marks(c: Column) -> Column:
    """Trademark signs out, one pass of double spaces to single ones."""
    return F.replace(F.translate(c, "™®©", ""), F.lit("  "), F.lit(" "))


def title_caps(c: Column, longer_than: int = 20) -> Column:
    """Long ALL-CAPS text to title case; a letter after any non-letter is a capital."""
    low = F.lower(c)
    chars = F.split(low, "")
    titled = F.array_join(F.transform(
        chars, lambda ch, i: F.when((i > 0) & F.element_at(chars, F.greatest(i, F.lit(1))).rlike(r"\p{L}"), ch)
        .otherwise(F.upper(ch))), "")
    return F.when((c == F.upper(c)) & (F.length(c) > longer_than), titled).otherwise(c)


def animal_hits(c: Column, words: Sequence[str] = ANIMAL_WORDS) -> Column:
    """comma tokens that are animal words."""
    tokens = F.transform(F.split(F.lower(c), ","), lambda x: F.trim(x))
    return F.array_sort(F.array_intersect(tokens, F.array(*[F.lit(w) for w in words])))


def jaccard(a: Column, b: Column) -> Column:
    """X10"""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def name_variants(name: Column) -> Column:
    """The spellings an entity name answers to; [] for blank and URI names."""
    s = F.lower(F.trim(name))

    def keep(cond: Column, value: Column) -> Column:
        return F.when(cond, value)

    bare = F.trim(F.regexp_replace(s, r"\s*\([^)]*\)\s*", " "))
    out = [s, keep((bare != "") & (bare != s), bare),
           keep(s.endswith(" food product"), F.trim(F.regexp_replace(s, " food product$", "")))]
    for p in STRIP_PREFIXES:
        rest = F.trim(F.substr(s, F.lit(len(p) + 1)))
        out.append(keep(s.startswith(p) & (F.length(rest) > 2), rest))
    for p in STRIP_SUFFIXES:
        head = F.trim(F.regexp_replace(s, f"{p}$", ""))
        out.append(keep(s.endswith(p) & (F.length(head) > 2), head))
    out.append(keep(s.contains("-"), F.replace(s, F.lit("-"), F.lit(" "))))
    out.append(keep(s.contains(" "), F.replace(s, F.lit(" "), F.lit("-"))))
    n = F.length(s)
    out.append(
        F.when(s.endswith("ies"), F.concat(F.substr(s, F.lit(1), n - 3), F.lit("y")))
        .when(s.endswith("es") & (n > 3), F.substr(s, F.lit(1), n - 2))
        .when(s.endswith("s") & (n > 2) & ~s.endswith("ss"), F.substr(s, F.lit(1), n - 1))
        .when(s.rlike("[^aeiou]y$"), F.concat(F.substr(s, F.lit(1), n - 1), F.lit("ies")))
        .when(s.rlike("(s|x|ch|sh|z)$"), F.concat(s, F.lit("es")))
        .otherwise(F.concat(s, F.lit("s"))))
    uri = s.rlike("^<.*>$") | s.startswith("http://") | s.startswith("https://")
    return F.when(s.isNull() | (s == "") | uri, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.array_compact(F.array(*out))))


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def match_candidates(name: Column) -> Column:
    """[name without modifiers, name without 'protein', last word], in match order."""
    bare = name
    for word in MODIFIERS:
        bare = F.regexp_replace(bare, rf"(?i)\b{word}\b", "")
    bare = F.lower(_squeeze(bare))
    no_protein = F.lower(_squeeze(F.regexp_replace(name, r"(?i)\bprotein\b", "")))
    words = F.split(_squeeze(name), " ")
    last = F.when(F.size(words) > 1, F.lower(F.element_at(words, -1)))
    return F.array_compact(F.array(
        F.when(bare != "", bare), F.when(no_protein != "", no_protein), last))


def parse_answer(text: Column) -> Column:
    """Last '1' or '2' of the last non-empty line, else of the first line."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    last, first = F.try_element_at(lines, F.lit(-1)), F.try_element_at(lines, F.lit(1))
    return F.coalesce(*[F.nullif(F.regexp_extract(x, r"([12])[^12]*$", 1), F.lit("")) for x in (last, first)])


def nutrition_text(serving: Column, facts: Sequence[tuple[str, str, Column]]) -> Column:
    """X19: 'Name: 1.2g, ...' per 100 g; empty without a serving size; zero and unknown facts left out."""
    parts = []
    for name, unit, c in facts:
        scaled = c * (F.lit(100.0) / serving)
        parts.append(F.when(c.isNotNull() & (c != 0), F.concat(F.lit(f"{name}: "), one_decimal(scaled), F.lit(unit))))
    return F.when(serving.isNull() | (serving <= 0), F.lit("")).otherwise(F.concat_ws(", ", *parts))


def parse_json_or(c: Column, schema: str, default: Column) -> Column:
    """JSON text column; bad JSON gives the default."""
    return F.coalesce(F.from_json(c, schema), default)

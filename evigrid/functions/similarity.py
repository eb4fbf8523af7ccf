"""Similarities of token sets, positions and tools, and the composite alignment score."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Weights of the lexical composite (tokens, position, tools).
LEXICAL_WEIGHTS = (0.5, 0.3, 0.2)
#: Weights of the semantic composite (lexical, semantic, position, tools).
SEMANTIC_WEIGHTS = (0.35, 0.25, 0.25, 0.15)
EPSILON = 1e-9


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Overlap of two distinct-valued arrays over their union; 0 if one is empty, ``both_empty`` if both are."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, F.lit(both_empty)).otherwise(shared / total)


def token_similarity(a: Column, b: Column) -> Column:
    """1 if equal, .92 if one of at least five letters begins the other, else 1 - distance/length from .82 on."""
    longest = F.greatest(F.length(a), F.length(b))
    near = 1 - F.levenshtein(a, b) / longest
    return (
        F.when(a == b, 1.0)
        .when((F.length(a) >= 5) & (F.length(b) >= 5) & (a.startswith(b) | b.startswith(a)), 0.92)
        .when(near >= 0.82, near)
        .otherwise(0.0)
    )


def soft_jaccard(a: Column, b: Column) -> Column:
    """Each token of the smaller set takes its most similar unused partner, in order; the sum counts as overlap."""
    small, large = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    zero = F.struct(F.lit(0.0).cast("double").alias("sum"), F.array().cast("array<int>").alias("used"))

    def take(acc: Column, token: Column) -> Column:
        options = F.transform(large, lambda t, i: F.struct(F.when(F.array_contains(acc["used"], i), F.lit(0.0)).otherwise(token_similarity(token, t)).alias("s"), (-i).alias("i")))
        best = F.array_max(options)
        hit = best["s"] > 0
        return F.struct((acc["sum"] + F.when(hit, best["s"]).otherwise(0.0)).alias("sum"), F.when(hit, F.array_append(acc["used"], -best["i"])).otherwise(acc["used"]).alias("used"))

    shared = F.aggregate(small, zero, take)["sum"]
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def position_score(i: Column, n: Column, j: Column, m: Column) -> Column:
    """Closeness of two relative positions (1-based); a list of one stands in the middle."""
    here = lambda x, size: F.when(size <= 1, 0.5).otherwise((x - 1) / F.nullif(size - 1, F.lit(0)))
    return 1 - F.abs(here(i, n) - here(j, m))


def composite(lexical: Column, position: Column, tools: Column, semantic: Column | None = None) -> Column:
    a, b, c = LEXICAL_WEIGHTS
    plain = a * lexical + b * position + c * tools
    if semantic is None:
        return plain
    a, b, c, d = SEMANTIC_WEIGHTS
    return F.greatest(a * lexical + b * semantic + c * position + d * tools, plain)

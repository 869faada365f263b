"""Roles, buckets and the pair scores, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Role names in histogram order, and the three whose values can match another table's.
ROLES = (
    "IDENTIFIER",
    "JOIN_CODE",
    "FOREIGN_KEY_CANDIDATE",
    "CATEGORY",
    "MEASURE",
    "FREE_TEXT",
    "TEMPORAL",
    "FLAG",
)
JOIN_ROLES = ("JOIN_CODE", "FOREIGN_KEY_CANDIDATE", "CATEGORY")

# Sketch size, score weights and thresholds.
SKETCH_SIZE = 128
SEMANTIC_WEIGHT = 0.7
STRUCT_WEIGHT = 0.3
TOP_KEYS = 3
STRONG_KEY = 0.5
PRIOR_FLOOR = 0.5
TYPE_MISMATCH = 0.7
CARDINALITY_BOUNDS = (0.1, 0.5, 0.9)
LENGTH_BOUNDS = (5, 30)


def bucket(value: Column, bounds: tuple[float, ...]) -> Column:
    """Index of the right-closed bucket `value` falls in."""
    out = F.lit(len(bounds))
    for i, bound in reversed(list(enumerate(bounds))):
        out = F.when(value <= bound, i).otherwise(out)
    return out


def cardinality_bucket(ratio: Column) -> Column:
    """P16."""
    return bucket(ratio, CARDINALITY_BOUNDS)


def length_bucket(length: Column) -> Column:
    """P17."""
    return bucket(length, LENGTH_BOUNDS)


def fixed_length(type_class: Column, len_min: Column, len_max: Column) -> Column:
    """A text column whose words all have one and the same, positive length."""
    return F.coalesce((type_class == "string") & (len_min == len_max) & (len_min > 0), F.lit(False))


def cardinality_ratio(cardinality: Column, row_count: Column) -> Column:
    """P15."""
    return F.coalesce(F.try_divide(cardinality.cast("double"), row_count.cast("double")), F.lit(0.0))


def classify(
    type_class: Column,
    is_binary: Column,
    uniqueness: Column,
    cardinality: Column,
    row_count: Column,
    val_pct_max: Column,
    len_min: Column,
    len_max: Column,
    len_avg: Column,
    words_avg: Column,
) -> Column:
    """The role of a column; the first rule that holds decides."""

    def known(c: Column) -> Column:
        return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))

    numeric = type_class == "numeric"
    unique = known(uniqueness) > 0.95
    wordy = (known(len_avg) > 30) | (known(words_avg) > 3)
    dominated = known(val_pct_max) > 0.3
    return (
        F.when(type_class == "date", "TEMPORAL")
        .when(known(is_binary) == 1, "FLAG")
        .when(unique & numeric, "IDENTIFIER")
        .when(unique & wordy, "FREE_TEXT")
        .when(unique, "JOIN_CODE")
        .when(numeric & (dominated | (known(cardinality) < 50)), "CATEGORY")
        .when(numeric, "MEASURE")
        .when(fixed_length(type_class, len_min, len_max), "JOIN_CODE")
        .when(dominated | (cardinality_ratio(known(cardinality), row_count) < 0.10), "CATEGORY")
        .when(wordy, "FREE_TEXT")
        .otherwise("FOREIGN_KEY_CANDIDATE")
    )


def join_eligible(role: Column, type_class: Column, n: Column) -> Column:
    """P10."""
    return role.isin(*JOIN_ROLES) & ~((role == "CATEGORY") & (type_class == "numeric")) & (n > 0)


def containment(
    sig_a: Column, n_a: Column, sig_b: Column, n_b: Column, k: int = SKETCH_SIZE
) -> Column:
    """Containment of the smaller set, estimated from two bottom-k sketches."""
    union = F.slice(F.array_sort(F.array_union(sig_a, sig_b)), 1, k)
    shared = F.array_intersect(union, F.array_intersect(sig_a, sig_b))
    jaccard = F.try_divide(F.size(shared).cast("double"), F.size(union).cast("double"))
    common = jaccard * (n_a + n_b) / (F.lit(1.0) + jaccard)
    best = F.greatest(F.try_divide(common, n_a.cast("double")), F.try_divide(common, n_b.cast("double")))
    usable = (F.size(sig_a) > 0) & (F.size(sig_b) > 0) & (n_a > 0) & (n_b > 0)
    return F.when(usable, F.least(F.lit(1.0), best)).otherwise(0.0)


def containment_of_matches(
    ranks: Column, size_a: Column, n_a: Column, size_b: Column, n_b: Column, k: int = SKETCH_SIZE
) -> Column:
    """J1 for sketches that share a hash, from `ranks`: each shared hash's rank in one sketch plus that in the other, counted from 1.

    In rising order, the i-th shared hash has rank_a + rank_b - i hashes of the union up to itself, so it belongs to the union's own
    sketch exactly if that is k at most. No sketch has to travel with the pair.
    """
    union = F.least(F.lit(k), size_a + size_b - F.size(ranks))
    shared = F.size(F.filter(F.array_sort(ranks), lambda x, i: x - (i + 1) <= k))
    jaccard = F.try_divide(shared.cast("double"), union.cast("double"))
    common = jaccard * (n_a + n_b) / (F.lit(1.0) + jaccard)
    best = F.greatest(F.try_divide(common, n_a.cast("double")), F.try_divide(common, n_b.cast("double")))
    return F.when((n_a > 0) & (n_b > 0), F.least(F.lit(1.0), best)).otherwise(0.0)


def length_compat(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    """Overlap of two length ranges, mapped to [PRIOR_FLOOR, 1]; 1 where a range is unknown."""
    overlap = F.greatest(F.lit(0), F.least(a_max, b_max) - F.greatest(a_min, b_min))
    span = F.greatest(a_max, b_max) - F.least(a_min, b_min)
    share = F.when(span <= 0, 1.0).otherwise(F.try_divide(overlap.cast("double"), span.cast("double")))
    unknown = (
        a_min.isNull() | a_max.isNull() | b_min.isNull() | b_max.isNull()
        | (a_max < a_min) | (b_max < b_min)
    )
    return F.when(unknown, 1.0).otherwise(PRIOR_FLOOR + (1.0 - PRIOR_FLOOR) * share)


def joinable_prior(
    a_type: Column, a_min: Column, a_max: Column, b_type: Column, b_min: Column, b_max: Column
) -> Column:
    """J3."""
    same = F.when(a_type == b_type, 1.0).otherwise(TYPE_MISMATCH)
    return same * length_compat(a_min, a_max, b_min, b_max)


def noisy_or(scores: Column) -> Column:
    """1 - Π(1 - j) over an array of scores (strongest first, the caller slices)."""
    return F.lit(1.0) - F.aggregate(scores, F.lit(1.0), lambda acc, j: acc * (F.lit(1.0) - j))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of the same length."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def vector_literal(vec: list[float]) -> Column:
    """A vector held by the driver as one constant."""
    return F.expr(f"array({', '.join(f'{float(x)!r}D' for x in vec)})")


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, never below 0, and 0 where one is missing."""
    return F.coalesce(F.greatest(F.lit(0.0), dot(a, b)), F.lit(0.0))


def unit(vec: Column) -> Column:
    """E5: the vector divided by its length; the zero vector stays zero."""
    # The length is repeated next to the elements so that it is computed once, not per element.
    norms = F.array_repeat(F.sqrt(dot(vec, vec)), F.size(vec))
    return F.zip_with(
        vec, norms, lambda x, norm: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0)
    )


def similarity_block(semantic: Column, structural: Column) -> Column:
    """J14."""
    return SEMANTIC_WEIGHT * semantic + STRUCT_WEIGHT * structural


def similarity(joinability: Column, block: Column) -> Column:
    """J15."""
    return F.sqrt(F.greatest(F.lit(0.0), joinability) * F.greatest(F.lit(0.0), block))

"""Table profile: one row per table from the column profile (which has one row per column)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.functions.scores import ROLES, cardinality_bucket, length_bucket
from tablescout.functions.text import name_tokens, number_or


def _hist(conditions: list[Column]) -> Column:
    return F.array(*[F.count_if(c) for c in conditions])


def macro_means(profile: DataFrame) -> DataFrame:
    """T1."""
    return profile.groupBy("table_name").agg(*_means())


def _means() -> list[Column]:
    return [
        number_or(F.avg("incompleteness")).alias("null_ratio"),
        number_or(F.avg("cardinality")).alias("cardinality"),
        number_or(F.avg("val_pct_max")).alias("val_pct_max"),
        number_or(F.avg("len_avg_word")).alias("avg_string_length"),
    ]


def type_fractions(profile: DataFrame) -> DataFrame:
    """T2."""
    return profile.groupBy("table_name").agg(*_fractions())


def _fractions() -> list[Column]:
    return [
        F.avg((F.col("type_class") == t).cast("double")).alias(f"type_{t}_frac")
        for t in ("numeric", "string", "date")
    ]


def row_count_recovery(profile: DataFrame) -> DataFrame:
    """The row count as it can be read back from cardinality and uniqueness."""
    back = F.round(F.try_divide(F.col("cardinality").cast("double"), F.col("uniqueness")))
    return profile.groupBy("table_name").agg(
        F.coalesce(F.max(F.when(F.col("uniqueness") > 0, back)), F.lit(0.0)).cast("bigint")
        .alias("row_count")
    )


def role_histogram(profile: DataFrame) -> Column:
    """T5."""
    return _hist([F.col("role") == r for r in ROLES])


def cardinality_histogram() -> Column:
    """T6."""
    b = cardinality_bucket(F.col("cardinality_ratio"))
    return _hist([b == i for i in range(4)])


def length_histogram() -> Column:
    """By average word length, text columns only."""
    b = length_bucket(F.col("len_avg_word"))
    return _hist([(F.col("type_class") == "string") & (b == i) for i in range(3)])


def structural_vector(*histograms: Column) -> Column:
    """Every histogram divided by its sum, joined, and the whole divided by its length."""

    def shares(h: Column) -> Column:
        total = F.aggregate(h, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
        # The sum is repeated next to the bins so that it is computed once per histogram.
        return F.zip_with(
            h, F.array_repeat(total, F.size(h)),
            lambda x, s: F.when(s > 0, x.cast("double") / s.cast("double")).otherwise(0.0),
        )

    from tablescout.functions.scores import unit

    return unit(F.concat(*[shares(h) for h in histograms]))


def table_profile(profile: DataFrame) -> DataFrame:
    """T1-T10 in one aggregation; the groups are as large as the tables are wide."""
    in_order = F.array_sort(F.collect_list(F.struct("column_pos", "column_name")))
    tokens = F.flatten(F.collect_list(name_tokens(F.col("column_name"))))
    base = profile.groupBy("table_name").agg(
        F.max("row_count").alias("row_count"),
        F.count("*").alias("col_count"),
        in_order.alias("_names"),
        F.array_sort(F.array_distinct(tokens)).alias("col_name_tokens"),
        *_means(),
        *_fractions(),
        role_histogram(profile).alias("role_hist"),
        cardinality_histogram().alias("cardinality_hist"),
        length_histogram().alias("length_hist"),
    )
    return base.select(
        "table_name", "row_count", "col_count",
        F.col("_names.column_name").alias("col_names"),
        "col_name_tokens", "null_ratio", "cardinality", "val_pct_max", "avg_string_length",
        "type_numeric_frac", "type_string_frac", "type_date_frac",
        F.map_from_arrays(F.array(*map(F.lit, ROLES)), "role_hist").alias("role_counts"),
        "cardinality_hist", "length_hist",
        structural_vector(F.col("role_hist"), F.col("cardinality_hist"), F.col("length_hist"))
        .alias("struct_vec"),
    )

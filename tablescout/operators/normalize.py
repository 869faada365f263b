"""Z-scored and typed column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.operators.profile import NUMERIC_METRICS, SET_METRICS, TEXT_METRICS, ZSCORED_METRICS


def zscore_profiles(profile: DataFrame) -> DataFrame:
    """Each z-scored metric minus its mean, over its sample deviation; 0 where undefined."""
    moments = profile.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in ZSCORED_METRICS],
        *[F.stddev_samp(c).alias(f"{c}_sd") for c in ZSCORED_METRICS],
    ).first()

    def z(c: str):
        mean, sd = moments[f"{c}_mean"], moments[f"{c}_sd"]
        if mean is None or not sd:
            return F.lit(0.0)
        return F.coalesce((F.col(c).cast("double") - mean) / sd, F.lit(0.0))

    return profile.withColumns({c: z(c) for c in ZSCORED_METRICS})


def preprocess_profiles(profile: DataFrame) -> DataFrame:
    """Numeric metrics as doubles, common values as sets, boundary values as text."""
    return profile.withColumns({
        **{c: F.col(c).try_cast("double") for c in NUMERIC_METRICS},
        **{c: F.coalesce(F.array_sort(F.array_distinct(c)), F.array().cast("array<string>")) for c in SET_METRICS},
        **{c: F.col(c).cast("string") for c in TEXT_METRICS},
    })

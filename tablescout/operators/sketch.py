"""Bottom-k sketches, and the join-column metaprofiles built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.functions.scores import SKETCH_SIZE, join_eligible
from tablescout.functions.text import normalise_value
from tablescout.operators.counts import COLUMN_KEY, top_per_group
from tablescout.workspace import materialize

HASH_CHARS = 16
# How many hashes more than a sketch holds are kept before they are sorted: of 128, fewer are left with a chance of less than 1e-20.
MARGIN = 176


def value_hashes(raw_counts: DataFrame) -> DataFrame:
    """The normalised value of every row as MD5, and whether another value of the column may have the same: (column_id, h, changed)."""
    normal = normalise_value(F.col("v"))
    h = F.coalesce(F.col("long.s_md5"), F.md5(normal))
    return raw_counts.where(F.col("v").isNotNull()).select(
        *COLUMN_KEY, h.alias("h"), (F.col("long").isNotNull() | (normal != F.col("v"))).alias("changed"))


def minhash(raw_counts: DataFrame, k: int = SKETCH_SIZE) -> DataFrame:
    """(column_id, sig, n): the k smallest hashes of a column and its distinct count.

    Hexadecimal text of fixed width sorts like the number. Hashes are shuffled and sorted only below a bound that leaves about
    k + MARGIN of a column. Where it leaves fewer than k of those there are, the column is done without a bound. Columns
    in which normalising changes no value have as many hashes as values; those of others are made distinct first.
    """
    rows = value_hashes(raw_counts)
    columns = materialize(rows.groupBy(*COLUMN_KEY).agg(F.count("*").alias("n_rows"), F.bool_or("changed").alias("merged")), "hashed")
    merged = rows.join(F.broadcast(columns.where("merged").select(*COLUMN_KEY)), COLUMN_KEY).select(*COLUMN_KEY, "h").distinct()
    of_merged = merged.groupBy(*COLUMN_KEY).agg(F.count("*").alias("n_distinct"))
    sizes = materialize(
        columns.join(of_merged, COLUMN_KEY, "left").select(*COLUMN_KEY, F.coalesce("n_distinct", "n_rows").alias("n")), "sizes")
    share = F.lit(float(k + MARGIN)) / F.col("n")
    bound = F.when(share < 1, F.lower(F.lpad(F.hex((share * float(1 << 60)).cast("bigint")), 15, "0")))

    def least(of: DataFrame) -> DataFrame:
        """The k smallest hashes of some columns below their bounds."""
        below = F.col("bound").isNull() | (F.col("h") < F.col("bound"))
        hashes = rows.join(F.broadcast(of), COLUMN_KEY).where(below).select(*COLUMN_KEY, "h").distinct()
        return top_per_group(hashes, COLUMN_KEY, [F.col("h")], k)

    found = materialize(least(sizes.select(*COLUMN_KEY, bound.alias("bound"))), "hashes")
    lacking = sizes.join(found.groupBy(*COLUMN_KEY).agg(F.count("*").alias("n_found")), COLUMN_KEY, "left").where(
        F.coalesce("n_found", F.lit(0)) < F.least("n", F.lit(k))).select(*COLUMN_KEY, F.lit(None).cast("string").alias("bound"))
    if not lacking.isEmpty():
        found = found.join(lacking, COLUMN_KEY, "left_anti").unionByName(least(lacking))
    sketches = found.groupBy(*COLUMN_KEY).agg(F.array_sort(F.collect_list(F.substring("h", 1, HASH_CHARS))).alias("sig"))
    return sketches.join(sizes, COLUMN_KEY)


def join_columns(profile: DataFrame, sketches: DataFrame) -> DataFrame:
    """The metaprofile of every join-eligible column; no sketch means no entry."""
    n = F.coalesce(F.col("n"), F.lit(0))
    return (
        profile.join(sketches, COLUMN_KEY, "left")
        .where(join_eligible(F.col("role"), F.col("type_class"), n))
        .select(
            "table_name", "column_name", "column_pos", "role", "sig", n.alias("n"),
            F.col("type_class").alias("type"),
            F.col("len_min_word").cast("int").alias("len_min"),
            F.col("len_max_word").cast("int").alias("len_max"),
        )
    )


def eligible_counts(profile: DataFrame, raw_counts: DataFrame) -> DataFrame:
    """Value counts of the join-eligible columns only, so that no other column is hashed."""
    eligible = profile.where(join_eligible(F.col("role"), F.col("type_class"), F.col("non_null")))
    return raw_counts.join(eligible.select(*COLUMN_KEY), COLUMN_KEY, "left_semi")


def sketch_index(join_cols: DataFrame) -> DataFrame:
    """The inverted index: one row per (hash, column)."""
    return join_cols.select(F.explode("sig").alias("h"), "table_name", "column_name")

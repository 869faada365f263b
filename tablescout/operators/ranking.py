"""From joinability and fingerprints to a ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescout.functions.scores import cosine, similarity, similarity_block, vector_literal
from tablescout.workspace import materialize

# The columns of a ranking, in order.
RANKING_COLUMNS = (
    "rank", "candidate_table", "similarity_score", "joinability_score", "table_semantic", "struct_sim",
    "join_columns", "n_join_keys", "best_query_column", "best_candidate_column",
)


def score(pairs: DataFrame) -> DataFrame:
    """J12-J15, P19, P20 for table pairs with both fingerprints and (possibly NULL) joinability."""
    semantic = cosine(F.col("q_vec"), F.col("c_vec"))
    structural = cosine(F.col("q_struct"), F.col("c_struct"))
    scored = pairs.withColumns({"_ts": semantic, "_ss": structural}).withColumn(
        "_jo", F.coalesce("joinability", F.lit(0.0))
    )
    total = similarity(F.col("_jo"), similarity_block(F.col("_ts"), F.col("_ss")))
    return scored.select(
        F.col("q_table").alias("query_table"),
        F.col("c_table").alias("candidate_table"),
        F.round(total, 4).alias("similarity_score"),
        F.round("_jo", 4).alias("joinability_score"),
        F.round("_ts", 4).alias("table_semantic"),
        F.round("_ss", 4).alias("struct_sim"),
        F.coalesce("join_columns", F.lit("")).alias("join_columns"),
        F.coalesce("n_join_keys", F.lit(0).cast("bigint")).alias("n_join_keys"),
        "best_query_column", "best_candidate_column",
    )


def ranked(scored: DataFrame, top_n: int | None) -> DataFrame:
    """By rounded similarity, ties in lake order (the candidate's name)."""
    if top_n is None:
        return _fully_ranked(scored)
    order = Window.partitionBy("query_table").orderBy(F.col("similarity_score").desc(), "candidate_table")
    out = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    return out.select("query_table", *RANKING_COLUMNS)


def _fully_ranked(scored: DataFrame) -> DataFrame:
    """Ranks of whole rankings, however long: rows are sorted by range, and each range gets the number of rows before it.

    Ranges are written, so that the counts and the rows are of the same ones. The result is in the order of the ranks.
    """
    order = [F.col("query_table"), F.col("similarity_score").desc(), F.col("candidate_table")]
    ranges = materialize(
        scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranking")
    # The number of the partition stands above the lowest 33 bits.
    ranges = ranges.withColumn("_range", F.shiftright("_at", 33))
    counts = ranges.groupBy("query_table", "_range").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy("query_table").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    rank = F.col("_at") - F.col("_first") + F.col("_before") + 1
    return ranges.join(starts, ["query_table", "_range"]).withColumn("rank", rank.cast("int")).orderBy("query_table", "rank").select(
        "query_table", *RANKING_COLUMNS)


def rank_one(
    query_name: str, query_vec: list[float], query_struct: list[float],
    fingerprints: DataFrame, joinability: DataFrame, top_n: int | None,
) -> DataFrame:
    """R5 for one query: every candidate but the query itself, with or without a join."""
    candidates = fingerprints.where(F.col("table_name") != query_name).select(
        F.lit(query_name).alias("q_table"),
        vector_literal(query_vec).alias("q_vec"),
        vector_literal(query_struct).alias("q_struct"),
        F.col("table_name").alias("c_table"),
        F.col("vec").alias("c_vec"), F.col("struct_vec").alias("c_struct"),
    )
    found = joinability.where(F.col("q_table") == query_name).drop("q_table")
    return ranked(score(candidates.join(found, "c_table", "left")), top_n)


def rank_all(fingerprints: DataFrame, joinability: DataFrame, top_n: int) -> DataFrame:
    """R5 for every table as the query (Q3), without pairing all tables.

    A pair without joinability has similarity 0, and those ties are broken by name. So the zero
    part of any query's first `top_n` lies within the first `top_n` + 1 tables of the lake by name
    (one of them may be the query, the others are either zero or ranked above). Only these are
    added to the pairs the sketches found.
    """
    first = [
        r["table_name"]
        for r in fingerprints.select("table_name").orderBy("table_name").limit(top_n + 1).collect()
    ]
    fillers = (
        fingerprints.select(F.col("table_name").alias("q_table"), F.explode(F.lit(first)).alias("c_table"))
        .where(F.col("q_table") != F.col("c_table"))
        .join(joinability, ["q_table", "c_table"], "left_anti")
    )

    def side(s: str) -> DataFrame:
        return fingerprints.select(
            F.col("table_name").alias(f"{s}_table"),
            F.col("vec").alias(f"{s}_vec"), F.col("struct_vec").alias(f"{s}_struct"),
        )

    pairs = joinability.unionByName(fillers, allowMissingColumns=True)
    return ranked(score(pairs.join(side("q"), "q_table").join(side("c"), "c_table")), top_n)

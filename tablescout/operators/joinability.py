"""Which columns of two tables join, and how well, from sketches alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescout.functions.scores import STRONG_KEY, TOP_KEYS, containment_of_matches, joinable_prior, noisy_or
from tablescout.workspace import materialize

# Rows of one key that meet in one task; a key with more is split on both sides.
KEY_CHUNK = 1000

_PROFILE = ["sig", "size", "n", "type", "len_min", "len_max"]


def split_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner equi-join in which no task has to pair up all rows of a frequent key.

    Either side of a key is cut into parts of about KEY_CHUNK rows and every part meets every part of
    the other side under a key of its own. A key that is rare on both sides stays whole.
    """

    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.ceil(F.count("*") / KEY_CHUNK).cast("int").alias(name))

    sizes = parts(left, "_left_parts").join(parts(right, "_right_parts"), key)

    def spread(df: DataFrame, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*df.columns), F.col(f"_{own}_parts")).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.col(f"_{other}_parts") - 1))
        return df.join(sizes, key).select(*df.columns, part.alias(f"_{own}"), others.alias(f"_{other}"))

    on = [key, "_left", "_right"]
    return spread(left, "left", "right").join(spread(right, "right", "left"), on).drop("_left", "_right")


def plain_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key)


def has_frequent_keys(columns: DataFrame) -> bool:
    """Whether any hash or class is held by more than KEY_CHUNK of these columns."""
    keys = columns.select(F.explode(F.array_append("sig", F.col("class_id"))).alias("key"))
    return not keys.groupBy("key").count().where(F.col("count") > KEY_CHUNK).isEmpty()


def with_class(join_cols: DataFrame) -> DataFrame:
    """Columns with the same sketch and statistics score alike; `class_id` stands for all of them."""
    key = F.concat_ws("|", F.concat_ws(",", "sig"), "n", "type", "len_min", "len_max")
    return join_cols.withColumn("class_id", F.sha2(key, 256))


def _classes(columns: DataFrame, side: str) -> DataFrame:
    """One row per class. All rows of a class are equal, so it does not matter which is kept."""
    first = columns.dropDuplicates(["class_id"]).withColumn("size", F.size("sig"))
    return first.select(*[F.col(c).alias(f"{side}_{c}") for c in ["class_id", *_PROFILE]])


def class_pairs(query_cols: DataFrame, candidate_cols: DataFrame, join=plain_join) -> DataFrame:
    """Scores of all pairs of classes that share a hash; no other pair can score above 0.

    The join of the hashes already says what two sketches share; only its ranks are put together for a pair.
    """
    q, c = _classes(query_cols, "q"), _classes(candidate_cols, "c")
    postings_q = q.select("q_class_id", F.posexplode("q_sig").alias("q_rank", "h"))
    postings_c = c.select("c_class_id", F.posexplode("c_sig").alias("c_rank", "h"))
    pairs = (
        join(postings_q, postings_c, "h").groupBy("q_class_id", "c_class_id")
        .agg(F.collect_list(F.col("q_rank") + F.col("c_rank") + 2).alias("ranks"))
    )
    overlap = containment_of_matches(F.col("ranks"), F.col("q_size"), F.col("q_n"), F.col("c_size"), F.col("c_n"))
    prior = joinable_prior(
        F.col("q_type"), F.col("q_len_min"), F.col("q_len_max"),
        F.col("c_type"), F.col("c_len_min"), F.col("c_len_max"),
    )
    scored = pairs.join(q.drop("q_sig"), "q_class_id").join(c.drop("c_sig"), "c_class_id")
    return (
        scored.select("q_class_id", "c_class_id", overlap.alias("containment"), prior.alias("prior"))
        .withColumn("j", F.col("containment") * F.col("prior"))
        .where(F.col("j") > 0)
    )


def column_pairs(query_cols: DataFrame, candidate_cols: DataFrame, many_queries: bool = False) -> DataFrame:
    """All column pairs of different tables that score above 0.

    With the few columns of one query table, the pairs of any hash or class grow with the candidates
    only. With `many_queries` they grow with both sides, so keys that are found to be frequent are split.

    Scores are computed between classes, so that a column copied into many tables is hashed, matched
    and scored once, and only then spread over the tables that hold it.
    """
    q_cols, c_cols = with_class(query_cols), with_class(candidate_cols)
    split = many_queries and has_frequent_keys(c_cols)
    join = split_join if split else plain_join

    def side(columns: DataFrame, s: str) -> DataFrame:
        return columns.select(
            F.col("class_id").alias(f"{s}_class_id"),
            F.col("table_name").alias(f"{s}_table"),
            F.col("column_name").alias(f"{s}_column"),
            F.col("column_pos").alias(f"{s}_pos"),
        )

    # A split join reads its inputs several times, so they are written once.
    keep = materialize if split else lambda df, label: df
    scored = keep(class_pairs(q_cols, c_cols, join), "class_pairs")
    pairs = keep(join(scored, side(q_cols, "q"), "q_class_id"), "query_pairs")
    return (
        join(pairs, side(c_cols, "c"), "c_class_id")
        .where(F.col("q_table") != F.col("c_table"))
        .drop("q_class_id", "c_class_id")
    )


def best_pairs(pairs: DataFrame) -> DataFrame:
    """The best candidate column of every query column; the first column wins a tie.

    The rows are partitioned by table pair, which serves this window and the aggregation of
    `table_joinability`; a group is no larger than the two tables are wide.
    """
    choice = Window.partitionBy("q_table", "c_table", "q_column").orderBy(F.col("j").desc(), "c_pos")
    return (
        pairs.repartition("q_table", "c_table")
        .withColumn("_rank", F.row_number().over(choice))
        .where(F.col("_rank") == 1).drop("_rank")
    )


def table_joinability(best: DataFrame) -> DataFrame:
    """One row per table pair with its noisy-OR score and the columns that carry it."""
    listed = F.array_sort(F.collect_list(F.struct(
        (-F.col("j")).alias("order"), F.col("q_pos").alias("pos"),
        F.col("q_column").alias("q"), F.col("c_column").alias("c"), F.col("j").alias("j"),
    )))
    strong = F.filter("pairs", lambda p: p["j"] >= STRONG_KEY)
    shown = F.when(F.size(strong) > 0, strong).otherwise(F.slice("pairs", 1, 1))
    text = F.transform(
        shown, lambda p: F.concat(p["q"], F.lit(" ↔ "), p["c"], F.lit(" ("), F.format_number(p["j"], 2), F.lit(")"))
    )
    return best.groupBy("q_table", "c_table").agg(listed.alias("pairs")).select(
        "q_table", "c_table",
        noisy_or(F.slice("pairs.j", 1, TOP_KEYS)).alias("joinability"),
        F.array_join(text, "; ").alias("join_columns"),
        F.size(strong).cast("bigint").alias("n_join_keys"),
        F.col("pairs")[0]["q"].alias("best_query_column"),
        F.col("pairs")[0]["c"].alias("best_candidate_column"),
    )

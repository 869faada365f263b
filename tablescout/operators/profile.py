"""Column profile: weighted aggregates over value counts, one output row per (table, column)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions.scores import cardinality_ratio, classify, fixed_length
from tablescout.functions.text import soundex, text_sql
from tablescout.operators.counts import COLUMN_KEY, HEAD_CHARS, number_text, top_per_group, type_order, union_all
from tablescout.workspace import materialize

TOP_VALUES = 10
# Parts of the numbers of one frequency whose least ones are compared.
LEAST_OF = 64
OCTILES = range(1, 8)

# Picks of long values up to this many are broadcast against the source, more are joined by shuffle.
MAX_BROADCAST_PICKS = 20_000

# Metrics in profile order, by how they are compared.
NUMERIC_METRICS = (
    "cardinality", "incompleteness", "uniqueness", "entropy",
    "frequency_avg", "frequency_min", "frequency_max", "frequency_sd", "frequency_iqr",
    "val_pct_min", "val_pct_max", "val_pct_std", "constancy",
    "frequency_1qo", "frequency_2qo", "frequency_3qo", "frequency_4qo",
    "frequency_5qo", "frequency_6qo", "frequency_7qo",
    "len_max_word", "len_min_word", "len_avg_word",
    "number_words", "words_cnt_max", "words_cnt_min", "words_cnt_avg", "words_cnt_sd",
    "is_empty", "is_binary",
)
SET_METRICS = ("freq_word_containment", "freq_word_soundex_containment")
TEXT_METRICS = ("first_word", "last_word")

# Metrics that are z-scored across all profiled columns.
ZSCORED_METRICS = (
    "cardinality", "entropy",
    "frequency_avg", "frequency_min", "frequency_max", "frequency_sd",
    "len_max_word", "len_min_word", "len_avg_word",
    "number_words", "words_cnt_max", "words_cnt_min", "words_cnt_avg", "words_cnt_sd",
)


def column_metrics(counts: DataFrame) -> DataFrame:
    """A1-A4, A8-A10, A14, A15 and, for numbers, A16, from profile-domain value counts.

    Values are first reduced to one row per (column, frequency). A column of N rows has at most
    sqrt(2 N) different frequencies, so what the windows below order stays small where N does not.
    """
    spectrum = counts.groupBy(*COLUMN_KEY, F.expr("v is null").alias("missing"), "n").agg(*_exprs(
        m="count(*)",
        w_max="max(w_max)", w_min="min(w_min)", w_avg="sum(w_avg)",
        words="sum(words)", words2="sum(double(words) * words)", words_max="max(words)", words_min="min(words)",
        i_min="min(i)", i_max="max(i)", d_min="min(d)", d_max="max(d)",
    ))
    column = "partition by column_id, missing"
    ranked = spectrum.select(
        "*",
        *_exprs(
            up_to=f"sum(m) over ({column} order by n rows between unbounded preceding and current row)",
            size=f"double(sum(m) over ({column}))",
            total=f"double(sum(n * m) over ({column}))",
        ),
    )
    present = {
        "non_null": "sum(n * m)",
        "cardinality": "sum(m)",
        "entropy": "sum(double(m) * n / total * log2(total / n))",
        "f_min": "min(n)",
        "f_max": "max(n)",
        **{f"m{k}": f"sum(m * power(n - total / size, {k})) / max(size)" for k in (2, 3, 4)},
        **{f"q{k}": f"min(case when up_to >= size * {k / 8}D then n end)" for k in OCTILES},
        "w_avg": "sum(n * w_avg)",
        "number_words": "sum(n * words)",
        "words2": "sum(n * words2)",
        "w_max": "max(w_max)", "w_min": "min(w_min)",
        "words_max": "max(words_max)", "words_min": "min(words_min)",
        "i_min": "min(i_min)", "i_max": "max(i_max)", "d_min": "min(d_min)", "d_max": "max(d_max)",
    }
    # Only the row count looks at NULLs as well.
    sums = ranked.groupBy(*COLUMN_KEY).agg(*_exprs(
        row_count="sum(n * m)",
        **{name: _filtered(sql) for name, sql in present.items()},
    )).where("non_null > 0")
    bound = {
        end: f"coalesce(cast(i_{agg} as string), {text_sql(f'd_{agg}', T.DoubleType())})"
        for end, agg in (("first_number", "min"), ("last_number", "max"))
    }
    variance = "(words2 - double(number_words) * number_words / non_null) / non_null"
    return sums.select(*COLUMN_KEY, "row_count", "non_null", "cardinality", "entropy", *_exprs(
        frequency_avg="double(non_null) / cardinality",
        frequency_min="f_min", frequency_max="f_max", frequency_sd="sqrt(m2)",
        frequency_iqr="q6 - q2", **{f"frequency_{k}qo": f"q{k}" for k in OCTILES},
        skewness=_SKEWNESS, kurtosis=_KURTOSIS,
        len_max_word="bigint(w_max)", len_min_word="bigint(w_min)", len_avg_word="w_avg / non_null",
        number_words="number_words", words_cnt_max="bigint(words_max)", words_cnt_min="bigint(words_min)",
        words_cnt_avg="double(number_words) / non_null",
        words_cnt_sd=f"sqrt(greatest(0D, {variance}))",
        **bound,
    ))


def _exprs(**named: str) -> list[Column]:
    return [F.expr(sql).alias(name) for name, sql in named.items()]


def _filtered(sql: str) -> str:
    """An aggregate over the rows of present values only."""
    return re.sub(r"\b(sum|min|max)(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))", r"\1\2 filter (where not missing)", sql)


# Bias-corrected skewness and excess kurtosis of the frequencies; 0 where they are undefined.
_C = "double(cardinality)"
_SKEWNESS = (
    f"case when cardinality > 2 and m2 > 0 then m3 / power(m2, 1.5D)"
    f" * sqrt({_C} * ({_C} - 1)) / ({_C} - 2) else 0D end"
)
_KURTOSIS = (
    f"case when cardinality > 3 and m2 > 0 then ({_C} - 1) / (({_C} - 2) * ({_C} - 3))"
    f" * (({_C} + 1) * (m4 / (m2 * m2) - 3) + 6) else 0D end"
)


def picked_values(counts: DataFrame, source, cleaned: bool, boundaries: bool = True) -> DataFrame:
    """The values a profile shows as text: (column_id, kind, rank, n, text).

    `kind` is `top` (A12: the most frequent, ties in the order of the type), `first` or `last` (A16, for
    all but plain numbers). Heads of long values pre-order them; where the cut falls into values of one head, those
    are settled on their whole texts. Every task hands on a bounded number of values per column, however many tie.
    """
    ascending = type_order(F.col("v"))
    columns = [*COLUMN_KEY, "type_class", "v", "digest", "i", "d", "n"]
    present = counts.where("not is_number and v is not null").select(*columns)
    numbers = _may_lead(counts.where("is_number"), TOP_VALUES).select(*columns)
    parts = [_leading(numbers.unionByName(present), "top", [F.col("n").desc(), *ascending], TOP_VALUES)]
    if boundaries:
        other = present.where(F.col("i").isNull() & F.col("d").isNull())
        parts.append(_leading(other, "first", ascending, 1))
        parts.append(_leading(other, "last", [c.desc() for c in ascending], 1))
    leading = materialize(union_all(parts), "picks")
    edges = leading.groupBy(*COLUMN_KEY, "kind").agg(F.max_by(F.struct("n", "v", "digest"), "rank").alias("e")).select(
        *COLUMN_KEY, "kind", F.when(F.col("kind") == "top", F.col("e.n")).alias("edge_n"), F.col("e.v").alias("edge_v"),
    ).where(F.length("edge_v") == HEAD_CHARS)
    edges = materialize(edges, "edges")
    if edges.isEmpty():
        texts = whole_texts(leading, source, cleaned)
    else:
        same = (F.col("v") == F.col("edge_v")) & (F.col("edge_n").isNull() | (F.col("n") == F.col("edge_n")))
        settled = leading.join(edges, [*COLUMN_KEY, "kind"], "left").where(~F.coalesce(same, F.lit(False)))
        settled = settled.drop("edge_n", "edge_v")
        tied = _settle(present, edges, settled, same, source, cleaned)
        number = {"i": F.lit(None).cast("bigint"), "d": F.lit(None).cast("double")}
        columns = [*COLUMN_KEY, "type_class", "kind", "n", "text", "i", "d"]
        texts = whole_texts(settled, source, cleaned).select(*columns).unionByName(tied.withColumns(number).select(*columns))
    order = type_order(F.col("text"))
    down = F.col("kind") == "last"
    by_text = Window.partitionBy(*COLUMN_KEY, "kind").orderBy(
        F.when(F.col("kind") == "top", F.col("n")).desc(),
        *[F.when(~down, c).asc() for c in order],
        *[F.when(down, c).desc() for c in order],
    )
    limit = F.when(F.col("kind") == "top", TOP_VALUES).otherwise(1)
    return (
        texts.withColumn("rank", F.row_number().over(by_text))
        .where(F.col("rank") <= limit).select(*COLUMN_KEY, "kind", "rank", "n", "text")
    )


def _settle(present: DataFrame, edges: DataFrame, settled: DataFrame, same: Column, source, cleaned: bool) -> DataFrame:
    """(column_id, type_class, kind, n, text): of the values that share the head at the cut, those that come first in whole.

    There is one head for each column and kind. Whole texts are compared in the tasks that read them; each hands on as many as
    may be needed.
    """
    tied = present.join(edges, COLUMN_KEY).where(same).select(*COLUMN_KEY, "type_class", "kind", "n", "v", "digest")
    ids = {r["column_id"] for r in edges.select("column_id").distinct().collect()}
    heads = edges.select(*COLUMN_KEY, "edge_v").distinct()
    texts = tied.where(F.col("digest").isNull()).select(*COLUMN_KEY, "type_class", "kind", "n", F.col("v").alias("text"))
    found = source.long_texts(cleaned, ids)
    if found is not None:
        long = found.join(heads, COLUMN_KEY).where(F.left("text", F.lit(HEAD_CHARS)) == F.col("edge_v")).drop("edge_v")
        texts = texts.unionByName(
            long.join(tied.where(F.col("digest").isNotNull()), [*COLUMN_KEY, "digest"])
            .select(*COLUMN_KEY, "type_class", "kind", "n", "text"))

    def first(kinds: Column, order: Column, k: int) -> DataFrame:
        rank = F.dense_rank().over(Window.partitionBy(*COLUMN_KEY, "kind").orderBy(order))
        return texts.where(kinds).withColumn("_rank", rank).where(F.col("_rank") <= k).distinct()

    is_last = F.col("kind") == "last"
    chosen = first(~is_last, F.col("text").asc(), TOP_VALUES).unionByName(first(is_last, F.col("text").desc(), 1))
    taken = settled.groupBy(*COLUMN_KEY, "kind").agg(F.count("*").alias("_taken"))
    room = F.when(F.col("kind") == "top", TOP_VALUES).otherwise(1) - F.coalesce("_taken", F.lit(0))
    return chosen.join(taken, [*COLUMN_KEY, "kind"], "left").where(F.col("_rank") <= room).drop("_rank", "_taken")


def _may_lead(numbers: DataFrame, k: int) -> DataFrame:
    """The numbers that can be among a column's first `k` by frequency and size, without a sort of the others.

    The frequency that the k-th one has is found by adding up. Of the numbers that have it, each of LEAST_OF parts gives its least one,
    and none above the k-th of those can be among the first `k`. Whole numbers and others of a column are told apart by themselves.
    """
    group = [*COLUMN_KEY, "whole"]
    numbers = numbers.select(*COLUMN_KEY, "type_class", "i", "d", "n", F.col("i").isNotNull().alias("whole"))
    least = numbers.groupBy(*group, "n", F.pmod(F.xxhash64("i", "d"), F.lit(LEAST_OF)).alias("part")).agg(
        F.count("*").alias("m"), F.min("i").alias("i"), F.min("d").alias("d"))
    spectrum = least.groupBy(*group, "n").agg(
        F.sum("m").alias("m"), *[F.get(F.array_sort(F.collect_list(x)), F.lit(k - 1)).alias(f"edge_{x}") for x in "id"])
    before = F.sum("m").over(Window.partitionBy(*group).orderBy(F.col("n").desc())) - F.col("m")
    edges = spectrum.withColumn("before", before).where(F.col("before") < k).groupBy(*group).agg(
        F.min_by(F.struct("n", "edge_i", "edge_d"), "n").alias("edge"))
    at_edge = F.coalesce(F.col("i") <= F.col("edge.edge_i"), F.col("d") <= F.col("edge.edge_d"), F.lit(True))
    # There is one edge for each column, at most two.
    return numbers.join(F.broadcast(edges), group).where(
        (F.col("n") > F.col("edge.n")) | (F.col("n") == F.col("edge.n")) & at_edge).withColumns({"v": number_text(), "digest": F.lit(None).cast("string")})


def _leading(counts: DataFrame, kind: str, order: list[Column], k: int) -> DataFrame:
    return top_per_group(counts, COLUMN_KEY, order, k, rank="rank").withColumn("kind", F.lit(kind))


def whole_texts(picks: DataFrame, source, cleaned: bool) -> DataFrame:
    """Add `text`: the value itself, fetched by digest from the source where only its head is known."""
    long = picks.where(F.col("digest").isNotNull())
    per_column = {r["column_id"]: r["count"] for r in long.groupBy("column_id").count().collect()}
    if not per_column:
        return picks.withColumn("text", F.col("v"))
    key = [*COLUMN_KEY, "digest"]
    wanted = long.select(*key).distinct()
    if sum(per_column.values()) <= MAX_BROADCAST_PICKS:
        wanted = F.broadcast(wanted)
    texts = source.long_texts(cleaned, set(per_column))
    found = texts.join(wanted, key).groupBy(*key).agg(F.first("text").alias("text"))
    return (
        picks.join(found, key, "left")
        .withColumn("text", F.coalesce("text", "v"))
    )


def picks_per_column(picks: DataFrame) -> DataFrame:
    """Top values as an array in rank order, their Soundex codes, first and last."""
    in_order = F.array_sort(F.collect_list(F.when(F.col("kind") == "top", F.struct("rank", "text"))))
    top = F.col("_top.text")
    return picks.groupBy(*COLUMN_KEY).agg(
        in_order.alias("_top"),
        F.max(F.when(F.col("kind") == "first", F.col("text"))).alias("first_text"),
        F.max(F.when(F.col("kind") == "last", F.col("text"))).alias("last_text"),
    ).select(
        *COLUMN_KEY,
        top.alias("freq_word_containment"),
        F.transform(top, soundex).alias("freq_word_soundex_containment"),
        "first_text", "last_text",
    )


def value_sets(profile: DataFrame) -> DataFrame:
    """Lower-cased sets of the top values and of their Soundex codes."""
    def lowered(name: str) -> Column:
        return F.array_sort(F.array_distinct(F.transform(F.col(name), F.lower)))

    return profile.select(
        "table_name", "column_name",
        lowered("freq_word_containment").alias("top_values"),
        lowered("freq_word_soundex_containment").alias("soundex_values"),
    )


def text_metrics(counts: DataFrame) -> DataFrame:
    """A18 (text columns) and A19 from summary-domain value counts."""
    spectrum = counts.where("v is not null").groupBy(*COLUMN_KEY, "type_class", "n").agg(*_exprs(
        m="count(*)", c_min="min(chars)", c_max="max(chars)", chars="sum(chars)",
    ))
    shares = spectrum.withColumn("p", F.expr("double(n) / sum(n * m) over (partition by column_id)"))
    text = "filter (where type_class = 'string')"
    return shares.groupBy(*COLUMN_KEY).agg(*_exprs(
        val_len_min=f"min(c_min) {text}", val_len_max=f"max(c_max) {text}",
        val_len_avg=f"double(sum(n * chars) {text}) / sum(n * m) {text}",
        text_entropy="-sum(m * p * log2(p + 1e-10D))",
    ))


def assemble_profile(columns: DataFrame, metrics: DataFrame, picks: DataFrame, texts: DataFrame) -> DataFrame:
    """The column profile: P4, P6, P14, P15, P18, A5, A6, A11, A17 on top of the joined metric groups.

    Every input has one row per column and is partitioned by column already.
    """
    joined = metrics.join(picks, COLUMN_KEY).join(texts, COLUMN_KEY).join(columns, COLUMN_KEY)
    ratios = {
        "uniqueness": "cardinality", "incompleteness": "(row_count - non_null)",
        "val_pct_min": "frequency_min", "val_pct_max": "frequency_max", "val_pct_std": "frequency_sd",
        "constancy": "frequency_max",
        **{name: name for name in ("frequency_iqr", *(f"frequency_{k}qo" for k in OCTILES))},
    }
    fractions = ("entropy", "frequency_avg", "frequency_sd", "len_avg_word", "words_cnt_avg", "words_cnt_sd",
                 "skewness", "kurtosis")
    sql = {
        **{name: name for name in (*NUMERIC_METRICS, "skewness", "kurtosis")},
        **{name: f"round({name}, 9)" for name in fractions},
        **{name: f"round(double({over}) / row_count, 9)" for name, over in ratios.items()},
        "is_empty": "int(cardinality = 0)", "is_binary": "int(cardinality = 2)",
        "first_word": "coalesce(first_number, first_text)", "last_word": "coalesce(last_number, last_text)",
    }
    rounded = joined.select(
        *COLUMN_KEY, "table_name", "column_name", "column_pos", "data_type", "type_class",
        "row_count", "non_null", *_exprs(**sql), *SET_METRICS,
        "val_len_min", "val_len_max", "val_len_avg", "text_entropy",
    )
    c = F.col
    role = classify(
        c("type_class"), c("is_binary"), c("uniqueness"), c("cardinality"), c("row_count"),
        c("val_pct_max"), c("len_min_word"), c("len_max_word"), c("len_avg_word"), c("words_cnt_avg"),
    )
    return rounded.withColumns({
        "fixed_length": fixed_length(c("type_class"), c("len_min_word"), c("len_max_word")),
        "cardinality_ratio": cardinality_ratio(c("cardinality"), c("row_count")),
        "role": role,
    })


def top_values(picks: DataFrame) -> DataFrame:
    """A12 in long form."""
    return picks.where(F.col("kind") == "top").select(*COLUMN_KEY, "rank", "n", "text")



"""The text a table is embedded from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.operators.counts import COLUMN_KEY

# How many columns of a class a summary names, and the limits of its phrases.
NAMED_COLUMNS = 3
HIGH_ENTROPY = 4.0
MODERATE_ENTROPY = 2.0
COMPLETE_BELOW = 0.02
SPARSE_FROM = 0.2


def named_text_columns(columns: DataFrame) -> DataFrame:
    """Keys of the text columns a summary describes: the first few of each table."""
    nth = F.row_number().over(Window.partitionBy("table_name").orderBy("column_pos"))
    return (
        columns.where(F.col("type_class") == "string")
        .withColumn("_nth", nth).where(F.col("_nth") <= NAMED_COLUMNS)
        .select(*COLUMN_KEY)
    )


def table_sample(columns: DataFrame, sample_rows: DataFrame) -> DataFrame:
    """Schema and sample rows, as (table_name, sample_text)."""
    names = columns.groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.struct("column_pos", "column_name"))).alias("_names")
    )
    rows = sample_rows.groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.struct("h", "row_text"))).alias("_rows")
    )
    return names.join(rows, "table_name", "left").select(
        "table_name",
        F.concat(
            F.lit("Table Name: "), F.col("table_name"),
            F.lit("\nColumns: "), F.array_join("_names.column_name", ", "),
            F.lit("\nSample Data:\n"),
            F.coalesce(F.array_join("_rows.row_text", "\n"), F.lit("")),
        ).alias("sample_text"),
    )


def executive_summary(
    columns: DataFrame, top: DataFrame, texts: DataFrame, null_ratios: DataFrame
) -> DataFrame:
    """(table_name, summary) from per-column and per-table results that are already small."""
    in_order = F.array_sort(F.collect_list(F.struct("rank", "text")))
    tops = top.groupBy(*COLUMN_KEY).agg(F.array_join(in_order["text"], ", ").alias("_top"))
    nth = F.row_number().over(Window.partitionBy("table_name", "type_class").orderBy("column_pos"))
    described = (
        columns.join(texts, COLUMN_KEY, "left").join(tops, COLUMN_KEY, "left")
        .withColumn("_nth", nth)
        .withColumn("_text", _text_column())
    )

    def size(kind: str) -> Column:
        return F.count_if(F.col("type_class") == kind)

    def named(kind: str, label: str) -> Column:
        wanted = (F.col("type_class") == kind) & (F.col("_nth") <= NAMED_COLUMNS)
        return F.array_sort(F.collect_list(F.when(wanted, F.struct("column_pos", label))))[label]

    per_table = described.groupBy("table_name").agg(
        F.count("*").alias("n"),
        size("numeric").alias("n_numeric"), named("numeric", "column_name").alias("numeric"),
        size("string").alias("n_text"), named("string", "_text").alias("text"),
        size("date").alias("n_date"), named("date", "column_name").alias("date"),
        F.avg(F.coalesce("text_entropy", F.lit(0.0))).alias("entropy"),
    )

    def part(n: str, noun: str, shown: Column, more: bool) -> Column:
        count = F.col(n)
        rest = F.when(count > NAMED_COLUMNS, F.format_string(" and %d more", count - NAMED_COLUMNS))
        return F.when(count > 0, F.concat(
            count.cast("string"), F.lit(f" {noun} column"), F.when(count > 1, "s").otherwise(""),
            F.lit(" ("), shown, F.coalesce(rest, F.lit("")) if more else F.lit(""), F.lit(")"),
        ))

    parts = F.concat_ws(
        "; ",
        part("n_numeric", "numeric", F.array_join("numeric", ", "), True),
        part("n_text", "text", F.array_join("text", "; "), True),
        part("n_date", "date", F.array_join("date", ", "), False),
    )
    entropy = (
        F.when(F.col("entropy") > HIGH_ENTROPY, "Columns have high entropy (many distinct values).")
        .when(F.col("entropy") > MODERATE_ENTROPY, "Columns have moderate entropy.")
        .otherwise("Columns have low entropy (few dominant values).")
    )
    missing = F.coalesce(F.col("null_ratio"), F.lit(0.0))
    complete = (
        F.when(missing < COMPLETE_BELOW, "Data is complete.")
        .when(missing < SPARSE_FROM, "Data has some missing values.")
        .otherwise("Data is sparse with many missing values.")
    )
    return per_table.join(null_ratios.select("table_name", "null_ratio"), "table_name", "left").select(
        "table_name",
        F.concat(
            F.lit("This dataset has "), F.col("n").cast("string"), F.lit(" columns: "),
            parts, F.lit(". "), entropy, F.lit(" "), complete,
        ).alias("summary"),
    )


def _text_column() -> Column:
    """A text column with the size of its values and its most frequent ones."""
    low, high = F.col("val_len_min").cast("string"), F.col("val_len_max").cast("string")
    size = F.when(low == high, F.concat(F.lit(" ("), low, F.lit("-char values)"))).otherwise(
        F.concat(F.lit(" ("), low, F.lit("-"), high, F.lit(" char values)"))
    )
    return F.concat(
        F.col("column_name"), F.coalesce(size, F.lit("")),
        F.coalesce(F.concat(F.lit(": "), F.col("_top")), F.lit("")),
    )


def table_text(summaries: DataFrame, samples: DataFrame) -> DataFrame:
    """E3."""
    return summaries.join(samples, "table_name").select(
        "table_name", F.concat("summary", F.lit("\n\n"), "sample_text").alias("table_text")
    )

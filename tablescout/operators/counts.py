"""Value counts, the one shuffle every profile metric and every sketch is derived from.

A value longer than HEAD_CHARS is not shuffled whole: what travels is its first HEAD_CHARS characters
(which order values), a SHA-256 digest (which identifies them) and the few numbers the metrics need,
all computed from the whole value before the shuffle. Where the full text of such a value is wanted
(top values, first and last value) it is fetched by digest afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions.text import TYPE_TESTS, clean_value, normalise_value, text_sql, with_word_stats

HEAD_CHARS = 256

# A profiled column is known by one number everywhere between the source and the final report.
COLUMN_KEY = ["column_id"]


def head(text: Column) -> Column:
    return F.left(text, F.lit(HEAD_CHARS))


def digest(text: Column) -> Column:
    """Identity of a value that is longer than its head, NULL for one that is not."""
    return F.when(F.length(text) > HEAD_CHARS, F.sha2(text, 256))


def compact(rows: DataFrame) -> DataFrame:
    """Replace `v` by (v, long): the value, or its head and what has to survive the shuffle."""
    is_long = F.length("v") > HEAD_CHARS
    cleaned = with_word_stats(rows.withColumn("p", F.when(is_long, clean_value(F.col("v")))), "p")
    p = F.col("p")
    facts = F.struct(
        digest(F.col("v")).alias("digest"),
        head(p).alias("p_head"),
        digest(p).alias("p_digest"),
        F.md5(normalise_value(F.col("v"))).alias("s_md5"),
        F.length("v").alias("chars"),
        *WORD_STATS,
        # Which types the whole value fits, in the order of TYPE_TESTS.
        F.array(*[F.expr(test) for test in TYPE_TESTS.values()]).alias("fits"),
    )
    return cleaned.withColumn("long", F.when(is_long, facts)).withColumn("v", head(F.col("v"))).drop("p", *WORD_STATS)


WORD_STATS = ("w_max", "w_min", "w_avg", "words")

_LONG = (
    "struct<digest:string,p_head:string,p_digest:string,s_md5:string,chars:int,"
    "w_max:int,w_min:int,w_avg:double,words:int,fits:array<boolean>>"
)

# How the values of a column are counted, by what they are stored as.
WHOLE, REAL, TEXT = "whole", "real", "text"
# Types that are a storage kind each.
MOMENTS = (T.DateType, T.TimestampType, T.TimestampNTZType)


def storage_of(data_type: T.DataType) -> str:
    """Whole numbers, doubles, dates and timestamps are counted as they are, everything else as text."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return WHOLE
    if isinstance(data_type, MOMENTS):
        return data_type.simpleString()
    return REAL if isinstance(data_type, T.DoubleType) else TEXT


def melt(df: DataFrame, fields: list, storage: str) -> DataFrame | None:
    """The columns of one storage kind as (column_id, type_class, v), in one scan of those columns."""
    chosen = [f for f in fields if storage_of(f.data_type) == storage]
    if not chosen:
        return None
    sql = {
        WHOLE: lambda f: f"cast(`{f.name}` as bigint)",
        TEXT: lambda f: text_sql(f"`{f.name}`", f.data_type),
    }.get(storage, lambda f: f"`{f.name}`")
    values = ", ".join(f"{f.column_id}L, '{f.type_class}', c{i}" for i, f in enumerate(chosen))
    return df.selectExpr(*[f"{sql(f)} as c{i}" for i, f in enumerate(chosen)]).selectExpr(
        f"stack({len(chosen)}, {values}) as (column_id, type_class, v)"
    )


def count_whole(cells: DataFrame) -> DataFrame:
    """Value counts of whole numbers; text is made of them only after they have been counted."""
    counted = cells.groupBy(*COLUMN_KEY, F.col("v").alias("i")).agg(F.count("*").alias("n"))
    return counted.select(
        *COLUMN_KEY, F.lit("numeric").alias("type_class"), F.col("i").cast("string").alias("v"),
        F.lit(None).cast(_LONG).alias("long"), "i", F.lit(None).cast("double").alias("d"), "n",
    )


def count_real(cells: DataFrame) -> DataFrame:
    """Value counts of doubles."""
    counted = cells.groupBy(*COLUMN_KEY, F.col("v").alias("d")).agg(F.count("*").alias("n"))
    return counted.select(
        *COLUMN_KEY, F.lit("numeric").alias("type_class"), F.expr(text_sql("d", T.DoubleType())).alias("v"),
        F.lit(None).cast(_LONG).alias("long"), F.lit(None).cast("bigint").alias("i"), "d", "n",
    )


def count_moments(cells: DataFrame) -> DataFrame:
    """Value counts of dates and timestamps. Two moments may be printed alike where clocks are set back."""
    counted = cells.groupBy(*COLUMN_KEY, "v").agg(F.count("*").alias("n")).withColumn("v", F.col("v").cast("string"))
    if isinstance(cells.schema["v"].dataType, T.TimestampType):
        counted = counted.groupBy(*COLUMN_KEY, "v").agg(F.sum("n").alias("n"))
    return _without_numbers(counted, "date")


def count_short(cells: DataFrame, type_class: str) -> DataFrame:
    """Value counts of texts that are no longer than a head, and of NULLs, for columns of one class."""
    short = cells.where(F.col("v").isNull() | (F.length("v") <= HEAD_CHARS))
    return _without_numbers(short.groupBy(*COLUMN_KEY, "v").agg(F.count("*").alias("n")), type_class)


def _without_numbers(counted: DataFrame, type_class: str) -> DataFrame:
    return counted.select(
        *COLUMN_KEY, F.lit(type_class).alias("type_class"), "v", F.lit(None).cast(_LONG).alias("long"),
        F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("double").alias("d"), "n",
    )


def count_text(cells: DataFrame) -> DataFrame:
    """Value counts of texts of any length, with long values in compact form."""
    counted = compact(cells).groupBy(*COLUMN_KEY, "type_class", "v", "long").agg(F.count("*").alias("n"))
    return counted.select(
        *COLUMN_KEY, "type_class", "v", "long",
        F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("double").alias("d"), "n",
    )


def count_tables(tables: dict[str, DataFrame], fields: dict[str, list]) -> DataFrame:
    """A7 for wide tables: (column_id, type_class, v, long, i, d, n), NULL being a value of its own.

    `i` and `d` hold a number as it is stored (they order values), `v` its text. There is one scan
    and one shuffle per storage kind, each over the columns of that kind of all tables. Texts are scanned twice: short
    ones are counted by plain keys, and only long ones are taken apart.
    """
    kinds = sorted({(storage_of(f.data_type), f.type_class) for of_table in fields.values() for f in of_table})
    parts = []
    for storage, type_class in kinds:
        melted = [
            melt(df, [f for f in fields[name] if f.type_class == type_class], storage) for name, df in tables.items()]
        cells = union_all([m for m in melted if m is not None])
        if storage == TEXT:
            parts += [count_short(cells, type_class), count_text(cells.where(F.length("v") > HEAD_CHARS))]
        else:
            parts.append({WHOLE: count_whole, REAL: count_real}.get(storage, count_moments)(cells))
    return union_all(parts)


def number_text() -> Column:
    """The text of a number that is stored as `i` or `d`."""
    return F.coalesce(F.col("i").cast("string"), F.expr(text_sql("d", T.DoubleType())))


def to_store(raw_counts: DataFrame) -> DataFrame:
    """Value counts without texts that follow from their numbers; `from_store` adds them."""
    return raw_counts.withColumn("v", F.when(~F.col("v").eqNullSafe(number_text()), F.col("v")))


def from_store(stored: DataFrame) -> DataFrame:
    """Adds `v`, and `is_number`: its text is the number's own."""
    is_number = F.col("v").isNull() & (F.col("i").isNotNull() | F.col("d").isNotNull())
    return stored.withColumns({"v": F.coalesce("v", number_text()), "is_number": is_number})


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def profile_counts(raw_counts: DataFrame) -> DataFrame:
    """Value counts in the profile domain: (column_id, type_class, v, digest, i, d, n, words…, is_number).

    Cleaning may merge several raw text values; other types keep their counts as they are.
    """
    long_p = F.when(
        F.col("long.p_digest").isNotNull(),
        F.struct(
            F.col("long.p_digest").alias("digest"),
            *[F.col(f"long.{name}").alias(name) for name in WORD_STATS],
        ),
    )
    is_text = F.col("type_class") == "string"
    text = (
        raw_counts.where(is_text)
        .select(
            *COLUMN_KEY, "type_class", "n",
            F.when(F.col("long").isNull(), clean_value(F.col("v"))).otherwise(F.col("long.p_head")).alias("v"),
            long_p.alias("long"),
        )
        .groupBy(*COLUMN_KEY, "type_class", "v", "long").agg(F.sum("n").alias("n"))
        .select("*", F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("double").alias("d"))
    )
    other = raw_counts.where(~is_text).withColumn("long", F.lit(None).cast(text.schema["long"].dataType))
    # A number's own text is one word; nothing has to be taken apart for it.
    chars = F.length("v")
    words = other.where("is_number").select(
        *COLUMN_KEY, "type_class", "v", F.lit(None).cast("string").alias("digest"), "i", "d", "n",
        chars.alias("w_max"), chars.alias("w_min"), chars.cast("double").alias("w_avg"), F.lit(1).alias("words"),
        F.lit(True).alias("is_number"),
    )
    counted = text.unionByName(other.where("not is_number").drop("is_number"))
    short = with_word_stats(counted.withColumn("s", F.when(F.col("long").isNull(), F.col("v"))), "s")
    return words.unionByName(short.select(
        *COLUMN_KEY, "type_class", "v", F.col("long.digest").alias("digest"), "i", "d", "n",
        *[F.coalesce(F.col(f"long.{name}"), F.col(name)).alias(name) for name in WORD_STATS],
        F.lit(False).alias("is_number"),
    ))


def summary_counts(raw_counts: DataFrame) -> DataFrame:
    """Value counts in the summary domain (raw text), shaped like `profile_counts`."""
    return raw_counts.select(
        *COLUMN_KEY, "type_class", "v", F.col("long.digest").alias("digest"), "i", "d", "n", "is_number",
        F.coalesce(F.col("long.chars"), F.length("v")).alias("chars"),
    )


def type_order(text: Column) -> list[Column]:
    """Sort keys that put values in the order of their type: numbers by size, all else as text."""
    other_number = F.when(
        (F.col("type_class") == "numeric") & F.col("i").isNull() & F.col("d").isNull(), text
    ).try_cast("decimal(38,18)")
    return [F.col("i"), F.col("d"), other_number, text]


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None
) -> DataFrame:
    """The first `k` rows of each group; Spark cuts every partition to `k` rows before it shuffles."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = out.where(F.col(name) <= k)
    return out if rank else out.drop(name)

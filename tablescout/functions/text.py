"""Type classes and the three text domains (profile, sketch, summary)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The types of a column, tried in this order, and when a text can be read as each. A column needs all values to
# fit. A double keeps up to 17 digits, so that different texts do not become one value.
TYPE_TESTS = {
    "boolean": "v rlike '^(?i:true|false)$'",
    "time": "v rlike '^([01]?[0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.][0-9]+)?$'",
    "date": "v rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$' and try_cast(v as date) is not null",
    "timestamp": "v rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?$'"
                 " and try_cast(v as timestamp_ntz) is not null",
    "bigint": "v rlike '^[+-]?[0-9]{1,19}$' and try_cast(v as bigint) is not null",
    "decimal(38,0)": "v rlike '^[+-]?[0-9]{1,38}$'",
    "double": "v rlike '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$'"
              " and length(regexp_replace(regexp_replace(v, '[eE].*$', ''), '^[+-]?0*[.]?0*|[.]', '')) <= 17",
}

# Substrings of an upper-cased type name that decide its class, date first.
DATE_TYPE_PATTERN = "DATE|TIMESTAMP|TIME"
NUMERIC_TYPE_PATTERN = "INT|FLOAT|DOUBLE|DECIMAL|NUMERIC|REAL|BIGINT|HUGEINT"

# What counts as white space around a value in the sketch domain.
WHITE_SPACE = " \t\n\x0b\f\r"

NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)


def type_class(data_type: Column) -> Column:
    """P5: `date`, `numeric` or `string` from a type name."""
    name = F.upper(data_type)
    return (
        F.when(name.rlike(DATE_TYPE_PATTERN), "date")
        .when(name.rlike(NUMERIC_TYPE_PATTERN), "numeric")
        .otherwise("string")
    )


def type_class_of(data_type: str) -> str:
    """P5 for a schema field, where the type name is known before the job runs."""
    name = data_type.upper()
    if re.search(DATE_TYPE_PATTERN, name):
        return "date"
    return "numeric" if re.search(NUMERIC_TYPE_PATTERN, name) else "string"


def clean_column_name(name: str) -> str:
    """No byte-order mark, double quotes or line breaks; trimmed."""
    return re.sub('[\ufeff"\n\r]', "", name).strip()


def clean_column_names(names: list[str]) -> list[str]:
    """P1 for a header; a name that is already taken gets the suffix `_1`, `_2`, …"""
    taken: set[str] = set()
    out = []
    for name in map(clean_column_name, names):
        unique, i = name, 0
        while unique.lower() in taken:
            i += 1
            unique = f"{name}_{i}"
        taken.add(unique.lower())
        out.append(unique)
    return out


def text_sql(value: str, data_type: T.DataType) -> str:
    """SQL for a value as text; doubles are printed in plain decimals where Spark would use an exponent."""
    text = f"cast({value} as string)"
    if not isinstance(data_type, (T.DoubleType, T.FloatType)):
        return text
    plain = f"regexp_replace(cast(cast({text} as decimal(38,20)) as string), '0+$', '')"
    return (
        f"case when abs({value}) >= 1e7D and abs({value}) < 1e16D or abs({value}) >= 1e-4D and abs({value}) < 1e-3D"
        f" then regexp_replace({plain}, '[.]$', '.0') else {text} end"
    )


def clean_value(v: Column) -> Column:
    """Profile domain. Blanks are trimmed first, so a blank before a line break stays."""
    trimmed = F.trim(v)
    return F.lower(F.replace(F.replace(trimmed, F.lit("\n"), F.lit("")), F.lit("\r"), F.lit("")))


def normalise_value(v: Column) -> Column:
    """Sketch domain. All outer white space goes, inner line breaks stay."""
    return F.lower(F.trim(v, F.lit(WHITE_SPACE)))


_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The letters with a Soundex digit, and their digits.
SOUNDEX_LETTERS, SOUNDEX_DIGITS = "BFPVCGJKQSXZDTLMNR", "111122222222334556"


def soundex(v: Column) -> Column:
    """The first character as it is (A-Z in upper case) and the digits of what follows, in four characters.

    Letters of one digit in a row count once, also across H and W; any other character separates them. Unlike Spark's function this
    also codes values that do not start with a letter. An empty value stays empty.
    """
    upper = F.translate(v, _LOWER, _UPPER)
    first = F.left(upper, F.lit(1))
    uncoded = f"[^{SOUNDEX_LETTERS}]"
    rest = F.regexp_replace(F.regexp_replace(F.substring(upper, 2, 2147483647), "[HW]", ""), uncoded, ".")
    marks = F.translate(F.concat(F.regexp_replace(first, uncoded, "."), rest), SOUNDEX_LETTERS, SOUNDEX_DIGITS)
    single = F.regexp_replace(marks, r"([1-6])\1+", "$1")
    digits = F.replace(F.substring(single, 2, 2147483647), F.lit("."), F.lit(""))
    return F.when(v == "", v).otherwise(F.concat(first, F.rpad(F.left(digits, F.lit(3)), 3, "0")))


def name_tokens(name: Column) -> Column:
    """Runs of letters in a lower-cased name."""
    return F.regexp_extract_all(F.lower(name), F.lit("[a-z]+"), F.lit(0))


def number_or(c: Column, default: float = 0.0) -> Column:
    """Tolerant numeric coercion; NULL, NaN and non-numbers become `default`."""
    value = c.try_cast("double")
    return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(float(default)))


def integer_or(c: Column, default: int = 0) -> Column:
    """P7 for integers (truncates towards zero)."""
    return number_or(c, default).try_cast("bigint")


def with_word_stats(df: DataFrame, text: str) -> DataFrame:
    """A14/A15 for one value per row: words are the pieces between single blanks, empty ones included.

    Adds w_max, w_min, w_avg and words. The lengths of the words are a column of their own on the
    way, so that a long text is taken apart once.
    """
    letters = f"length(replace({text}, ' ', ''))"
    words = f"length({text}) - {letters} + 1"
    return (
        df.withColumn("_lengths", F.expr(f"case when instr({text}, ' ') > 0 then transform(split({text}, ' '), w -> length(w)) end"))
        .selectExpr(
            "*",
            f"coalesce(array_max(_lengths), length({text})) as w_max",
            f"coalesce(array_min(_lengths), length({text})) as w_min",
            f"{letters} / ({words}) as w_avg",
            f"{words} as words",
        )
        .drop("_lengths")
    )

"""What a profile job needs from its input, for wide tables and for long-form cells alike."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from copy import copy
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions.text import (
    NESTED_TYPES,
    clean_column_names,
    clean_value,
    text_sql,
    type_class_of,
)
from tablescout.operators.counts import (
    COLUMN_KEY,
    HEAD_CHARS,
    TEXT,
    count_tables,
    count_text,
    digest,
    melt,
    top_per_group,
    union_all,
)
from tablescout.workspace import small_frame

SAMPLE_ROWS = 3

COLUMN_SCHEMA = pa.schema([
    ("column_id", pa.int64()),
    ("table_name", pa.string()),
    ("column_pos", pa.int32()),
    ("column_name", pa.string()),
    ("data_type", pa.string()),
    ("type_class", pa.string()),
])


_ID_DIGITS = 15


def column_id(table_name: Column, column_pos: Column) -> Column:
    """The number a column is known by: 60 bits of a hash of its table and position."""
    digits = F.left(F.md5(F.concat_ws("|", table_name, column_pos)), F.lit(_ID_DIGITS))
    return F.conv(digits, 16, 10).cast("bigint")


def column_number(table: str, pos: int) -> int:
    """The `column_id` of a table and a position."""
    return int(hashlib.md5(f"{table}|{pos}".encode()).hexdigest()[:_ID_DIGITS], 16)


@dataclass(frozen=True)
class Field:
    """One profiled column of a table whose names have been cleaned."""

    table: str
    pos: int
    name: str
    data_type: T.DataType

    @property
    def column_id(self) -> int:
        return column_number(self.table, self.pos)

    @property
    def type_name(self) -> str:
        return self.data_type.simpleString()

    @property
    def type_class(self) -> str:
        return type_class_of(self.type_name)

    @property
    def is_text(self) -> bool:
        return isinstance(self.data_type, (T.StringType, T.CharType, T.VarcharType))


def profiled_fields(table: str, df: DataFrame, varchar_only: bool = False) -> list[Field]:
    """The columns of a table that can be profiled, in order; nested and binary ones are left out."""
    wanted = (T.StringType, T.BooleanType) if varchar_only else (T.DataType,)
    return [
        Field(table, pos, f.name, f.dataType)
        for pos, f in enumerate(df.schema.fields)
        if isinstance(f.dataType, wanted) and not isinstance(f.dataType, NESTED_TYPES)
    ]


class TableSource:
    """Named wide DataFrames (S5). Tables with nothing to profile are listed in `skipped`."""

    def __init__(self, tables: dict[str, DataFrame], varchar_only: bool = False,
                 skipped: list[str] | None = None, reasons: dict[str, str] | None = None) -> None:
        tables = {name: df.toDF(*clean_column_names(df.columns)) for name, df in tables.items()}
        fields = {name: profiled_fields(name, df, varchar_only) for name, df in tables.items()}
        self.fields = {name: fs for name, fs in fields.items() if fs}
        self.tables = {name: tables[name] for name in self.fields}
        self.skipped = sorted([*(skipped or []), *(name for name, fs in fields.items() if not fs)])
        self.reasons = dict(reasons or {})
        if not self.tables:
            raise ValueError("There is no table with a column that can be profiled.")
        ids = [f.column_id for fs in self.fields.values() for f in fs]
        if len(ids) != len(set(ids)):
            raise ValueError("Two columns have the same column_id; rename one of their tables.")

    @property
    def spark(self) -> SparkSession:
        return next(iter(self.tables.values())).sparkSession

    def columns(self) -> DataFrame:
        """(column_id, table_name, column_pos, column_name, data_type, type_class) of every column."""
        rows = [
            {"column_id": f.column_id, "table_name": table, "column_pos": f.pos, "column_name": f.name,
             "data_type": f.type_name, "type_class": f.type_class}
            for table, fields in self.fields.items() for f in fields
        ]
        return small_frame(self.spark, COLUMN_SCHEMA, rows)

    def raw_counts(self) -> DataFrame:
        return count_tables(self.tables, self.fields)

    def failing(self) -> dict[str, str]:
        """The tables whose scan fails by itself, with the reason. Halves that can be scanned together are not looked into."""
        def scan(names: list[str]) -> dict[str, str]:
            if not names:
                return {}
            try:
                count_tables({n: self.tables[n] for n in names}, {n: self.fields[n] for n in names}).write.format("noop").mode("overwrite").save()
            except (PySparkException, Py4JJavaError) as e:
                if len(names) == 1:
                    return {names[0]: reason_of(e)}
                middle = len(names) // 2
                return scan(names[:middle]) | scan(names[middle:])
            return {}

        return scan(list(self.tables))

    def without(self, failed: dict[str, str]) -> TableSource:
        """This source without some tables, which are in `skipped` then, and their reasons in `reasons`."""
        out = copy(self)
        out.tables = {n: t for n, t in self.tables.items() if n not in failed}
        out.fields = {n: f for n, f in self.fields.items() if n not in failed}
        out.skipped = sorted([*self.skipped, *failed])
        out.reasons = self.reasons | failed
        return out

    def long_texts(self, cleaned: bool, column_ids: set[int]) -> DataFrame | None:
        """Whole texts longer than the head with their digest, in the profile or the summary domain.

        Only the columns asked for are read.
        """
        melted = [
            melt(df, [f for f in self.fields[name] if f.column_id in column_ids], TEXT)
            for name, df in self.tables.items()
        ]
        found = [m for m in melted if m is not None]
        return _long_texts(union_all(found), cleaned) if found else None

    def sample_rows(self) -> DataFrame:
        """(table_name, h, row_text): the SAMPLE_ROWS rows of each table with the smallest row hash."""
        return union_all([
            _smallest(
                df.selectExpr(f"concat_ws(' | ', {', '.join(map(_cell_text, self.fields[name]))}) as row_text")
            ).select(F.lit(name).alias("table_name"), "h", "row_text")
            for name, df in self.tables.items()
        ])


def reason_of(error: Exception) -> str:
    """The innermost message of an error, in one line."""
    found = [line.strip() for line in str(error).splitlines() if line.strip() and not line.strip().startswith(("at ", "..."))]
    causes = [line.removeprefix("Caused by:").strip() for line in found if line.startswith("Caused by:")]
    return (causes or found or [type(error).__name__])[-1 if causes else 0][:300]


def parquet_source(spark: SparkSession, folder: str) -> TableSource:
    """A source over every Parquet table of a folder (`<name>.parquet`, files or folders). Those that cannot be opened are skipped."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listing = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    tables, failed = {}, {}
    for name in sorted(f.getPath().getName() for f in listing):
        if not name.endswith(".parquet"):
            continue
        try:
            tables[name.removesuffix(".parquet")] = spark.read.parquet(f"{folder}/{name}")
        except (PySparkException, Py4JJavaError) as e:
            failed[name.removesuffix(".parquet")] = reason_of(e)
    return TableSource(tables, skipped=list(failed), reasons=failed)


class CellSource:
    """Many small tables in long form: `cells` (table_name, row_id, column_pos, column_id, type_class, v)
    and their `columns`. Where the cells can be counted in another way, `counted` is what `raw_counts` would make of them, and where long
    texts can be, `long_cells` returns (column_id, v) of those of some columns."""

    def __init__(self, cells: DataFrame, columns: DataFrame, skipped: list[str] | None = None, counted: DataFrame | None = None,
                 long_cells: Callable[[set[int]], DataFrame] | None = None) -> None:
        self.cells = cells
        self.counted = counted
        self.long_cells = long_cells
        self._columns = columns
        self.skipped = sorted(skipped or [])
        if columns.select("column_id").distinct().count() != columns.count():
            raise ValueError("Two columns have the same column_id; rename one of their tables.")

    @property
    def spark(self) -> SparkSession:
        return self.cells.sparkSession

    def columns(self) -> DataFrame:
        return self._columns

    def raw_counts(self) -> DataFrame:
        if self.counted is not None:
            return self.counted
        counted = count_text(self.cells.select(*COLUMN_KEY, "type_class", "v"))
        counted = counted.select(*COLUMN_KEY, "type_class", "v", "long", "n")
        number = F.when(F.col("type_class") == "numeric", F.col("v"))
        whole = number.try_cast("bigint")
        return counted.withColumns({"i": whole, "d": F.when(whole.isNull(), number.try_cast("double"))})

    def long_texts(self, cleaned: bool, column_ids: set[int]) -> DataFrame | None:
        if self.long_cells is not None:
            return _long_texts(self.long_cells(column_ids), cleaned)
        return _long_texts(self.cells.where(F.col("column_id").isin(*column_ids)), cleaned)

    def sample_rows(self) -> DataFrame:
        # The tables of this source are small files, so a row is put together from its own cells.
        rows = self.cells.groupBy("table_name", "row_id").agg(
            F.array_sort(F.collect_list(F.struct("column_pos", F.coalesce("v", F.lit("")).alias("v"))))
            .alias("cells")
        )
        texts = rows.select(
            "table_name", F.concat_ws(" | ", F.col("cells.v")).alias("row_text")
        ).withColumn("h", F.md5("row_text"))
        return top_per_group(texts, ["table_name"], [F.col("h"), F.col("row_text")], SAMPLE_ROWS)


def _long_texts(rows: DataFrame, cleaned: bool) -> DataFrame:
    texts = rows.withColumn("text", clean_value(F.col("v")) if cleaned else F.col("v"))
    return texts.where(F.length("text") > HEAD_CHARS).select(
        *COLUMN_KEY, digest(F.col("text")).alias("digest"), "text"
    )


def _cell_text(f: Field) -> str:
    return f"coalesce({text_sql(f'`{f.name}`', f.data_type)}, '')"


def _smallest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h", F.md5("row_text")).orderBy("h").limit(SAMPLE_ROWS)


class RenamedSource:
    """A source of one table, known under another name."""

    def __init__(self, source, table_name: str) -> None:
        self.source = source
        self.table_name = F.lit(table_name)
        self.skipped = source.skipped
        self.spark = source.spark
        self.raw_counts = source.raw_counts
        self.long_texts = source.long_texts

    def columns(self) -> DataFrame:
        return self.source.columns().withColumn("table_name", self.table_name)

    def sample_rows(self) -> DataFrame:
        return self.source.sample_rows().withColumn("table_name", self.table_name)

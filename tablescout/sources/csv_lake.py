"""Folders of CSV files, whatever their number and size.

There is one path for all files. Lines are read by Spark's text source, which splits large files. Whether a
split starts inside quotes is found first, from what each split does to either state, so that line breaks inside
quotes survive any split. The same pass gathers evidence of each file's dialect, and looks at each split by the one its own lines
speak for; only files with a split that spoke for another dialect are surveyed again. Then each task parses its
complete records, and the pieces of records that reach over a split are put together. Types are found while records are parsed; after
that, files are parsed again for what is wanted of them (counts, rows, long texts), and no table of all rows is written.

A table is a file that ends in .csv, or a folder that does, with such files in it (as Spark writes them).
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from operator import and_
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions.text import TYPE_TESTS, clean_column_names, text_sql, type_class_of
from tablescout.operators.counts import HEAD_CHARS, compact, number_text
from tablescout.sources.dialect import CANDIDATES, DEFAULT, EVIDENCE_DDL, EVIDENCE_LINES, EVIDENCE_SCHEMA, Dialect, choose, evidence, likely
from tablescout.sources.source import COLUMN_SCHEMA, CellSource, column_number
from tablescout.workspace import drop_written, materialize, small_frame

# The types of a wide table; a time of day stays text there, Spark having no settled type for it.
_SPARK_TYPES = {"timestamp": "timestamp_ntz", "time": "string"}

# Row number of what stands for lines that could not be decoded.
BAD_LINES = -1

# Where a record's number within its file ends and the number of the file within its table begins.
_FILE_BITS = 44

# Bytes of complete records that a task parses at once.
_PARSED_AT_ONCE = 4 << 20

_FILE_SCHEMA = pa.schema([("table_name", pa.string()), ("path", pa.string()), ("length", pa.int64())])


def _list_csv(spark: SparkSession, folder: str) -> list[dict]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def is_table(entry) -> bool:
        return entry.getPath().getName().lower().endswith(".csv")

    files = []
    for f in filter(is_table, fs.listStatus(path)):
        length = f.getLen() if f.isFile() or path.equals(f.getPath()) else sum(g.getLen() for g in filter(is_table, fs.listStatus(f.getPath())))
        files.append({"table_name": f.getPath().getName(), "path": f.getPath().toString(), "length": length})
    return sorted(files, key=lambda f: f["table_name"])


def discover_csv(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name, path, length) of the CSV files of a folder, from the listing alone."""
    return small_frame(spark, _FILE_SCHEMA, _list_csv(spark, folder)).orderBy("table_name")


def open_after(line: bytes, is_open: bool, dialect: Dialect = DEFAULT) -> bool:
    """Whether a quoted field is open after a line. A quote opens a field only where the field starts."""
    delimiter, quote, escape = dialect
    if not is_open and not line.startswith(quote) and delimiter + quote not in line:
        return False
    at = 0
    while True:
        if not is_open:
            if line[at : at + 1] != quote:
                at = line.find(delimiter, at)
                if at < 0:
                    return False
                at += 1
                continue
            at += 1
        end = line.find(quote, at)
        if escape:
            while end >= 0 and (end - at - len(line[at:end].rstrip(escape))) % 2:
                end = line.find(quote, end + 1)
        else:
            while end >= 0 and line[end + 1 : end + 2] == quote:
                end = line.find(quote, end + 2)
        if end < 0:
            return True
        is_open = False
        at = line.find(delimiter, end + 1)
        if at < 0:
            return False
        at += 1


class _Lines:
    """Consecutive lines of one split, each with its line break, as they lie in a batch."""

    def __init__(self, data: memoryview, offsets: np.ndarray, lines: pa.Array) -> None:
        self.data, self.offsets, self.lines = data, offsets, lines
        self._quoted: dict[bytes, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, start: int, end: int) -> memoryview:
        return self.data[self.offsets[start] : self.offsets[end]]

    def line(self, i: int) -> bytes:
        """One line without its break."""
        return bytes(self.data[self.offsets[i] : self.offsets[i + 1] - 1])

    def quoted(self, quote: bytes) -> np.ndarray:
        """The numbers of the lines that hold a quote."""
        if quote not in self._quoted:
            self._quoted[quote] = np.flatnonzero(pc.match_substring(self.lines, quote.decode()).to_numpy(zero_copy_only=False))
        return self._quoted[quote]


def _batch_parts(batch: pa.RecordBatch) -> Iterator[tuple[str, int, _Lines]]:
    """A batch cut where the split changes, and into parts of a bounded size."""
    if not batch.num_rows:
        return
    paths, blocks, lines = (batch.column(c) for c in ("path", "block", "line"))
    changes = pc.or_(pc.not_equal(paths[1:], paths[:-1]), pc.not_equal(blocks[1:], blocks[:-1])).to_numpy(zero_copy_only=False)
    width = np.int64 if pa.types.is_large_binary(lines.type) else np.int32
    _, where, data = lines.buffers()
    offsets = np.frombuffer(where, width)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
    bounds = np.concatenate([[0], np.flatnonzero(changes) + 1, [len(lines)]])
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        path, block = paths[start].as_py(), blocks[start].as_py()
        while start < end:
            stop = min(max(int(np.searchsorted(offsets, offsets[start] + _PARSED_AT_ONCE)), start + 1), end)
            at = offsets[start : stop + 1]
            yield path, block, _Lines(memoryview(data), at, lines.slice(start, stop - start))
            start = stop


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[_Lines]]]:
    """The lines of each split, in order and in parts. Lines of a split follow each other in a partition; a byte-order mark is left out."""
    parts = (part for b in batches for part in _batch_parts(b))
    pending = next(parts, None)
    while pending is not None:
        path, block = pending[:2]

        def lines() -> Iterator[_Lines]:
            nonlocal pending
            is_first = block == 0
            while pending is not None and pending[:2] == (path, block):
                part = pending[2]
                if is_first and bytes(part.raw(0, 1)).startswith(_MARK):
                    part.offsets = part.offsets.copy()
                    part.offsets[0] += len(_MARK)
                is_first = False
                yield part
                pending = next(parts, None)

        here = lines()
        yield path, block, here
        for _ in here:
            pass


_MARK = b"\xef\xbb\xbf"


class _State:
    """What the lines of a split do by one dialect, from either state. Only lines that hold a quote are looked at one by one."""

    def __init__(self, dialect: Dialect, is_first: bool) -> None:
        self.dialect = dialect
        self.after, self.ends, self.head, self.closed = [False, True], [False, False], [], not is_first

    def _ended(self) -> None:
        self.ends = [e or not s for e, s in zip(self.ends, self.after)]

    def _line(self, line: bytes) -> None:
        closed, opened = self.after
        after = open_after(line, closed, self.dialect)
        self.after = [after, after if closed == opened else open_after(line, opened, self.dialect)]
        self._ended()

    def feed(self, part: _Lines) -> None:
        at = 0
        while at < len(part) and not self.closed:
            line = part.line(at)
            self.head.append(line)
            self._line(line)
            self.closed, at = not self.after[0], at + 1
        quoted = part.quoted(self.dialect.quote)
        for i in quoted[np.searchsorted(quoted, at) :].tolist():
            if i > at:
                self._ended()
            self._line(part.line(i))
            at = i + 1
        if len(part) > at:
            self._ended()


def _survey(chosen: dict[str, int] | None):
    """What each split does: the state after it and whether a record ends in it, from either state; of a first one, the header.

    Without known dialects, the first lines of each split give evidence, and it is looked at by the dialect that they speak for.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, block, parts in _blocks(batches):
            first, seen, found = [], [], None
            if chosen is None:
                for part in parts:
                    seen.append(part)
                    first += [part.line(i) for i in range(min(len(part), EVIDENCE_LINES - len(first)))]
                    if len(first) >= EVIDENCE_LINES:
                        break
                found = evidence(first, block == 0)
            n = likely(found) if chosen is None else chosen[path]
            state = _State(CANDIDATES[n], block == 0)
            for part in chain(seen, parts):
                state.feed(part)
            yield pa.RecordBatch.from_pylist([{
                "path": path, "block": block, "candidate": n, "after_closed": state.after[0], "after_open": state.after[1], "ends": state.ends[1],
                "header": _header(state.head, state.dialect) if block == 0 else None,
                "evidence": found}], schema=_SURVEY)

    return run


def _header(head: list[bytes], dialect: Dialect) -> list[str]:
    text = b"\n".join(head).decode("utf-8", "replace")
    delimiter, quote, escape = (x.decode() for x in dialect)
    records = csv.reader(
        io.StringIO(text, newline=""), delimiter=delimiter, quotechar=quote, escapechar=escape or None, doublequote=not escape)
    return next((r for r in records if r), [])


_SURVEY_DDL = f"path string, block bigint, candidate int, after_closed boolean, after_open boolean, ends boolean, header array<string>, evidence {EVIDENCE_DDL}"
_SURVEY = pa.schema([
    ("path", pa.string()), ("block", pa.int64()), ("candidate", pa.int32()), ("after_closed", pa.bool_()), ("after_open", pa.bool_()), ("ends", pa.bool_()),
    ("header", pa.list_(pa.string())), ("evidence", EVIDENCE_SCHEMA)])


class Layout:
    """What tasks have to know of the files: dialects, column numbers, and the splits that start inside quotes with the split their
    record starts in."""

    def __init__(self, surveyed: list, dialects: dict[str, Dialect]) -> None:
        self.dialects = dialects
        self.headers: dict[str, list[str]] = {}
        self.open_blocks: dict[tuple[str, int], int] = {}
        is_open, owner, path = False, 0, None
        for r in sorted(surveyed, key=lambda r: (r["path"], r["block"])):
            if r["path"] != path:
                path, is_open, owner = r["path"], False, 0
            if r["header"] is not None:
                self.headers[path] = clean_column_names(r["header"])
            if is_open:
                self.open_blocks[path, r["block"]] = owner
            if not is_open or r["ends"]:
                owner = r["block"]
            is_open = r["after_open"] if is_open else r["after_closed"]
        self.widths = {path: len(header) for path, header in self.headers.items()}
        # Files of one table are numbered, so that their records have numbers of their own.
        self.tables: dict[str, list[str]] = {}
        for path in sorted(self.headers):
            self.tables.setdefault(_table_of(path), []).append(path)
        self.numbers = {path: i for paths in self.tables.values() for i, path in enumerate(paths)}
        # Known once the types have been found: by table and position, the types of columns that hold a value.
        self.types: dict[tuple[str, int], str] = {}

    def dialect(self, path: str) -> Dialect:
        return self.dialects.get(path, DEFAULT)


def _parsed(path: str, raw: bytes, layout: Layout, sink, first_id: int, skip: int, own: int | None = None) -> Iterator[pa.RecordBatch]:
    """What the sink makes of complete records, given as columns of texts. Records of another width than the header go, empty fields are NULL."""
    width, (delimiter, quote, escape) = layout.widths[path], layout.dialect(path)
    names = [str(i) for i in range(width)]
    table = pyarrow.csv.read_csv(
        pa.BufferReader(raw),
        read_options=pyarrow.csv.ReadOptions(column_names=names, block_size=len(raw) + 1, use_threads=False),
        parse_options=pyarrow.csv.ParseOptions(
            delimiter=delimiter.decode(), quote_char=quote.decode(), escape_char=escape.decode() or False, double_quote=not escape,
            newlines_in_values=True, invalid_row_handler=lambda row: "skip"),
        convert_options=pyarrow.csv.ConvertOptions(
            column_types={n: pa.binary() for n in names}, null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=True),
    ).slice(skip).combine_chunks()
    n = table.num_rows
    if not n:
        return
    columns = [c.chunk(0) for c in table.columns]
    ids = np.full(n, own) if own is not None else first_id + (layout.numbers[path] << _FILE_BITS) + np.arange(n)
    try:
        columns = [c.cast(pa.string()) for c in columns]
    except pa.ArrowInvalid:
        fine = np.array([[_is_text(x) for x in c.to_pylist()] for c in columns]).all(axis=0)
        yield from sink.bad(path)
        columns, ids = [c.filter(pa.array(fine)).cast(pa.string()) for c in columns], ids[fine]
    if len(ids):
        yield from sink.records(path, columns, ids)


def _is_text(value: bytes | None) -> bool:
    try:
        return value is None or value.decode() is not None
    except UnicodeDecodeError:
        return False


class _Sink:
    """What a pass over the files makes of their records. Pieces of records are only wanted by the first such pass."""

    ddl = ""

    def __init__(self, layout: Layout) -> None:
        self.layout = layout

    def records(self, path: str, columns: list[pa.Array], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from ()

    def bad(self, path: str) -> Iterator[pa.RecordBatch]:
        """There are records that could not be decoded."""
        yield from ()

    def piece(self, path: str, owner: int, block: int, lines: list) -> Iterator[pa.RecordBatch]:
        yield from ()

    def end(self, path: str) -> Iterator[pa.RecordBatch]:
        """A split of a file has ended."""
        yield from ()


_ALL_FITS = (1 << len(TYPE_TESTS)) - 1


def _fits(*types: str) -> int:
    return sum(1 << i for i, name in enumerate(TYPE_TESTS) if name in types)


_DAY = "[1-9][0-9]{3}-(?:(?:0[1-9]|1[0-2])-(?:0[1-9]|1[0-9]|2[0-8])|(?:0[13-9]|1[0-2])-(?:29|30)|(?:0[13578]|1[02])-31)"
_CLOCK = "(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"
# Texts of which it is sure which tests they pass, by pattern. All others are tested by TYPE_TESTS themselves.
_SURE = [
    ("^[+-]?[0-9]{1,17}$", _fits("bigint", "decimal(38,0)", "double")),
    # 17 digits at most, with a point or an exponent.
    (r"^[+-]?(?:[0-9]{0,15}[.][0-9]{1,2}|[0-9]{0,12}[.][0-9]{1,5}|[0-9]{0,7}[.][0-9]{1,10}|[0-9]{0,3}[.][0-9]{1,14}|[0-9]?[.][0-9]{1,16}|0?[.][0-9]{17}"
     r"|[0-9]{1,17}[.])(?:[eE][+-]?[0-9]+)?$", _fits("double")),
    # A character that no type has, nor the end of a line.
    (r"[^-0-9+.:TtRrUuEeFfAaLlSs \n\r\x{85}\x{2028}\x{2029}]", 0),
    (f"^{_DAY}[ T]{_CLOCK}(?:[.][0-9]{{1,6}})?$", _fits("timestamp")),
    (f"^{_DAY}$", _fits("date")),
    ("^(?:[01]?[0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:[.][0-9]+)?$", _fits("time")),
    ("^(?:[Tt][Rr][Uu][Ee]|[Ff][Aa][Ll][Ss][Ee])$", _fits("boolean")),
    ("^[+-]?(?:[1-9][0-9]{17}|[1-8][0-9]{18})$", _fits("bigint", "decimal(38,0)")),
    ("^[+-]?[1-9][0-9]{19,37}$", _fits("decimal(38,0)")),
]

# Texts of a column that are handed on at once to be tested.
_UNSURE_AT_ONCE = 10_000


class _Fits:
    """The tests that all values of a column pass, as bits, and the texts that have yet to be tested."""

    def __init__(self) -> None:
        self.fits, self.present, self.unsure, self.last = _ALL_FITS, False, set(), 0

    def add(self, values: pa.Array) -> None:
        if not self.fits:
            return
        values = values.drop_null()
        self.present = self.present or len(values) > 0
        # The kind of text that was there before comes first.
        for k in [self.last, *(k for k in range(len(_SURE)) if k != self.last)]:
            if not len(values):
                return
            pattern, fits = _SURE[k]
            sure = pc.match_substring_regex(values, pattern)
            if sure.true_count:
                self.fits, self.last = self.fits & fits, k
                if not self.fits:
                    self.unsure = set()
                    return
                values = values.filter(pc.invert(sure))
        self.unsure.update(pc.unique(values).to_pylist())


def _first_type(fits: int) -> str:
    return next((name for i, name in enumerate(TYPE_TESTS) if fits >> i & 1), "string")


class _Types(_Sink):
    """The tests each column's values pass, one row for each column of a split (number -1: there are bad records), and pieces of records."""

    ddl = "path string, column_pos int, fits int, present boolean, texts array<string>, owner bigint, block bigint, piece binary"
    _schema = pa.schema([
        ("path", pa.string()), ("column_pos", pa.int32()), ("fits", pa.int32()), ("present", pa.bool_()), ("texts", pa.list_(pa.string())),
        ("owner", pa.int64()), ("block", pa.int64()), ("piece", pa.binary())])

    def __init__(self, layout: Layout) -> None:
        super().__init__(layout)
        self.found: list[_Fits] = []

    def _told(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=self._schema)

    def _row(self, path: str, i: int) -> dict:
        c = self.found[i]
        texts, c.unsure = list(c.unsure), set()
        return {"path": path, "column_pos": i, "fits": c.fits, "present": c.present, "texts": texts}

    def records(self, path, columns, ids):
        self.found = self.found or [_Fits() for _ in columns]
        for i, (found, values) in enumerate(zip(self.found, columns, strict=True)):
            found.add(values)
            if len(found.unsure) > _UNSURE_AT_ONCE:
                yield self._told([self._row(path, i)])

    def bad(self, path):
        yield self._told([{"path": path, "column_pos": BAD_LINES, "fits": 0, "present": False, "texts": []}])

    def piece(self, path, owner, block, lines):
        yield self._told([{"path": path, "owner": owner, "block": block, "piece": b"".join(lines)[:-1]}])

    def end(self, path):
        if self.found:
            yield self._told([self._row(path, i) for i in range(len(self.found))])
        self.found = []


# How the values of a column are counted, by its type; 0 as they stand.
_KINDS = {"bigint": 1, "double": 2, "timestamp": 3, "boolean": 4, "decimal(38,0)": 5}


class _Counts(_Sink):
    """Texts of each column with their number, in a few megabytes of records at a time."""

    ddl = "column_id bigint, kind tinyint, v string, n bigint"

    def records(self, path, columns, ids):
        table = _table_of(path)
        counted = [c.value_counts() for c in columns]
        sizes = [len(c) for c in counted]
        kinds = [_KINDS.get(self.layout.types.get((table, i)), 0) for i in range(len(columns))]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat([column_number(table, i) for i in range(len(columns))], sizes), pa.int64()), pa.array(np.repeat(kinds, sizes), pa.int8()),
            pa.concat_arrays([c.field("values") for c in counted]), pa.concat_arrays([c.field("counts") for c in counted])],
            names=["column_id", "kind", "v", "n"])


class _Rows(_Sink):
    """Whole records, as arrays of texts."""

    ddl = "table_name string, row_id bigint, fields array<string>"

    def records(self, path, columns, ids):
        n, width = len(ids), len(columns)
        by_row = np.arange(n * width)
        cells = pa.concat_arrays(columns).take(pa.array(by_row % width * n + by_row // width))
        yield pa.RecordBatch.from_arrays([
            pa.repeat(_table_of(path), n), pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), cells)],
            names=["table_name", "row_id", "fields"])


def _wide(names: list[str]) -> type[_Sink]:
    """Whole records as columns of texts, of files that have at least so many."""
    class Wide(_Sink):
        ddl = ", ".join(f"{c} string" for c in names)

        def records(self, path, columns, ids):
            if len(columns) < len(names):
                raise ValueError(f"{path} has {len(columns)} columns, another file of its table {len(names)}.")
            yield pa.RecordBatch.from_arrays(columns[: len(names)], names=names)

    return Wide


def _long_of(column_ids: set[int]) -> type[_Sink]:
    """Texts of some columns that are longer than the head."""
    class Long(_Sink):
        ddl = "column_id bigint, v string"

        def records(self, path, columns, ids):
            for i, values in enumerate(columns):
                number = column_number(_table_of(path), i)
                if number in column_ids:
                    values = values.filter(pc.fill_null(pc.greater(pc.utf8_length(values), HEAD_CHARS), False))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), number), pa.int64()), values], names=["column_id", "v"])

    return Long


def _parse_splits(layout: Layout, make: type[_Sink]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = make(layout)
        for path, block, parts in _blocks(batches):
            if not layout.widths.get(path, 0):
                continue
            dialect = layout.dialect(path)
            owner = layout.open_blocks.get((path, block))
            is_open = owner is not None
            # Text of the record that is open, text of complete records, lines seen, and the number of lines before the complete records.
            record, done, held, seen, n_done, skip = [], [], 0, 0, 0, int(block == 0)
            for part in parts:
                # Lines before `start` are done with; those before `end` are complete records.
                start = end = at = 0
                for i in [*part.quoted(dialect.quote).tolist(), len(part)]:
                    if not is_open:
                        end = i
                    if i == len(part):
                        break
                    is_open, at = open_after(part.line(i), is_open, dialect), i + 1
                    if not is_open and owner is not None:
                        yield from sink.piece(path, owner, block, [*record, part.raw(start, at)])
                        owner, record, start = None, [], at
                    if not is_open:
                        end = at
                if end > start:
                    # What was open is the beginning of the first of these records.
                    done += [*record, part.raw(start, end)]
                    held += sum(map(len, record)) + len(done[-1])
                    record, start = [], end
                if start < len(part):
                    record.append(bytes(part.raw(start, len(part))))
                if held > _PARSED_AT_ONCE:
                    yield from _parsed(path, b"".join(done), layout, sink, block + n_done, skip)
                    done, held, n_done, skip = [], 0, seen + end, 0
                else:
                    # The batch goes; what is kept is copied.
                    done = [bytes(d) for d in done]
                seen += len(part)
            if done:
                yield from _parsed(path, b"".join(done), layout, sink, block + n_done, skip)
            if record:
                yield from sink.piece(path, block if owner is None else owner, block, record)
            yield from sink.end(path)

    return run


def _parse_pieces(layout: Layout, make: type[_Sink]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = make(layout)
        for batch in batches:
            for path, owner, pieces in zip(*(batch.column(c).to_pylist() for c in ("path", "owner", "pieces"))):
                # At most one record starts in a split and ends behind it; numbers below zero are only used for those.
                own = BAD_LINES - 1 - ((layout.numbers[path] << _FILE_BITS) | owner)
                yield from _parsed(path, b"\n".join(pieces), layout, sink, 0, 0, own)
                yield from sink.end(path)

    return run


class _Files:
    """CSV files whose dialects, layout and types are known, to be parsed once more for each thing wanted of them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        reader = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.[cC][sS][vV]").option("recursiveFileLookup", True)
        self._lines = reader.text(path).select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line"))
        # One small row for each split of a file.
        surveyed = materialize(self._lines.mapInArrow(_survey(None), _SURVEY_DDL), "csv_splits")
        chosen = {r["path"]: r["candidate"] for r in choose(surveyed).filter("candidate > 0").collect()}
        splits = surveyed.drop("evidence").collect()
        drop_written(surveyed)
        again = {r["path"]: chosen.get(r["path"], 0) for r in splits if r["candidate"] != chosen.get(r["path"], 0)}
        if again:
            splits = [r for r in splits if r["path"] not in again]
            splits += self._of(again).mapInArrow(_survey(again), _SURVEY_DDL).drop("evidence").collect()
        self.layout = Layout(splits, {path: CANDIDATES[n] for path, n in chosen.items()})
        found = materialize(self._lines.mapInArrow(_parse_splits(self.layout, _Types), _Types.ddl), "csv_types")
        pieces = found.where("piece is not null")
        self._pieces = pieces.groupBy("path", "owner").agg(
            F.array_sort(F.collect_list(F.struct("block", "piece"))).alias("p")).select("path", "owner", F.col("p.piece").alias("pieces"))
        self._has_pieces = bool(self.layout.open_blocks) or not pieces.isEmpty()
        tested = found.where("piece is null").drop("owner", "block", "piece")
        if self._has_pieces:
            tested = tested.unionByName(self._pieces.mapInArrow(_parse_pieces(self.layout, _Types), _Types.ddl).drop("owner", "block", "piece"))
            tested = materialize(tested, "csv_fits")
        # Tables with records, and of those the ones that hold bytes that are no text.
        self.tables: set[str] = set()
        self.as_text: set[str] = set()
        # By table and position, the tests that all values pass, of columns that hold one.
        self.fits: dict[tuple[str, int], int] = {}
        self._find_types(tested)
        for done in [tested, *([] if self._has_pieces else [found])]:
            drop_written(done)

    def _find_types(self, tested: DataFrame) -> None:
        """Each column's first type that all its values fit."""
        column = ["path", "column_pos"]
        # One row for each column of each file.
        rows = tested.groupBy(*column).agg(F.bit_and("fits").alias("fits"), F.max("present").alias("present")).collect()
        outcome = reduce(Column.bitwiseOR, [F.when(F.expr(test), 1 << i).otherwise(0) for i, test in enumerate(TYPE_TESTS.values())])
        unsure = tested.where("fits <> 0").select(*column, F.explode("texts").alias("v"))
        by_test = {(r["path"], r["column_pos"]): r["fits"] for r in unsure.groupBy(*column).agg(F.bit_and(outcome).alias("fits")).collect()}
        for r in rows:
            table = _table_of(r["path"])
            if r["column_pos"] == BAD_LINES:
                self.as_text.add(table)
                continue
            self.tables.add(table)
            if r["present"]:
                key = table, r["column_pos"]
                self.fits[key] = self.fits.get(key, _ALL_FITS) & r["fits"] & by_test.get((r["path"], r["column_pos"]), _ALL_FITS)
        self.layout.types = {key: "string" if key[0] in self.as_text else _first_type(bits) for key, bits in self.fits.items()}

    def _of(self, paths) -> DataFrame:
        """The lines of some files."""
        return self._lines.where(F.col("path").isin(*paths))

    def parse(self, make: type[_Sink], paths: list[str] | None = None) -> DataFrame:
        """What a sink makes of all records, or of those of some files."""
        lines = self._lines if paths is None else self._of(paths)
        out = lines.mapInArrow(_parse_splits(self.layout, make), make.ddl)
        if not self._has_pieces:
            return out
        pieces = self._pieces if paths is None else self._pieces.where(F.col("path").isin(*paths))
        return out.unionByName(pieces.mapInArrow(_parse_pieces(self.layout, make), make.ddl))


def read_csv(spark: SparkSession, path: str, as_strings: bool = False) -> DataFrame:
    """S2 (typed) or S3 (all text): one table from a CSV file or a folder of CSV files with the same header, of any dialects.

    Records that do not fit the header are dropped. A file with bytes that are no UTF-8 is read as text, without those
    records. The typed table is written once.
    """
    files = _Files(spark, path)
    headers = files.layout.headers
    first = next((p for p in sorted(headers) if headers[p]), None)
    if first is None:
        return files.parse(_Rows).select()
    header = headers[first]
    names = [f"c{i}" for i in range(len(header))]
    kinds = ["string"] * len(header)
    if not as_strings and not files.as_text:
        # All files are one table here, whatever their names.
        fits = [[bits for (_, pos), bits in files.fits.items() if pos == i] for i in range(len(header))]
        kinds = [_first_type(reduce(and_, of_column)) if of_column else "string" for of_column in fits]
    rows = files.parse(_wide(names))
    return materialize(rows.select(*[F.col(c).try_cast(_SPARK_TYPES.get(kind, kind)).alias(c) for c, kind in zip(names, kinds)]), "csv_table").toDF(*header)


def csv_source(spark: SparkSession, folder: str) -> CellSource:
    """A profile source over every table of a folder (or one file); those without a record end up in `skipped`.

    Files of one table may differ in dialect; a table has as many columns as the longest of its headers, and records that
    do not fit their file's header go.
    """
    listed = _list_csv(spark, folder)
    if not listed:
        raise ValueError(f"{folder} holds no file that ends in .csv")
    files = _Files(spark, folder)
    layout = files.layout
    rows = []
    for table, paths in layout.tables.items():
        header = max((layout.headers[p] for p in paths), key=len) if table in files.tables else []
        for i, name in enumerate(header):
            data_type = layout.types.get((table, i), "string")
            rows.append({"column_id": column_number(table, i), "table_name": table, "column_pos": i, "column_name": name, "data_type": data_type,
                         "type_class": type_class_of(data_type)})
    columns = small_frame(spark, COLUMN_SCHEMA, rows)
    cells = files.parse(_Rows).select("table_name", "row_id", F.posexplode("fields").alias("column_pos", "v"))
    typed = cells.join(columns.drop("column_name"), ["table_name", "column_pos"]).select(
        "table_name", "row_id", "column_pos", "column_id", "type_class", typed_text().alias("v"))

    def long_cells(column_ids: set[int]) -> DataFrame:
        tables = {r["table_name"] for r in rows if r["column_id"] in column_ids}
        return files.parse(_long_of(column_ids), [p for t in sorted(tables) for p in layout.tables[t]])

    counts = _typed_counts(files.parse(_Counts), columns)
    return CellSource(typed, columns, [f["table_name"] for f in listed if f["table_name"] not in files.tables], counts, long_cells)


def _typed_counts(counted: DataFrame, columns: DataFrame) -> DataFrame:
    """The counts of `typed_text` of every value, from counts of parts of the texts (column_id, kind, v, n). Numbers are added up as such; a
    negative zero is a value of its own."""
    kind, v = F.col("kind"), F.col("v")
    numbers = counted.withColumns({"i": F.when(kind == 1, v.try_cast("bigint")), "d": F.when(kind == 2, v.try_cast("double"))})
    text = (
        F.when(kind == 1, None)
        .when(kind == 2, F.when((F.col("d") == 0) & v.startswith("-"), "-0.0"))
        .when(kind == 3, F.coalesce(v.try_cast("timestamp_ntz").cast("string"), v))
        .when(kind == 4, F.lower(v))
        .when(kind == 5, v.try_cast("decimal(38,0)").cast("string"))
        .otherwise(v))
    added = compact(numbers.withColumn("v", text).drop("kind")).groupBy("column_id", "v", "long", "i", "d").agg(F.sum("n").alias("n"))
    wide = F.when(F.col("data_type") == "decimal(38,0)", v)
    placed = added.join(columns.select("column_id", "type_class", "data_type"), "column_id")
    return placed.select(
        "column_id", "type_class", F.coalesce(v, number_text()).alias("v"), "long", F.coalesce("i", wide.try_cast("bigint")).alias("i"),
        F.when(F.col("data_type") == "double", F.when(v == "-0.0", F.lit("-0.0").cast("double")).otherwise(F.col("d")))
        .when(wide.try_cast("bigint").isNull(), wide.try_cast("double")).alias("d"), "n")


def _table_of(path: str) -> str:
    """A file's table: the folder it lies in if that ends in .csv, else the file itself."""
    *_, folder, name = ["", *map(unquote, path.split("/"))]
    return folder if folder.lower().endswith(".csv") else name


def infer_types(cells: DataFrame) -> DataFrame:
    """(table_name, column_pos, data_type), the first type that all values of a column fit.

    Where `v` is only the head of a value, `fits` has the outcomes of the tests on the whole of it. Without `fits`, each different value is
    tested once; of long ones, only the outcomes are told apart.
    """
    if "fits" not in cells.columns:
        is_long = F.length("v") > HEAD_CHARS
        tested = F.when(is_long, F.array(*[F.expr(test) for test in TYPE_TESTS.values()]))
        cells = cells.select(
            "table_name", "column_pos", F.when(is_long, "").otherwise(F.col("v")).alias("v"), tested.alias("fits")).distinct()
    fits = [F.count_if(F.coalesce(F.col("fits")[i], F.expr(test))).alias(f"_{i}") for i, test in enumerate(TYPE_TESTS.values())]
    counted = cells.where(F.col("v").isNotNull()).groupBy("table_name", "column_pos").agg(F.count("*").alias("_all"), *fits)
    # Whole numbers also pass the test of doubles, so a mixed column becomes a double.
    kind = F.lit("string")
    for i, name in reversed(list(enumerate(TYPE_TESTS))):
        kind = F.when(F.col(f"_{i}") == F.col("_all"), name).otherwise(kind)
    return counted.select("table_name", "column_pos", kind.alias("data_type"))


def typed_text() -> Column:
    """The text a value `v` has once it is read as its type (`007` becomes `7`)."""
    data_type, v = F.col("data_type"), F.col("v")
    return (
        F.when(data_type == "bigint", v.try_cast("bigint").cast("string"))
        .when(data_type == "decimal(38,0)", v.try_cast("decimal(38,0)").cast("string"))
        .when(data_type == "double", F.expr(text_sql("try_cast(v as double)", T.DoubleType())))
        .when(data_type == "timestamp", F.coalesce(v.try_cast("timestamp_ntz").cast("string"), v))
        .when(data_type == "boolean", F.lower(v))
        .otherwise(v)
    )

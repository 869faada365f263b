"""The dialect of a CSV file (delimiter, quote, escape), from how evenly each candidate cuts its lines into fields.

Every split gives, for every candidate, how many of its records have how many fields. These counts are added up by file, and
the candidate is chosen whose records have the header's number of fields most often.
"""

from __future__ import annotations

from collections import Counter
from itertools import product
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Dialect(NamedTuple):
    delimiter: bytes = b","
    quote: bytes = b'"'
    # Empty: a quote inside a quoted field is doubled.
    escape: bytes = b""


DEFAULT = Dialect()
# In order of preference.
CANDIDATES = [Dialect(*parts) for parts in product((b",", b";", b"\t", b"|"), (b'"', b"'"), (b"", b"\\"))]

# Lines at the start of each split that give evidence. The number of splits, and with it the evidence, grows with the file.
EVIDENCE_LINES = 500

EVIDENCE_SCHEMA = pa.list_(pa.struct([
    ("candidate", pa.int32()), ("width", pa.int32()), ("records", pa.int64()), ("broken", pa.int64()), ("useful", pa.int64()), ("header", pa.bool_())]))
EVIDENCE_DDL = "array<struct<candidate:int, width:int, records:bigint, broken:bigint, useful:bigint, header:boolean>>"


class Line(NamedTuple):
    """What a line does: whether a quoted field is open after it, delimiters outside quotes, quoted fields with text after their end,
    and quoted fields that hold a delimiter or an escaped quote."""

    is_open: bool
    delimiters: int
    broken: int
    useful: int


def read_line(line: bytes, is_open: bool, dialect: Dialect = DEFAULT) -> Line:
    """Follow one line. A quote opens a field only at the field's start; after its end, all up to the next delimiter is text."""
    delimiter, quote, escape = dialect
    at = delimiters = broken = useful = 0
    while True:
        if not is_open:
            if line[at : at + 1] != quote:
                if quote not in line:
                    return Line(False, delimiters + line.count(delimiter, at), broken, useful)
                at = line.find(delimiter, at)
                if at < 0:
                    return Line(False, delimiters, broken, useful)
                delimiters, at = delimiters + 1, at + 1
                continue
            at += 1
        start, marked = at, False
        end = line.find(quote, at)
        while end >= 0:
            if escape:
                before = end
                while before > at and line[before - 1 : before] == escape:
                    before -= 1
                if (end - before) % 2 == 0:
                    break
                end, marked = line.find(quote, end + 1), True
            else:
                if line[end + 1 : end + 2] != quote:
                    break
                end = line.find(quote, end + 2)
        if end < 0:
            return Line(True, delimiters, broken, useful)
        is_open = False
        useful += marked or delimiter in line[start:end]
        at = line.find(delimiter, end + 1)
        rest = line[end + 1 : at if at >= 0 else len(line)]
        broken += bool(rest.strip(b" \r"))
        if at < 0:
            return Line(False, delimiters, broken, useful)
        delimiters, at = delimiters + 1, at + 1


def _from_state(lines: list[bytes], is_open: bool, dialect: Dialect) -> tuple[Counter, int, int, int | None]:
    """Records by number of fields, broken and useful quotes, and the first record's number of fields.

    The record that is open at the start counts for nothing, empty lines do not either.
    """
    widths: Counter[int] = Counter()
    skip, fields, broken, useful, first = is_open, 1, 0, 0, None
    for line in lines:
        if not is_open and not line.strip(b"\r"):
            continue
        found = read_line(line, is_open, dialect)
        fields, is_open = fields + found.delimiters, found.is_open
        broken, useful = broken + found.broken, useful + found.useful
        if not is_open:
            if not skip:
                widths[fields] += 1
                first = fields if first is None else first
            skip, fields = False, 1
    return widths, broken, useful, first


def evidence(lines: list[bytes], is_first: bool) -> list[dict]:
    """One row for each candidate and number of fields, in the first lines of a split.

    Only a file's first split is known to start outside of quotes; others are read from either state, and the
    state counts whose records agree better.
    """
    quoted = {q: any(q in line for line in lines) for q in (b'"', b"'")}
    escaped = any(b"\\" in line for line in lines)
    out, known = [], {}
    for number, dialect in enumerate(CANDIDATES):
        # A dialect that differs from an earlier one only in what does not occur here reads these lines alike.
        same = (dialect.delimiter, dialect.quote if quoted[dialect.quote] else b"", dialect.escape if escaped and quoted[dialect.quote] else b"")
        if same not in known:
            states = [_from_state(lines, False, dialect)]
            if not is_first and quoted[dialect.quote]:
                states.append(_from_state(lines, True, dialect))
            known[same] = max(states, key=lambda s: (max(s[0].values(), default=0) / max(s[0].total(), 1), -s[1]))
        widths, broken, useful, first = known[same]
        for i, (width, records) in enumerate(widths.items()):
            once = i == 0
            out.append({"candidate": number, "width": width, "records": records, "broken": broken * once, "useful": useful * once, "header": False})
        if is_first and first is not None:
            by_this = quoted[dialect.quote] and any(line.startswith(dialect.quote) for line in lines[:1])
            out.append({"candidate": number, "width": first, "records": 0, "broken": 0, "useful": int(by_this), "header": True})
    return out


def likely(found: list[dict]) -> int:
    """The candidate that one split's evidence speaks for, in the order of `choose`; which one a file has is settled by all its splits."""
    best, order = 0, None
    for number, dialect in enumerate(CANDIDATES):
        rows = [r for r in found if r["candidate"] == number and not r["header"]]
        head = next((r for r in found if r["candidate"] == number and r["header"]), None)
        if not rows:
            continue
        quoted_head = head["useful"] if head else 0
        if not (sum(r["useful"] for r in rows) or not dialect.escape and (dialect.quote != b"'" or quoted_head)):
            continue
        width = head["width"] if head else max(rows, key=lambda r: r["records"])["width"]
        share = sum(r["records"] for r in rows if r["width"] == width) / sum(r["records"] for r in rows)
        place = width >= 2, share, width, quoted_head, -sum(r["broken"] for r in rows), -number
        if order is None or place > order:
            best, order = number, place
    return best


def choose(surveyed: DataFrame) -> DataFrame:
    """(path, candidate) of every file with a record, from (path, evidence) of all its splits.

    The records that have the header's number of fields (two at least) decide, then the number of fields. Single quotes and
    backslashes are only taken for quotes and escapes where they are used as such: around a delimiter or
    before a quote, or around the header's first name.
    """
    rows = surveyed.select("path", F.explode("evidence").alias("e")).select("path", "e.*")
    counts = rows.groupBy("path", "candidate").agg(
        F.max(F.when(F.col("header"), F.col("width"))).alias("columns"), F.sum("records").alias("records"), F.sum("broken").alias("broken"),
        F.sum(F.when(~F.col("header"), F.col("useful"))).alias("useful"), F.max(F.when(F.col("header"), F.col("useful"))).alias("quoted_head"))
    headers = rows.filter("header").select("path", "candidate", F.col("width").alias("columns"))
    fitting = rows.filter("not header").join(headers, ["path", "candidate"]).filter("width = columns").groupBy("path", "candidate").agg(
        F.sum("records").alias("fitting"))
    scored = counts.join(fitting, ["path", "candidate"], "left").withColumn(
        "share", F.coalesce("fitting", F.lit(0)) / F.greatest("records", F.lit(1)))
    escaping = [i for i, d in enumerate(CANDIDATES) if d.escape]
    single = [i for i, d in enumerate(CANDIDATES) if d.quote == b"'"]
    fits = (F.col("useful") > 0) | ~F.col("candidate").isin(escaping) & (~F.col("candidate").isin(single) | (F.col("quoted_head") > 0))
    best = F.row_number().over(Window.partitionBy("path").orderBy(
        F.desc(F.coalesce(F.col("columns") >= 2, F.lit(False))), F.desc("share"), F.desc("columns"), F.desc("quoted_head"), "broken", "candidate"))
    return scored.filter(fits).withColumn("best", best).filter("best = 1").select("path", "candidate")

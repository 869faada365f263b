"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Every byte of a text starts a few triplets within a window of five bytes. Triplets are hashed into buckets and
counted; each bucket is encoded by the quartile of the counts it falls in (two bits). A header holds the length on a log scale
and the ratios of the quartiles. Two digests are compared by a bounded difference score.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.llm.arrow_text import SLICE_BYTES, append_columns, bound_batches, utf8

BUCKETS = 128
# The bytes of a triplet, counted from the window's first.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))
# Difference at which two digests count as unlike: about that of digests with independent buckets.
BOUND = 208.0
_PREFIX = "Q1"


def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of BUCKETS + 3 small numbers for each text: length code, two quartile ratios, bucket quartiles."""
    n_texts = len(offsets) - 1
    sizes = np.diff(offsets)
    counts = np.zeros((n_texts, BUCKETS), np.int64)
    if len(data) >= 3:
        text = np.repeat(np.arange(n_texts, dtype=np.int64), sizes)
        room = np.repeat(offsets[1:], sizes) - np.arange(len(data))
        wide = data.astype(np.uint32)
        for k, (a, b, c) in enumerate(TRIPLETS):
            m = len(data) - c
            if m <= 0:
                continue
            key = (wide[a : a + m] << np.uint32(16)) | (wide[b : b + m] << np.uint32(8)) | wide[c : c + m]
            key = (key + np.uint32(k << 24)) * np.uint32(0x9E3779B1)
            key ^= key >> np.uint32(15)
            key *= np.uint32(0x85EBCA77)
            bucket = (key >> np.uint32(25)).astype(np.int64)
            inside = room[:m] > c
            slot = text[:m][inside] * BUCKETS + bucket[inside]
            counts += np.bincount(slot, minlength=n_texts * BUCKETS).reshape(n_texts, BUCKETS)
    ranked = np.sort(counts, axis=1)
    q = [ranked[:, BUCKETS * i // 4 - 1][:, None] for i in (1, 2, 3)]
    out = np.zeros((n_texts, BUCKETS + 3), np.int64)
    out[:, 0] = np.minimum(255, np.round(np.log2(sizes + 1) * 8)).astype(np.int64)
    top = np.maximum(q[2][:, 0], 1)
    out[:, 1] = np.minimum(15, q[0][:, 0] * 15 // top)
    out[:, 2] = np.minimum(15, q[1][:, 0] * 15 // top)
    out[:, 3:] = (counts > q[0]).astype(np.int64) + (counts > q[1]) + (counts > q[2])
    return out


def as_text(rows: np.ndarray) -> list[str]:
    """Digests as strings: a version mark, the header and the buckets in hexadecimal."""
    quads = rows[:, 3:].reshape(len(rows), -1, 4)
    packed = (quads[..., 0] << 6 | quads[..., 1] << 4 | quads[..., 2] << 2 | quads[..., 3]).astype(np.uint8)
    return [f"{_PREFIX}{r[0]:02x}{r[1]:x}{r[2]:x}{p.tobytes().hex()}" for r, p in zip(rows.tolist(), packed)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 from a difference of BOUND up.

    A bucket counts the distance of its quartiles, and twice that between the outermost ones; the length code
    counts up to 24, each ratio up to 15.
    """
    apart = np.abs(a[:, 3:] - b[:, 3:])
    body = (apart + 3 * (apart == 3)).sum(axis=1)
    header = np.minimum(24, np.abs(a[:, 0] - b[:, 0])) + np.abs(a[:, 1:3] - b[:, 1:3]).sum(axis=1)
    return np.clip(1.0 - (body + header) / BOUND, 0.0, 1.0)


def fingerprint(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """`docs` with a `fingerprint` of each whole text. A null counts as an empty text; equal texts have equal ones."""
    fields = T.StructType([T.StructField("fingerprint", T.StringType())])
    return append_columns(docs, text_column, lambda t: [pa.array(as_text(digests(*utf8(t))), pa.string())], fields)


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the rising `bounds` are at most `value`, found in two steps of about sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    step = isqrt(len(bounds)) + 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(g[0]) for g in groups])
    group = F.size(F.filter(heads, lambda x: x <= value))
    tails = F.array(F.array().cast("array<bigint>"), *[F.array(*[F.lit(x) for x in g]) for g in groups])
    inside = F.size(F.filter(F.element_at(tails, group + 1), lambda x: x <= value))
    return F.when(group == 0, 0).otherwise((group - 1) * step + inside)


_OUT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("n_chars", T.LongType()),
    T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
    T.StructField("near_next", T.DoubleType()),
])


def _compare(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Results for `ids`; `texts` has theirs and, behind those, the text that follows the last."""
    n = len(ids)
    edited = []
    for text, following in zip(texts, texts[1:]):
        k = len(text) // 3
        edited.append(text[: len(text) - k] + following[:k])
    own = digests(*utf8(pa.array(texts, pa.large_string())))
    changed = digests(*utf8(pa.array(edited, pa.large_string())))
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array(as_text(own[:n]), pa.string()), pa.array(as_text(changed), pa.string()),
        pa.array(likeness(own[:n], changed), pa.float64()), pa.array(likeness(own[:n], own[1:]), pa.float64()),
    ], names=_OUT.names)


def _along_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one or more buckets; the last row of each is the first of the next bucket, sent as its tail."""
    ids, texts, bucket, closed, held = [], [], None, False, 0
    for batch in batches:
        for b, tail, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tail", "id", "text"))):
            if b != bucket:
                ids, texts, bucket, closed, held = [], [], b, False, 0
            if closed:
                continue  # equal rows that stand first in the next bucket
            texts.append(text or "")
            held += len(texts[-1])
            if not tail:
                if held > SLICE_BYTES and ids:
                    yield _compare(ids, texts)
                    ids, texts, held = [], texts[-1:], len(texts[-1])
                ids.append(doc_id)
            else:
                closed = True
                if ids:
                    yield _compare(ids, texts)


def compare_with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text and of an edited one, and their likeness to each other and to the next text's.

    The next text is that of the next row in descending id order, the first row's after the last. The edited text has
    its last third (rounded down, in code points) replaced by as much of the next text's beginning. Rows of equal id are ordered by
    a hash of their texts, rows without id come last; null texts are empty. Every row gives one row: `id`, `n_chars`,
    `edited_sha256`, `fingerprint`, `edited_fingerprint`, `near_edited`, `near_next`. An empty table gives none.

    Texts are shuffled once, by ranges of ids. Only the bounds of ranges and the key of each one's first row are collected.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(
        F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    ).withColumns({"o": F.bitwise_not("id"), "h": F.xxhash64("text")})
    quantiles = keyed.select(F.col("o").cast("double")).dropna().stat.approxQuantile(
        "o", [i / buckets for i in range(1, buckets)], 0.25 / buckets) if buckets > 1 else []
    bounds = sorted({int(x) for x in quantiles})
    placed = keyed.withColumn("bucket", F.when(F.col("id").isNull(), len(bounds)).otherwise(_bucket(F.col("o"), bounds)))
    key = F.struct(F.col("id").isNull().alias("none"), "o", "h")
    firsts = {r["bucket"]: r["key"] for r in placed.groupBy("bucket").agg(F.min(key).alias("key")).collect()}
    order = sorted(firsts)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    # For each bucket: the key of its first row, and the bucket that row is the tail of.
    none = (None, None, None, -1)
    table = [(*firsts[b], before[b]) if b in firsts else none for b in range(len(bounds) + 1)]
    at = F.col("bucket") + 1

    def column(i: int, kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(t[i]).cast(kind) for t in table]), at)

    is_first = (F.col("id").isNull() == column(0, "boolean")) & F.col("o").eqNullSafe(column(1, "bigint")) & (
        F.col("h") == column(2, "bigint"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("tail"))
    tail = F.struct(column(3, "int").alias("bucket"), F.lit(True).alias("tail"))
    sent = placed.withColumn("to", F.explode(F.when(is_first, F.array(own, tail)).otherwise(F.array(own))))
    rows = (
        sent.select("to.bucket", "to.tail", "id", "o", "h", "text")
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket", "tail", F.col("id").isNull(), "o", "h")
        .select("bucket", "tail", "id", "text")
    )
    return rows.mapInArrow(_along_order, _OUT)

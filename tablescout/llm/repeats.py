"""Removal of long passages that an earlier document has: suffixes of word sequences, grouped by variable-length prefixes.

Every place of a text where `length` words start is a suffix. Suffixes are split by a prefix of variable length: the words up to the end of the
rarest-looking (least hashed) run of ANCHOR words among the first `length`. Equal suffixes have equal prefixes, and neighbouring
suffixes mostly share theirs, so there are few prefixes. Groups whose suffixes all come from one text have no repeat and are pruned before any
suffix leaves its task. In the groups left, the nodes of the suffix tree at depth `length` are the classes of suffixes with equal first `length`
words; a node below which texts differ is a repeat, and neighbouring repeated suffixes make up the maximal repeats. Deeper
levels of the trees change nothing, so they are not built, and a hot node is a plain aggregate that Spark combines before it shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.llm.arrow_text import bound_batches, map_texts, slices, utf8
from tablescout.llm.bitmap import bitmap_of, holds, place, places_of
from tablescout.llm.words import mix, runs, words
from tablescout.workspace import materialize

ANCHOR = 8


def _suffixes(part: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all suffixes: prefix hash, hash of the first `length` words, text number, word number in the text."""
    w = words(*utf8(part.column("text")))
    node, whole = runs(w, length)
    if not len(node):
        none = np.zeros(0, np.int64)
        return node, node, none, none
    least, span = runs(w, min(ANCHOR, length))[0], length - min(ANCHOR, length) + 1
    covered = 1
    while covered < span:
        step = min(covered, span - covered)
        least = np.minimum(least[:-step], least[step:])
        covered += step
    at = np.flatnonzero(whole)
    text = w.text_of_word()[at]
    return mix(least[at]), node[at], text, at - w.bounds[text]


_PREFIXES = T.StructType([T.StructField("prefix", T.LongType()), T.StructField("text_hash", T.LongType())])
_SUFFIXES = T.StructType([
    T.StructField("node", T.LongType()), T.StructField("id", T.LongType()), T.StructField("text_hash", T.LongType()),
    T.StructField("start", T.IntegerType()),
])
_KEPT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("kept_text", T.StringType()),
])


def _repeated_prefixes(texts: DataFrame, length: int) -> np.ndarray:
    """The prefixes that stand in more than one text. Others that the bitmap lets through are sorted out by the aggregate."""

    def rows(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        prefix, _, text, _ = _suffixes(part, length)
        if len(prefix):
            new = np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (text[1:] != text[:-1])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(prefix[new].view(np.int64)), part.column("text_hash").take(pa.array(text[new]))], names=_PREFIXES.names)

    repeated = (
        map_texts(texts, "text", rows, _PREFIXES)
        .groupBy("prefix").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).filter("a <> b")
    )
    return bitmap_of(repeated.select(place("prefix").alias("p")), "p")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 50) -> DataFrame:
    """One row for each row: `id`, `n_words`, `n_removed` and `kept_text`, the kept words joined by one space.

    A word is removed if a window of `length` words around it also starts in a text with a smaller id. Words are
    runs of bytes other than white space, compared unchanged. Null texts have no words. Rows with a null id are
    kept whole and remove nothing; rows that share an id do not remove each other's words, whatever their texts. Texts shorter
    than `length` words are kept whole. An empty table gives no rows.

    Exact copies are settled by grouping texts by digest: all but those with the smallest id go as a whole. Ids fit a long.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    keyed = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    own = keyed.filter("id is not null")
    spark = docs.sparkSession
    bound_batches(spark)
    bitmap = spark.sparkContext.broadcast(_repeated_prefixes(own, length))

    def rows(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        prefix, node, text, start = _suffixes(part, length)
        hit = holds(bitmap.value, places_of(prefix))
        if hit.any():
            of = pa.array(text[hit])
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[hit].view(np.int64)), part.column("id").take(of), part.column("text_hash").take(of),
                 pa.array(start[hit].astype(np.int32))], names=_SUFFIXES.names)

    suffixes = map_texts(own, "text", rows, _SUFFIXES)
    # Kept apart from the join: with a shuffle of its own on either side, Spark splits the rows of a hot node.
    first = (
        suffixes.groupBy("node").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
        .select("node", "first").persist(StorageLevel.DISK_ONLY)
    )
    removed = (
        suffixes.join(first, "node").filter(F.col("id") > F.col("first"))
        .groupBy("id", "text_hash").agg(F.collect_list("start").alias("starts"))
    )
    digest = F.md5(F.col("text").cast("binary"))
    copies = own.select("id", "text_hash", digest.alias("digest"))
    originals = copies.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    copied = copies.join(originals, "digest").filter(F.col("id") > F.col("first")).select("id", "text_hash").distinct()
    marks = materialize(
        removed.unionByName(copied.withColumn("starts", F.lit(None).cast("array<int>")))
        .groupBy("id", "text_hash").agg(F.bool_or(F.col("starts").isNull()).alias("copy"), F.flatten(F.collect_list("starts")).alias("starts"))
        .withColumnsRenamed({"id": "m_id", "text_hash": "m_hash"}),
        "repeats")
    joined = keyed.join(marks, (F.col("id") == F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")), "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[list] = [[], [], []]
                for value, copy, starts in zip(*(part.column(c).to_pylist() for c in ("text", "copy", "starts"))):
                    found = value.encode().split()
                    n = len(found)
                    if copy and n >= length:
                        found = []
                    elif starts:
                        edge = np.zeros(n + 1, np.int64)
                        at = np.unique(starts)
                        edge[at] += 1
                        edge[at + length] -= 1
                        found = list(compress(found, (np.cumsum(edge)[:n] == 0).tolist()))
                    for column, item in zip(out, (n, n - len(found), b" ".join(found).decode())):
                        column.append(item)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                    names=_KEPT.names)

    return joined.select("id", "text", "copy", "starts").mapInArrow(apply, _KEPT)

"""Benchmark decontamination: windows of documents that are near copies of benchmark items.

For each item of n words, every window of n words of every text is a possible copy; a text of fewer words is one as a whole. Similarity is the weighted Jaccard similarity of
the five-word shingles (a shingle weighs as often as it occurs); a window is a leak from `threshold` up.

1. A bitmap of fixed size holds the shingles of all items, alone and with the item's length. Window and item have equally many
   shingles, so a leak shares at least 2t / (1 + t) of them: windows with fewer hits in the bitmap can't be leaks.
   For a whole text that is shorter it is t / (1 + t) of the shingles of both, and only items with at most 1 / t of its shingles come into question.
2. Windows that are left get a 64-bit SimHash, as items do. Fingerprints are cut into RADIUS + 1 blocks; two within RADIUS agree on one block
   at least, so an equi-join on (length, block, value) finds all of them. At the threshold the expected distance is about 11 bits
   (standard deviation 3).
3. The exact similarity decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.llm.arrow_text import map_texts, utf8
from tablescout.llm.words import Words, mix, runs, words
from tablescout.workspace import materialize

SHINGLE = 5
RADIUS = 20
MAP_BITS = 23
_LENGTH_SALT = np.uint64(0x632BE59BD9B4E019)
_BLOCK_BITS = [64 * (i + 1) // (RADIUS + 1) - 64 * i // (RADIUS + 1) for i in range(RADIUS + 1)]
_WINDOWS_AT_ONCE = 256


def _n_shingles(length: int) -> int:
    return max(1, length - SHINGLE + 1)


def _needed(length: int, threshold: float) -> int:
    """Least number of shingles a leak of this length shares with its item."""
    return int(np.ceil(2 * threshold / (1 + threshold) * _n_shingles(length) - 1e-9))


def _needed_of_whole(length: int, item_length: int, threshold: float) -> int:
    """Least number of shingles that a leaked text of fewer words than its item shares with it."""
    return int(np.ceil(threshold / (1 + threshold) * (_n_shingles(length) + _n_shingles(item_length)) - 1e-9))


def _places(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _with_length(shingles: np.ndarray, length: int) -> np.ndarray:
    return mix(shingles ^ mix(np.array([length], np.uint64)))


def _describe(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """SimHashes of rows of shingles, and the rows with repeats made distinct (a shingle and its number), sorted."""
    bits = np.unpackbits(rows.astype("<u8").view(np.uint8).reshape(*rows.shape, 8), axis=2, bitorder="little")
    votes = bits.sum(axis=1, dtype=np.int64) * 2 > rows.shape[1]
    simhash = np.packbits(votes, axis=1, bitorder="little").view("<u8").reshape(-1)
    tokens = np.sort(rows, axis=1)
    again = np.zeros(tokens.shape, np.uint64)
    for j in range(1, tokens.shape[1]):
        again[:, j] = np.where(tokens[:, j] == tokens[:, j - 1], again[:, j - 1] + np.uint64(1), np.uint64(0))
    return simhash, np.where(again > 0, mix(tokens + again * _LENGTH_SALT), tokens)


def _shingles_of(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that start at each word, and where they lie within one text: of SHINGLE words, or of the whole of a shorter item."""
    return runs(w, min(SHINGLE, length))


_ITEMS = T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("simhash", T.LongType()),
    T.StructField("item_tokens", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(T.IntegerType())),
])


def _item_rows(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    w = words(*utf8(part.column("text")), lower=True)
    out: list[list] = [[], [], [], [], []]
    for i, item in enumerate(part.column("item_id").to_pylist()):
        a, b = int(w.bounds[i]), int(w.bounds[i + 1])
        if a == b:
            continue
        hashes, _ = _shingles_of(w, b - a)
        row = hashes[a : a + _n_shingles(b - a)] if b - a >= SHINGLE else hashes[a : a + 1]
        simhash, tokens = _describe(row[None, :])
        places = np.concatenate([_places(row), _places(_with_length(row, b - a))])
        for column, value in zip(out, (item, b - a, int(simhash.view(np.int64)[0]), tokens[0].view(np.int64), places.astype(np.int32))):
            column.append(value)
    yield pa.RecordBatch.from_arrays([
        pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()),
        pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.list_(pa.int32()))], names=_ITEMS.names)


_WINDOWS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("length", T.IntegerType()),
    T.StructField("start", T.IntegerType()), T.StructField("content", T.LongType()), T.StructField("simhash", T.LongType()),
    T.StructField("tokens", T.ArrayType(T.LongType())),
])


class _WindowFinder:
    """Windows that the bitmap can't rule out. It holds the bitmap (2^MAP_BITS bits) and the distinct lengths of items."""

    def __init__(self, bitmap: np.ndarray, lengths: list[int], threshold: float):
        self.bitmap, self.lengths, self.threshold = bitmap, lengths, threshold
        self.needed = {n: _needed(n, threshold) for n in lengths}

    def _hits(self, hashes: np.ndarray) -> np.ndarray:
        at = _places(hashes)
        return (self.bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def _whole_texts(self, w: Words, hashes: np.ndarray, hits: np.ndarray) -> Iterator[tuple]:
        """Texts of fewer words than an item, each as one window for every length of items it could be a leak of."""
        counts = w.counts
        # The next longer item needs the fewest hits.
        least = self.threshold / (1 + self.threshold) * (2 * (counts - SHINGLE + 1) + 1) - 1e-9
        for i in np.flatnonzero((counts >= SHINGLE) & (counts < self.lengths[-1]) & (hits >= least)).tolist():
            a, m = int(w.bounds[i]), int(counts[i])
            row = hashes[a : a + _n_shingles(m)]
            for n in self.lengths:
                if n <= m or _n_shingles(m) < self.threshold * _n_shingles(n) - 1e-9:
                    continue
                needed = _needed_of_whole(m, n, self.threshold)
                if hits[i] >= needed and self._hits(_with_length(row, n)).sum() >= needed:
                    simhash, tokens = _describe(row[None, :])
                    content = mix(tokens.sum(axis=1, dtype=np.uint64) + np.uint64(n) + (np.uint64(m) << np.uint64(32)))
                    yield i, n, 0, int(content.view(np.int64)[0]), int(simhash.view(np.int64)[0]), tokens[0].view(np.int64)

    def rows(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        w = words(*utf8(part.column("text")), lower=True)
        found: list[tuple] = []
        of_text = w.text_of_word()
        for size in sorted({min(SHINGLE, n) for n in self.lengths}):
            lengths = [n for n in self.lengths if min(SHINGLE, n) == size]
            hashes, whole = runs(w, size)
            hit = self._hits(hashes) & whole
            hits = np.bincount(of_text[: len(hit)][hit], minlength=len(part))
            if size == SHINGLE:
                found += self._whole_texts(w, hashes, hits)
            for i in np.flatnonzero(hits >= min(self.needed[n] for n in lengths)).tolist():
                a, b = int(w.bounds[i]), int(w.bounds[i + 1])
                local = hashes[a : b - size + 1]
                running = np.concatenate(([0], np.cumsum(hit[a : b - size + 1])))
                for n in lengths:
                    if n > b - a:
                        break
                    k = _n_shingles(n)
                    starts = np.flatnonzero(running[k:] - running[:-k] >= self.needed[n])
                    for at in range(0, len(starts), _WINDOWS_AT_ONCE):
                        chosen = starts[at : at + _WINDOWS_AT_ONCE]
                        rows = local[chosen[:, None] + np.arange(k)]
                        enough = self._hits(_with_length(rows, n)).sum(axis=1) >= self.needed[n]
                        if enough.any():
                            rows = rows[enough]
                            simhash, tokens = _describe(rows)
                            content = mix(tokens.sum(axis=1, dtype=np.uint64) + np.uint64(n))
                            found += [(i, n, s, c, h, t) for s, c, h, t in zip(
                                chosen[enough].tolist(), content.view(np.int64).tolist(), simhash.view(np.int64).tolist(),
                                tokens.view(np.int64))]
        if found:
            at = pa.array([f[0] for f in found])
            yield pa.RecordBatch.from_arrays([
                part.column("id").take(at), part.column("text_hash").take(at), pa.array([f[1] for f in found], pa.int32()),
                pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int64()),
                pa.array([f[4] for f in found], pa.int64()), pa.array([f[5] for f in found], pa.list_(pa.int64()))],
                names=_WINDOWS.names)


def _bitmap(items: DataFrame) -> np.ndarray:
    """The bitmap as bytes. What is collected is at most 2^MAP_BITS / 64 words of 64 bits."""
    words_of = (
        items.select(F.explode("places").alias("p"))
        .select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, p & 63)").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits"))
    )
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for row in words_of.collect():
        out[row["word"]] = row["bits"]
    return out.view(np.uint8)


def _blocks(df: DataFrame) -> DataFrame:
    """A row for each block of the SimHash: `block` (its number) and `value` (its bits)."""
    parts, at = [], 0
    for i, width in enumerate(_BLOCK_BITS):
        value = F.shiftrightunsigned("simhash", at).bitwiseAND(F.lit((1 << width) - 1))
        parts.append(F.struct(F.lit(i).alias("block"), value.alias("value")))
        at += width
    return df.withColumn("__b", F.explode(F.array(*parts))).select("*", "__b.block", "__b.value").drop("__b")


def find_leaks(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_id_column: str = "item_id", item_text_column: str = "text", threshold: float = 0.75,
) -> DataFrame:
    """One row for each leaked (text, item): `id`, `text_hash` (xxhash64 of the text), `item_id`, `similarity`, the best of its windows.

    Words are lower-cased (A-Z) and split at white space. Items without words match nothing; an item of fewer than five words
    has its whole sequence as its one shingle. A text of fewer words than an item is compared as a whole. Null texts are empty. Items of equal text are all reported; equal rows
    of documents have one result between them. Empty tables give no rows.
    """
    spark = docs.sparkSession
    given = items.select(F.col(item_id_column).cast("long").alias("item_id"), F.col(item_text_column).alias("text"))
    items = materialize(map_texts(given, "text", _item_rows, _ITEMS), "items")
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())
    texts = docs.select(
        F.col(id_column).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("text_hash"),
        F.col(text_column).alias("text")).filter("text is not null")
    if not lengths:
        return spark.createDataFrame([], "id long, text_hash long, item_id long, similarity double")
    finder = _WindowFinder(_bitmap(items), lengths, threshold)
    windows = materialize(map_texts(texts, "text", finder.rows, _WINDOWS), "windows")
    # A passage that many texts share is compared once, not once for each of them.
    contents = windows.groupBy("length", "content").agg(F.first("simhash").alias("simhash"), F.first("tokens").alias("tokens"))
    contents = materialize(contents, "contents")
    keyed = _blocks(contents.select("length", "content", "simhash")).alias("c")
    indexed = _blocks(items.select("length", "item_id", "simhash")).alias("i")
    same = [F.col(f"c.{k}") == F.col(f"i.{k}") for k in ("length", "block", "value")]
    close = F.bit_count(F.col("c.simhash").bitwiseXOR(F.col("i.simhash"))) <= RADIUS
    candidates = keyed.join(indexed, [*same, close]).select("c.length", "content", "item_id").distinct()
    shared = F.size(F.array_intersect("tokens", "item_tokens"))
    verified = (
        candidates.join(contents.select("length", "content", "tokens"), ["length", "content"])
        .join(items.select("item_id", "length", "item_tokens"), ["item_id", "length"])
        .withColumn("similarity", shared / (F.size("tokens") + F.size("item_tokens") - shared))
        .filter(F.col("similarity") >= threshold)
        .groupBy("length", "content", "item_id").agg(F.max("similarity").alias("similarity"))
    )
    places = windows.select("length", "content", "id", "text_hash").distinct()
    return (
        places.join(verified, ["length", "content"])
        .groupBy("id", "text_hash", "item_id").agg(F.max("similarity").alias("similarity"))
    )


def mark_leaks(docs: DataFrame, leaks: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`id`, `contaminated`, `item_ids` (rising) and `similarity` (best, 0 if none) of each row of `docs`."""
    by_text = leaks.groupBy("id", "text_hash").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"))
    keyed = docs.select(
        F.col(id_column).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("hash"))
    on = F.col("doc").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash"))
    return keyed.join(by_text, on, "left").select(
        F.col("doc").alias("id"), F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def drop_leaked(docs: DataFrame, leaks: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` without a leak, with all their columns."""
    row = docs.select(F.struct(*docs.columns).alias("row"))
    leaked = leaks.select("id", "text_hash").distinct()
    text = F.coalesce(F.col(f"row.{text_column}"), F.lit(""))
    on = F.col(f"row.{id_column}").cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("text_hash"))
    return row.join(leaked, on, "left_anti").select("row.*")

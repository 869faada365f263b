"""Source divergence audit: how far the word use of each source lies from the other sources of its language, and by which terms.

Terms are counted inside tasks: those of up to eight bytes are packed into one 64-bit word, those of up to sixteen into two, and
sorted by radix passes over 16-bit digits; runs of equal words are counted. Longer terms are sorted as bytes, in
buckets of like length. Each task sends one row for a (language, source, term) it has seen, Spark adds them up.

All numbers are whole numbers: `p = 1 + floor(10^9 * (count + 5) / (N + 5 V))` is the smoothed share of a kept term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.llm.arrow_text import bound_batches, slices, utf8
from tablescout.workspace import materialize

SMOOTH = 5
PARTS = 1_000_000_000

# Counted rows that a task holds before it merges them, and terms and sources of one block of the comparison.
HELD_ROWS = 1 << 20
BLOCK_TERMS = 1 << 10
BLOCK_SOURCES = 1 << 9

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_TERM = np.zeros(256, bool)
_IN_TERM[97:123] = True
_IN_TERM[128:] = True


def radix_order(*keys: np.ndarray) -> np.ndarray:
    """The stable order of rows by unsigned keys, the last key first in rank: counting passes over 16-bit digits."""
    order = np.arange(len(keys[0]))
    for key in keys:
        key = np.ascontiguousarray(key, np.uint64)
        for shift in range(0, 64, 16):
            digit = ((key >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            # Passes over a digit that all rows share change nothing.
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, in sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class _Bucket:
    """Counts of the terms of one length class: rows (words..., group, n, docs)."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, words: list[np.ndarray], doc: np.ndarray, group_of_doc: np.ndarray) -> None:
        """Occurrences in rising order of `doc`; documents are in rising order of their groups."""
        order = self._order(words)
        words, doc = [w[order] for w in words], doc[order]
        at = _starts(*words, doc)
        n, words, doc = np.diff(np.append(at, len(doc))), [w[at] for w in words], doc[at]
        group = group_of_doc[doc]
        at = _starts(*words, group)
        if len(at):
            self.parts.append((*(w[at] for w in words), group[at], np.add.reduceat(n, at), np.diff(np.append(at, len(doc)))))
            self.rows += len(at)

    def merged(self) -> tuple[np.ndarray, ...] | None:
        """All counts, one row for a term and group."""
        if len(self.parts) > 1:
            columns = [np.concatenate(c) for c in zip(*self.parts)]
            *words, group, n, docs = columns
            order = self._order(words, group)
            words, group = [w[order] for w in words], group[order]
            at = _starts(*words, group)
            self.parts = [(*(w[at] for w in words), group[at], np.add.reduceat(n[order], at), np.add.reduceat(docs[order], at))]
            self.rows = len(at)
        return self.parts[0] if self.parts else None

    @staticmethod
    def _order(words: list[np.ndarray], group: np.ndarray | None = None) -> np.ndarray:
        """By words, then by group."""
        first = [] if group is None else [group]
        if words[0].dtype == np.uint64:
            return radix_order(*first, *words[::-1])
        order = np.arange(len(words[0])) if group is None else np.argsort(group, kind="stable")
        return order[np.argsort(words[0][order], kind="stable")]

    def texts(self, words: list[np.ndarray]) -> pa.Array:
        """The terms as strings. No term holds a zero byte, so padding can be told from it."""
        if words[0].dtype != np.uint64:
            return pa.array(words[0].tolist(), pa.binary()).cast(pa.string())
        raw = np.stack(words, axis=1).astype(">u8").view(np.uint8).reshape(len(words[0]), -1)
        used = raw != 0
        offsets = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(used.sum(axis=1), out=offsets[1:])
        return pa.StringArray.from_buffers(len(raw), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[used])))


def _packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int) -> np.ndarray:
    """Bytes `first` to `first + 8` of each term as one number, most significant byte first, zeros after the term's end."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(first, first + 8):
        at = starts + k
        inside = at < ends
        byte = np.where(inside, data[np.minimum(at, len(data) - 1)], 0)
        out = (out << np.uint64(8)) | byte.astype(np.uint64)
    return out


class TermCounter:
    """Counts terms of texts by group (any hashable), in buckets by length."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.buckets: dict[int, _Bucket] = {}

    @property
    def rows(self) -> int:
        return sum(b.rows for b in self.buckets.values())

    def add(self, texts: pa.Array, groups: list[tuple[str, str]]) -> None:
        codes = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], np.int64)
        order = np.argsort(codes, kind="stable")
        data, offsets = utf8(texts.take(pa.array(order)))
        data = _LOWER[data]
        # Words end where a byte outside of terms follows, or their text ends.
        inside = _IN_TERM[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edge = offsets[1:-1]
        before[edge[edge < len(data)]] = False
        after[edge[edge > 0] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        doc = np.searchsorted(offsets, starts, side="right") - 1
        length = ends - starts
        for bucket in (8, 16):
            mine = (length <= bucket) & (length > bucket - 8)
            words = [_packed(data, starts[mine], ends[mine], k) for k in range(0, bucket, 8)]
            self._bucket(bucket).add(words, doc[mine], codes[order])
        longer = np.flatnonzero(length > 16)
        width = 1 << np.ceil(np.log2(np.maximum(length[longer], 1))).astype(np.int64)
        for w in np.unique(width):
            at = longer[width == w]
            words = np.array([data[starts[i] : ends[i]].tobytes() for i in at], f"S{w}")
            self._bucket(int(w)).add([words], doc[at], codes[order])

    def _bucket(self, width: int) -> _Bucket:
        return self.buckets.setdefault(width, _Bucket())

    def merge(self) -> None:
        for b in self.buckets.values():
            b.merged()

    def flush(self, step: int = 1 << 15) -> Iterator[pa.RecordBatch]:
        """The counts as batches (lang, source, term, n, docs); nothing is held afterwards."""
        names = list(self.groups)
        lang, source = (pa.array([g[k] for g in names], pa.string()) for k in (0, 1))
        for b in self.buckets.values():
            if (found := b.merged()) is None:
                continue
            for at in range(0, len(found[0]), step):
                *words, group, n, docs = (c[at : at + step] for c in found)
                code = pa.array(group)
                yield pa.RecordBatch.from_arrays(
                    [lang.take(code), source.take(code), b.texts(words), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])
        self.groups, self.buckets = {}, {}


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term, and the number of texts that hold it."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, limit = TermCounter(), HELD_ROWS
        for batch in batches:
            for part in slices(batch, "text"):
                counter.add(part.column("text"), list(zip(part.column("lang").to_pylist(), part.column("source").to_pylist())))
                if counter.rows >= limit:
                    counter.merge()
                    # Where merging does not help any more, the counts go; Spark adds them to later ones.
                    if counter.rows >= limit // 2:
                        yield from counter.flush()
        yield from counter.flush()

    counted = _texts(docs).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """p of a count, exactly: the product is a decimal, and `div` cuts."""
    up = (count + SMOOTH).cast("decimal(19,0)") * F.lit(PARTS).cast("decimal(10,0)")
    return F.call_function("div", up, (total + SMOOTH * terms).cast("decimal(19,0)")).cast("long") + 1


def _block_distances(rows: pa.Table) -> pa.Table:
    """Sums of |p - q| over one block's terms, for each pair of a source of tile `i` and one of tile `j` (of one tile: in the order of their names).

    A row without a term gives a source's share of the terms it does not have, and `size`, the number of the block's terms.
    """
    header = rows.column("term").is_null().to_numpy()
    source = rows.column("source").combine_chunks().dictionary_encode()
    # In the order of the names, so that every block puts the two sources of a pair the same way round.
    order = pc.sort_indices(source.dictionary)
    names, code = source.dictionary.take(order), np.argsort(order.to_numpy())[source.indices.to_numpy()]
    share, tile = rows.column("p").to_numpy(), rows.column("tile").to_numpy()
    term = rows.filter(pa.array(~header)).column("term").combine_chunks().dictionary_encode()
    matrix = np.zeros((len(names), max(len(term.dictionary), 1)), np.int64)
    matrix[code[header]] = share[header, None]
    if not len(term.dictionary):
        matrix[:] = 0
    # Terms of the block that no source of these two tiles has.
    unseen = max(pc.max(rows.column("size")).as_py() - len(term.dictionary), 0)
    default = np.zeros(len(names), np.int64)
    default[code[header]] = share[header]
    matrix[code[~header], term.indices.to_numpy()] = share[~header]
    tiles = np.zeros(len(names), np.int64)
    tiles[code] = tile
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    left, right = np.flatnonzero(tiles == i), np.flatnonzero(tiles == j)
    a, b, value = [], [], []
    for k in left:
        others = right[right > k] if i == j else right
        a.append(np.full(len(others), k))
        b.append(others)
        value.append(np.abs(matrix[others] - matrix[k]).sum(axis=1) + unseen * np.abs(default[others] - default[k]))
    a, b, value = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b, value))
    return pa.table({
        "lang": pa.array([rows.column("lang")[0].as_py()] * len(a), pa.string()),
        "a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "value": pa.array(value, pa.int64())})


def source_divergence(docs: DataFrame, min_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (language, source) that occurs, also for sources without terms.

    Part `pair`: each other source of the language, value the sum of |p - q| over all kept terms (0 if none is kept). Part
    `term`: terms of the source whose p is above the language's q, value p - q, up to rank `top_terms`. A language keeps
    the terms that at least `min_docs` of its rows hold. Null languages, sources and texts are read as ''; each
    row is a document of its own, repeated or not. Ties in value are ranked by the item's bytes. No rows give none.

    Shares are compared in blocks of terms and tiles of sources, so that no task holds more than a block's matrix. Counts go up to 9 * 10^18.
    """
    counts = materialize(term_counts(docs), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    kept = materialize(kept.drop("docs"), "kept-terms")
    # Written, so that Spark knows how small it is and need not deal the terms out by language to join it.
    langs = materialize(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total")), "languages")
    found = materialize(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-counts")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # One row a group: its sum, and its tile within its language.
    groups = _texts(docs).groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(sources, "lang").select(
        "lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")),
        F.ceil(F.col("sources") / BLOCK_SOURCES).alias("tiles"))
    groups = materialize(groups.withColumn("tile", F.pmod(F.xxhash64("source"), "tiles")), "groups")

    shares = found.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "terms", "tiles", "tile", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = (
        shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        .withColumn("rank", rank).filter(F.col("rank") <= top_terms))

    blocks = F.ceil(F.col("terms") / BLOCK_TERMS)
    absent = F.when(F.col("terms") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.greatest("terms", F.lit(1)))).otherwise(0)
    block = F.pmod(F.xxhash64("term"), blocks).alias("block")
    sizes = kept.join(langs, "lang").select("lang", block).groupBy("lang", "block").agg(F.count("*").alias("size"))
    headers = groups.select(
        "lang", "source", F.lit(None).cast("string").alias("term"), "tiles", "tile", absent.alias("p"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(blocks, F.lit(1)) - 1)).alias("block"),
    ).join(sizes, ["lang", "block"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    cells = shares.select(
        "lang", "source", "term", "tiles", "tile", "p", block, F.lit(0).cast("long").alias("size")).unionByName(headers)
    # A tile meets every tile once: as `i` those from its own number on, as `j` those below.
    cells = cells.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")).select(
        "lang", "source", "term", "tile", "p", "block", "size", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    halves = cells.groupBy("lang", "block", "i", "j").applyInArrow(
        _block_distances, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = halves.select("lang", "value", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"))
    pairs = pairs.select("lang", "x.source", "x.item", "value").withColumn("rank", rank)
    out = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))

"""N-gram Jaccard join over a token-group matrix.

Texts are sets of hashed five-word shingles; two link at a Jaccard similarity of `percent` or more. Equal sets are one class.

1. Groups. Each class looks for a leader: among the classes that share MinHash values with it, the one with most of them
   (the least id of a bucket stands for it). A verified link to the leader joins its group; groups are the components of such links.
2. Matrix. Tokens have one global order, rarest first as far as frequent ones are known. Of two sets that link, the longer one has a token among
   its first |s| - ceil(p|s|) + 1 that is among the first |s| - ceil(2p/(1+p)|s|) + 1 of the other, its index tokens. The matrix holds (token,
   group) for the unions of the groups' first tokens, with the least and the largest size of the members that have them. A group comes into
   question for a class that shares an index token of a member with it, if that member's size fits and is no larger.
3. Bound. A group of one class in question is compared with by lists of marks of both classes' first tokens, one row a pair. For a larger
   group, the first tokens that the class shares with the group's union bound its overlap with every such
   member; sizes say how many a link needs. Only groups that reach the bound are opened, member by member under the same bound.
4. Pairs that the bound leaves are decided exactly, on whole sets made of both texts. A member of each opened group that shares the class's rarest
   tokens comes first; the others are only counted and compared where that one does not settle that the class and the group are connected.

Copies and near copies are thus compared with their group's leader, not with each other, and every link between
groups is found: the result is the same as that of comparing all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.llm.arrow_text import bound_batches, map_texts, slices, utf8
from tablescout.llm.bitmap import BITS, bitmap_of, holds, place, places_of
from tablescout.llm.components import relabelled, roots, stars
from tablescout.llm.words import distinct, mix, shingles, words
from tablescout.workspace import drop_written, materialize, materialize_told

MINHASHES = 6
LEAST_SHARED = 2
# Tokens by which a near member of an opened group is chosen.
NEAR_TOKENS = 2
# Of the members of a group that have one of those tokens, so many are tried before all are counted.
NEAR_MEMBERS = 8
# Tokens counted together in a task, how often one must occur there to be told, and how many told tokens travel to the tasks at most.
COUNTED_AT_ONCE = 2_000_000
FREQUENT = 3
MOST_FREQUENT = 1 << 20
# First tokens that a task deals out at once, and the ranges of the bitmap's places that they go to (2^10 of 2^16 places).
DEALT_AT_ONCE = 1 << 20
RANGE_BITS = 16
_SALTS = mix(np.arange(1, MINHASHES + 3, dtype=np.uint64))


def _sets(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The rising distinct shingles of each text, and bounds."""
    return distinct(*shingles(words(*utf8(part.column("text")), lower=True)))


def _per_text(values: np.ndarray, bounds: np.ndarray, reduce: np.ufunc) -> np.ndarray:
    """Reduce each text's values; 0 for a text without any."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    full = np.diff(bounds) > 0
    if full.any():
        out[full] = reduce.reduceat(values, bounds[:-1][full])
    return out


def _count_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, sets) of tokens in several different sets of a task."""
    held: list[np.ndarray] = []
    n, seen = 0, set()

    def told() -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= FREQUENT
        return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(counts[often])], names=["token", "n"])

    for batch in batches:
        for part in slices(batch, "text"):
            tokens, bounds = _sets(part)
            marks = _per_text(mix(tokens), bounds, np.add).tolist()
            for i, mark in enumerate(marks):
                if mark not in seen:
                    seen.add(mark)
                    held.append(tokens[bounds[i] : bounds[i + 1]])
                    n += len(held[-1])
            if n > COUNTED_AT_ONCE:
                yield told()
                held, n, seen = [], 0, set()
    if held:
        yield told()


class TokenOrder:
    """Tokens by how frequent they are known to be (powers of two), then by value. Tokens not known to be frequent come first."""

    def __init__(self, tokens: np.ndarray, levels: np.ndarray):
        at = np.argsort(tokens)
        self.tokens, self.levels = tokens[at], levels[at]
        self.likely = np.zeros(1 << 22, bool)
        self.likely[(tokens >> np.uint64(42)).astype(np.int64)] = True

    @classmethod
    def of(cls, texts: DataFrame) -> TokenOrder:
        """Count within tasks and add up. Any order gives right results, so what tasks can't see only costs time.

        The most frequent levels are kept that have MOST_FREQUENT tokens at most in total.
        """
        bound_batches(texts.sparkSession)
        counted = (
            texts.select("text").mapInArrow(_count_frequent, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
            .withColumn("level", F.floor(F.log2("n")).cast("int")).persist(StorageLevel.DISK_ONLY))
        sizes = {r["level"]: r["n"] for r in counted.groupBy("level").agg(F.count("*").alias("n")).collect()}
        least, total = 64, 0
        for level in sorted(sizes, reverse=True):
            total += sizes[level]
            if total > MOST_FREQUENT:
                break
            least = level
        kept = counted.filter(F.col("level") >= least).select("token", "level").toArrow()
        counted.unpersist()
        return cls(kept.column("token").to_numpy().view(np.uint64).copy(), kept.column("level").to_numpy().astype(np.int64))

    def first(self, tokens: np.ndarray, n: int) -> np.ndarray:
        """The first n of a set's rising tokens in this order."""
        maybe = np.flatnonzero(self.likely[(tokens >> np.uint64(42)).astype(np.int64)])
        if len(maybe) and len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, tokens[maybe]), len(self.tokens) - 1)
            known = self.tokens[at] == tokens[maybe]
            if known.any():
                level = np.zeros(len(tokens), np.int64)
                level[maybe[known]] = self.levels[at[known]]
                return tokens[np.argsort(level, kind="stable")[:n]]
        return tokens[:n]


_CLASSES = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()),
    T.StructField("minhashes", T.ArrayType(T.LongType())),
])
_LISTS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("index_tokens", T.ArrayType(T.LongType())), T.StructField("tokens", T.ArrayType(T.LongType())),
])
_MARKS = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("marks", T.ArrayType(T.IntegerType()))])
_BITS = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("bits", T.BinaryType())])


def _list_array(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(f"i{flat.itemsize}")))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return _list_array(flat, np.array([len(a) for a in arrays], np.int64))


def _needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _index_tokens(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of the first tokens of sets of n are index tokens: one of them is in every set that links and is no smaller."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def _describe(texts: DataFrame) -> DataFrame:
    """Each text's set size, signature and MinHash values."""

    def rows(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokens, bounds = _sets(part)
        signs = [_per_text(mix(tokens ^ salt), bounds, np.add) for salt in _SALTS[:2]]
        least = np.stack([_per_text(mix(tokens ^ salt), bounds, np.minimum) for salt in _SALTS[2:]], axis=1)
        yield pa.RecordBatch.from_arrays([
            part.column("id"), pa.array(np.diff(bounds)), *[pa.array(s.view(np.int64)) for s in signs], _lists(list(least))],
            names=_CLASSES.names)

    return map_texts(texts, "text", rows, _CLASSES)


def _places(ids: DataFrame) -> np.ndarray:
    return bitmap_of(ids.select(place(F.xxhash64("id")).alias("p")), "p")


def _first_tokens(part: pa.RecordBatch, order: TokenOrder, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, all first tokens, and how many of them each text has."""
    tokens, bounds = _sets(part)
    n = np.diff(bounds)
    first = [order.first(tokens[bounds[i] : bounds[i + 1]], int(k) - _needed(int(k), percent) + 1) for i, k in enumerate(n)]
    return n, np.concatenate(first), np.array([len(x) for x in first], np.int64)


def _repeated_in_range(dealt: pa.Table) -> pa.Table:
    """The bits of one range of places, set where a mark occurs more than once."""
    marks = np.sort(dealt.column("marks").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint32))
    bits = np.zeros(1 << RANGE_BITS, bool)
    bits[marks[1:][marks[1:] == marks[:-1]] & np.uint32((1 << RANGE_BITS) - 1)] = True
    return pa.table({"range": dealt.column("range").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()])})


def _listed(texts: DataFrame, heads: DataFrame, order: TokenOrder, percent: int, sent: list[Broadcast] | None = None) -> DataFrame:
    """(id, n, index_tokens, tokens): each class's set size and those of its first tokens that other classes may have, index tokens apart.

    First tokens are as large as a seventh of the texts, so they are made twice: 32 bits of each go to the range of its place, where repeated ones
    set a bit, then those whose bit is set are listed. Bits set by chance only cost time. `sent` gets the broadcasts that can go once the rows are written.
    """
    spark = texts.sparkSession
    chosen, known = spark.sparkContext.broadcast(_places(heads)), spark.sparkContext.broadcast(order)
    rows = texts.filter("id is not null").select("id", place(F.xxhash64("id")).alias("p"), "text")
    bound_batches(spark)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.flatnonzero(holds(chosen.value, batch.column("p").to_numpy(zero_copy_only=False)))
            if len(at):
                yield from slices(batch.take(pa.array(at)), "text")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def dealt() -> pa.RecordBatch:
            marks = np.concatenate(held)
            ranges = ((marks & np.uint32((1 << BITS) - 1)) >> np.uint32(RANGE_BITS)).astype(np.uint16)
            counts = np.bincount(ranges, minlength=1 << (BITS - RANGE_BITS))
            full = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), _list_array(marks[np.argsort(ranges, kind="stable")], counts[full])], names=_MARKS.names)

        for part in parts(batches):
            held.append(_first_tokens(part, known.value, percent)[1].astype(np.uint32))
            n += len(held[-1])
            if n > DEALT_AT_ONCE:
                yield dealt()
                held, n = [], 0
        if n:
            yield dealt()

    bits = rows.mapInArrow(deal, _MARKS).groupBy("range").applyInArrow(_repeated_in_range, _BITS).toArrow()
    repeated = np.zeros((1 << (BITS - RANGE_BITS), 1 << (RANGE_BITS - 3)), np.uint8)
    for k, part in zip(bits.column("range").to_pylist(), bits.column("bits").to_pylist()):
        repeated[k] = np.frombuffer(part, np.uint8)
    bitmap = spark.sparkContext.broadcast(repeated.reshape(-1))
    if sent is not None:
        sent += [chosen, known, bitmap]

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            n, tokens, held = _first_tokens(part, known.value, percent)
            of = np.repeat(np.arange(len(n)), held)
            at = np.arange(len(tokens)) - np.repeat(np.cumsum(held) - held, held)
            hit = holds(bitmap.value, places_of(tokens))
            indexed = at < _index_tokens(n, percent)[of]
            split = [_list_array(tokens[of_kind], np.bincount(of[of_kind], minlength=len(n))) for of_kind in (hit & indexed, hit & ~indexed)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), *split], names=_LISTS.names)

    return rows.mapInArrow(lists, _LISTS).filter("size(index_tokens) + size(tokens) > 0")


def _verified(texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link. Texts travel, as they are smaller than their sets; only those that stand in a pair do."""
    pairs, told = materialize_told(pairs, "pairs", F.count("*").alias("n"))
    if not told["n"]:
        return pairs
    bound_batches(texts.sparkSession)
    bitmap = texts.sparkSession.sparkContext.broadcast(_places(pairs.select(F.explode(F.array("a", "b")).alias("id"))))

    @F.arrow_udf("boolean")
    def stands_in_a_pair(places: pa.Array) -> pa.Array:
        return pa.array(holds(bitmap.value, places.to_numpy(zero_copy_only=False)))

    def linking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                tokens_a, bounds_a = _sets(part)
                tokens_b, bounds_b = distinct(*shingles(words(*utf8(part.column("other_text")), lower=True)))
                linked = []
                for i in range(len(part)):
                    a, b = tokens_a[bounds_a[i] : bounds_a[i + 1]], tokens_b[bounds_b[i] : bounds_b[i + 1]]
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    if len(a) and len(b) and 100 * shared >= percent * (len(a) + len(b) - shared):
                        linked.append(i)
                yield part.select(["a", "b"]).take(pa.array(linked, pa.int64()))

    some = texts.filter(stands_in_a_pair(place(F.xxhash64("id"))))
    both = pairs.join(some.withColumnRenamed("id", "a"), "a").join(some.select(F.col("id").alias("b"), F.col("text").alias("other_text")), "b")
    linked = materialize(both.select("a", "b", "text", "other_text").mapInArrow(linking, "a long, b long").distinct(), "links")
    bitmap.destroy()
    drop_written(pairs)
    return linked


def _leaders(classes: DataFrame) -> DataFrame:
    """(a, b): each class and the leader that most of its MinHash buckets have, if at least LEAST_SHARED do."""
    buckets = classes.select("id", F.posexplode("minhashes").alias("k", "v"))
    heads = buckets.groupBy("k", "v").agg(F.min("id").alias("leader"), F.max("id").alias("last")).filter("leader < last")
    votes = buckets.join(heads.select("k", "v", "leader"), ["k", "v"]).filter("leader < id").groupBy("id", "leader").agg(F.count("*").alias("n"))
    best = votes.filter(F.col("n") >= LEAST_SHARED).groupBy("id").agg(F.max(F.struct("n", F.bitwise_not("leader").alias("inverse"))).alias("best"))
    return best.select(F.col("id").alias("a"), F.bitwise_not("best.inverse").alias("b"))


def _least_shared(q: Column, s: Column, percent: int) -> Column:
    """How many first tokens a link between sets of sizes q and s <= q needs to share, at least. It rises with s.

    All first tokens of one of the two that the other has are among the other's first ones; the rest of that one bounds the overlap.
    """
    def up(x: Column, by: int) -> Column:
        return F.ceil(x / by).cast("long")

    return up((q + s) * percent, 100 + percent) - up(q * percent, 100) + 1


def _fits(q: Column, low: Column, high: Column, percent: int) -> Column:
    """Members of sizes from low to high may link with a set of size q and be no larger."""
    return (low <= q) & (high * 100 >= q * percent)


def _matrix(rows: DataFrame) -> DataFrame:
    """(token, other, low, high, held): the unions of the groups' tokens, sizes and number of the members that have them."""
    return rows.groupBy("token", F.col("group").alias("other")).agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("held"))


def _first_rows(listed: DataFrame) -> DataFrame:
    """A row for each first token of each class, index tokens or not."""
    return listed.withColumn("token", F.explode(F.concat("index_tokens", "tokens"))).drop("index_tokens", "tokens")


def _in_question(listed: DataFrame, percent: int) -> DataFrame:
    """(id, other, alone): the groups in question for a class, and whether they are of one class."""
    index = listed.select("n", "group", "alone", F.explode("index_tokens").alias("token")).groupBy(
        "token", F.col("group").alias("other"), "alone").agg(F.min("n").alias("low"), F.max("n").alias("high")).alias("m")
    q = _first_rows(listed.drop("alone")).alias("q")
    open_to = (F.col("group") != F.col("other")) & _fits(F.col("q.n"), F.col("low"), F.col("high"), percent)
    return q.join(index, (F.col("q.token") == F.col("m.token")) & open_to).select("id", "other", "alone").distinct()


def _bounded(listed: DataFrame, in_question: DataFrame, percent: int) -> DataFrame:
    """(id, n, other, overlap): the groups of several classes to open for a class, and how many tokens it shares with each. A class meets a group by all its tokens only here, where the pair is known: as many rows as it has tokens, at most."""
    q, low, high = F.col("n"), F.col("low"), F.col("high")
    met = _first_rows(in_question.select("id", "other").join(listed.drop("group", "alone"), "id")).join(
        _matrix(_first_rows(listed.filter("not alone"))), ["token", "other"]).filter(_fits(q, low, high, percent))
    overlaps = met.groupBy("id", "n", "other").agg(F.count("*").alias("overlap"), F.min("low").alias("low"))
    bound = F.greatest(F.lit(1), _least_shared(q, F.greatest(low, F.ceil(q * percent / 100).cast("long")), percent))
    return overlaps.filter(F.col("overlap") >= bound).select("id", "n", "other", "overlap")


def _member_pairs(listed: DataFrame, bounded: DataFrame, percent: int, n_tokens: int | None = None) -> DataFrame:
    """(a, n_a, b, n_b, other, n): classes a and members b of the groups opened for them that have n tokens in common, b no larger than a.

    A link needs so many of the tokens that a shares with the group that any `overlap` less that number plus 1 have one of b's. Those are looked at
    that fewest members have; or only `n_tokens` of them, and NEAR_MEMBERS of the members that have each.
    """
    mine = _first_rows(bounded.join(listed.drop("group", "alone"), ["id", "n"])).withColumnsRenamed({"id": "a", "n": "n_a"})
    of_groups = _first_rows(listed.filter("not alone"))
    rarest = F.row_number().over(Window.partitionBy("a", "n_a", "other").orderBy("held", "token"))
    mine = mine.join(_matrix(of_groups), ["token", "other"]).filter(_fits(F.col("n_a"), F.col("low"), F.col("high"), percent))
    mine = mine.withColumn("r", rarest).select("a", "n_a", "token", "other", "overlap", "r")
    theirs, size = of_groups.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("token").alias("t"), F.col("group").alias("o")), F.col("n_b")
    if n_tokens is not None:
        mine = mine.filter(F.col("r") <= n_tokens)
        theirs = theirs.withColumn("k", F.row_number().over(Window.partitionBy("t", "o").orderBy("b"))).filter(F.col("k") <= NEAR_MEMBERS).drop("k")
    needed = F.greatest(F.lit(1), _least_shared(F.col("n_a"), size, percent))
    may = _fits(F.col("n_a"), size, size, percent) & (F.col("r") <= F.col("overlap") - needed + 1)
    return mine.join(theirs, (F.col("token") == F.col("t")) & (F.col("other") == F.col("o")) & may).groupBy(
        "a", "n_a", "b", "n_b", "other").agg(F.count("*").alias("n"))


def _may_link(pairs: DataFrame, listed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that all common first tokens leave open. Tokens are compared by 31 bits, which count none too few."""
    marks = listed.select("id", "n", F.transform(F.concat("index_tokens", "tokens"), lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int")).alias("m"))
    a, b = (marks.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("m").alias(f"m_{x}")) for x in "ab")
    # Equal marks of one class are counted once by the intersection.
    shared = F.size(F.array_intersect("m_a", "m_b")) + F.size("m_a") - F.size(F.array_distinct("m_a"))
    needed = _least_shared(F.greatest("n_a", "n_b"), F.least("n_a", "n_b"), percent)
    return pairs.join(a, "a").join(b, "b").filter(shared >= F.greatest(F.lit(1), needed)).select("a", "b").distinct()


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 75) -> DataFrame:
    """One row for each row: `id`, `n_shingles` (its set's size), `component_id` (the least id reachable by links).

    Words are lower-cased (A-Z); a text of fewer than five words has its whole sequence as its one shingle. Texts without words, and null
    ones, are empty and link with nothing. Rows that share an id are one document with the links of all. A null id
    has a null component. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    # Tables are written where they are read again, not kept with their lineage: the driver holds and tells the whole plan of a kept table
    # with each plan that reads it.
    described = materialize(_describe(texts), "described")
    of_class = ["n", "s1", "s2"]
    # Copies have the same MinHash values.
    each = [f"m{k}" for k in range(MINHASHES)]
    classes = materialize(
        described.filter("id is not null and n > 0").groupBy(*of_class)
        .agg(F.min("id").alias("id"), *(F.min(F.col("minhashes")[k]).alias(name) for k, name in enumerate(each)))
        .select("id", *of_class, F.array(*each).alias("minhashes")), "classes")
    heads = classes.select("id", *of_class)
    leading = _verified(texts, _leaders(classes), percent)
    groups = roots(leading)
    # Lists are joined with their classes and groups; tokens become rows only for the shuffles by token.
    sent: list[Broadcast] = []
    listed = materialize(
        _listed(texts, heads, TokenOrder.of(texts), percent, sent).join(heads.select("id", "n"), ["id", "n"])
        .join(groups.withColumnRenamed("node", "id"), "id", "left")
        .select("id", "n", F.coalesce("component", "id").alias("group"), F.isnull("component").alias("alone"), "index_tokens", "tokens"), "listed")
    for done in sent:
        done.destroy()
    in_question = materialize(_in_question(listed, percent), "question")
    bounded = materialize(_bounded(listed, in_question.filter("not alone"), percent), "bounded")
    labels = [groups]

    def merge(links: DataFrame) -> None:
        """Components of the graph whose nodes are the components so far."""
        labels.append(stars(relabelled(relabelled(links, "a", labels), "b", labels)))

    def links_of(pairs: DataFrame) -> DataFrame:
        return _verified(texts, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), percent)

    def unsettled() -> DataFrame:
        """Opened groups that are not in one component with the class."""
        ends = bounded.withColumns({"ca": F.col("id"), "cb": F.col("other")})
        return relabelled(relabelled(ends, "ca", labels), "cb", labels).filter("ca <> cb").select("id", "n", "other", "overlap")

    near = _member_pairs(listed, bounded, percent, NEAR_TOKENS).groupBy("a", "other").agg(F.max(F.struct("n", "b")).alias("best"))
    first_tried = materialize(_may_link(
        in_question.filter("alone").select(F.col("id").alias("a"), F.col("other").alias("b")).unionByName(near.select("a", "best.b")), listed, percent), "tried")
    merge(links_of(first_tried))
    open_still, told = materialize_told(unsettled(), "open", F.count("*").alias("n"))
    if told["n"]:
        members_tried = _member_pairs(listed, open_still, percent).select("a", "b").join(first_tried, ["a", "b"], "left_anti")
        merge(links_of(_may_link(members_tried, listed, percent)))
    for done in (leading, listed, in_question, bounded, first_tried, open_still):
        drop_written(done)
    labelled = relabelled(heads.withColumnRenamed("id", "component"), "component", labels)
    rows = described.select("id", *of_class).join(labelled, of_class, "left")
    return rows.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def keep_one_each(docs: DataFrame, joined: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose id is its component's, and those without id, with all their columns."""
    row = docs.select(F.struct(*docs.columns).alias("row"))
    gone = joined.filter("component_id < id").select(F.col("id").alias("gone")).distinct()
    return row.join(gone, F.col(f"row.{id_column}").cast("long") == F.col("gone"), "left_anti").select("row.*")

"""Merkle manifest of a dataset: a tree of hashes per language, one over their roots, and each row's proof by pointer jumping.

A row's leaf hashes its fields. Within a language, leaves are in rising order of their id; every eight neighbours become one
node, until one is left, the language's subroot. The subroots are the leaves of a tree of the same kind, whose end is the root.

Proofs: each inner node holds an ancestor and the siblings met on the way there, at first its parent's and its own siblings. A
self-join on the ancestor doubles the distance and appends the ancestor's segment; after log2(depth) rounds every
segment ends at the root. Leaves of one run share all but their own siblings, so the segments are joined to runs, not to leaves.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescout.workspace import materialize

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# The tree over the subroots; trees of languages are numbered from 0 by the order of the languages.
TOP = -1

SEGMENT = "array<struct<l:string,r:string>>"

# monotonically_increasing_id has a row's place in its partition in these bits, the partition above them.
_INDEX_BITS = 33


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each `-` if null, else its UTF-8 byte count, `:` and itself."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return digest(*(part(f) for f in fields))


def lowered(text: Column) -> Column:
    """`text` with A-Z in lower case and nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def placed(rows: DataFrame, tree: list[str], order: list[str], label: str) -> DataFrame:
    """`rows`, written, with `pos`: the row's place (from 0) among those of its tree, in the order of the other columns.

    Rows are sorted by range; a small table of the count of each tree in each partition gives the offsets.
    """
    mid = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*tree, *order).sortWithinPartitions(*tree, *order).withColumn("mid", mid)
    ranged = materialize(ranged, label).withColumn("part", F.shiftright("mid", _INDEX_BITS))
    of_part = ranged.groupBy("part", *tree).agg(F.count("*").alias("rows_here"), F.min("mid").alias("first"))
    before = Window.partitionBy(*tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = of_part.withColumn("start", F.coalesce(F.sum("rows_here").over(before), F.lit(0))).select(
        F.col("part").alias("p"), *(F.col(c).alias(f"t_{c}") for c in tree), "first", "start")
    same = F.col("part") == F.col("p")
    for c in tree:
        same = same & F.col(c).eqNullSafe(F.col(f"t_{c}"))
    return ranged.join(starts, same).select(*rows.columns, (F.col("mid") - F.col("first") + F.col("start")).alias("pos"))


def height(rows: Column) -> Column:
    """How often `rows` nodes are put into runs until one is left."""
    grown, levels = F.lit(0), 1
    while FANOUT ** levels < 1 << 62:
        grown = grown + (rows > FANOUT ** (levels - 1)).cast("int")
        levels += 1
    return grown


def runs_of(nodes: DataFrame, level: int, kid: Column, hashed: str) -> DataFrame:
    """The nodes of the next level: one row a run, with its kids in order and the hash of their hashes.

    Trees of one node at this level are at their end, and give none.
    """
    kids = nodes.filter(F.col("height") >= level).groupBy("tree", "height", F.floor(F.col("pos") / FANOUT).alias("run")).agg(
        F.array_sort(F.collect_list(F.struct("pos", kid.alias("kid")))).alias("kids"))
    kids = kids.withColumn("kids", F.col("kids.kid"))
    hashes = F.col("kids")[hashed] if hashed else F.col("kids")
    return kids.select(
        "tree", "height", F.lit(level).alias("level"), F.col("run").alias("pos"), "kids",
        F.sha2(F.concat_ws("", hashes).cast("binary"), 256).alias("hash"))


def siblings(hashes: Column, at: Column) -> Column:
    """What stands left and right of one kid among the hashes of a run."""
    return F.struct(
        F.concat_ws("", F.slice(hashes, F.lit(1), at)).alias("l"),
        F.concat_ws("", F.slice(hashes, at + 2, F.lit(FANOUT))).alias("r"))


def _key(tree: str, level: Column, pos: Column) -> Column:
    """A node's name. The end of a language's tree is a leaf of the top tree."""
    at_end = (F.col(tree) != TOP) & (level == F.col("height"))
    return F.struct(
        F.when(at_end, F.lit(TOP)).otherwise(F.col(tree)).cast("long").alias("tree"),
        F.when(at_end, F.lit(0)).otherwise(level).cast("int").alias("level"),
        F.when(at_end, F.col(tree)).otherwise(pos).cast("long").alias("pos"))


def pointers(runs: DataFrame) -> DataFrame:
    """(node, anc, seg): every kid of a run points to the run, over its siblings there."""
    return runs.select("*", F.posexplode("kids").alias("at", "kid")).select(
        _key("tree", F.col("level") - 1, F.col("pos") * FANOUT + F.col("at")).alias("node"),
        _key("tree", F.col("level"), F.col("pos")).alias("anc"), F.array(siblings(F.col("kids"), F.col("at"))).alias("seg"))


def jump(table: DataFrame, depth: int) -> DataFrame:
    """All pointers led to the root: each round joins the table with itself and doubles the distances."""
    for _ in range(ceil(log2(depth)) if depth > 1 else 0):
        onward = table.select(F.col("node").alias("via"), F.col("anc").alias("far"), F.col("seg").alias("more"))
        table = materialize(table.join(onward, table["anc"] == onward["via"], "left").select(
            "node", F.coalesce("far", "anc").alias("anc"), F.when(F.col("more").isNull(), F.col("seg")).otherwise(
                F.concat("seg", "more")).alias("seg")), "pointers")
    return table


def folded(leaf: Column, seg: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(seg, leaf, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]).cast("binary"), 256))


def merkle_manifest(docs: DataFrame, id_column: str = "doc_id", tampered: Column | None = None) -> DataFrame:
    """One row for each row: id, leaf, subroot, root, `proof` (siblings by level, each level's `l` and `r`), and the check of the proof.

    `tampered` says which rows' texts are lower-cased (A-Z only) before the proof is folded again to `folded_root`; `verified`
    tells whether that equals the root. A row is tampered if `tampered` is true; null counts as false.

    Null fields are leaves' `-`; null ids come first. Rows of one id are ordered by their leaves, equal rows are leaves of their
    own. Null is a language like any other, and the first. A single row is its own subroot, a single language's subroot the
    root. No rows give none. Other columns are not read. The driver gets three numbers and the root.
    """
    fields = [F.col(id_column), *(F.col(c) for c in FIELDS[1:])]
    changed = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    leaves = docs.select(
        F.col(id_column).alias("id"), F.col("lang"), leaf_hash(fields).alias("leaf"),
        F.when(changed, leaf_hash([*fields[:-1], lowered(F.col("text"))])).alias("other"))
    # Written first: sorting by range reads its input twice, and would hash all texts twice.
    leaves = placed(materialize(leaves, "hashes"), ["lang"], ["id", "leaf"], "leaves")
    by_lang = materialize(leaves.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    langs = materialize(placed(by_lang.withColumn("all", F.lit(TOP)), ["all"], ["lang"], "languages").select(
        F.col("lang").alias("of"), F.col("pos").alias("tree"), height(F.col("rows")).alias("height")), "trees")
    n_langs, tallest = langs.agg(F.count("*"), F.coalesce(F.max("height"), F.lit(0))).first()

    nodes = leaves.join(langs, F.col("lang").eqNullSafe(F.col("of"))).drop("of")
    first = materialize(nodes.filter("height = 0").select(
        "tree", "height", F.lit(0).alias("level"), "pos", F.array(F.struct("id", "leaf", "other")).alias("kids"), F.col("leaf").alias("hash"),
    ).unionByName(runs_of(nodes, 1, F.struct("id", "leaf", "other"), "leaf")), "runs")
    levels, now = [], first.filter("level = 1")
    for level in range(2, tallest + 1):
        now = materialize(runs_of(now, level, F.col("hash"), ""), "runs")
        levels.append(now)
    ends = [part.filter("level = height").select("tree", F.col("hash").alias("subroot")) for part in (first, *levels)]
    subroots = materialize(reduce(DataFrame.unionByName, ends), "subroots")
    none = F.array().cast(SEGMENT)
    if not n_langs:
        text = F.lit(None).cast("string")
        return leaves.select("id", "leaf", text.alias("subroot"), text.alias("root"), none.alias("proof"), text.alias("folded_root"),
                             F.lit(None).cast("boolean").alias("verified"))
    now = subroots.select(
        F.lit(TOP).cast("long").alias("tree"), height(F.lit(n_langs)).alias("height"), F.col("tree").alias("pos"), F.col("subroot").alias("hash"))
    top = 0
    while FANOUT**top < n_langs:
        top += 1
        now = materialize(runs_of(now, top, F.col("hash"), ""), "runs")
        levels.append(now)
    root = F.lit(now.first()["hash"])

    out = first.join(subroots, "tree")
    if levels:
        way = materialize(reduce(DataFrame.unionByName, [pointers(part) for part in levels]), "pointers")
        way = jump(way, max(tallest - 1, 0) + top).select(F.col("node").alias("key"), F.col("seg").alias("beyond"))
        out = out.withColumn("key", _key("tree", F.col("level"), F.col("pos"))).join(way, "key", "left")
    else:
        out = out.withColumn("beyond", none)
    out = out.select("*", F.posexplode("kids").alias("at", "kid"))
    own = F.when(F.col("level") == 0, none).otherwise(F.array(siblings(F.col("kids.leaf"), F.col("at"))))
    out = out.select("kid.*", "subroot", F.concat(own, F.coalesce("beyond", none)).alias("proof"))
    out = out.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("proof")))
    return out.select("id", "leaf", "subroot", root.alias("root"), "proof", "folded_root", (F.col("folded_root") == root).alias("verified"))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all sibling hashes of a proof, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda s: F.concat(s["l"], s["r"]))).cast("binary"), 256)

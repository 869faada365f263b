"""Secret scans: patterns for whole credentials, and linking of the parts of a credential that stand near each other.

Whole credentials are found by three patterns. Weak parts (identifiers, secrets, endpoints) are looked for as well and joined by
interval: a weak part is reported only if a complementary part stands within its scope, SCOPE code points of the same text
around it. A secret complements identifiers and endpoints. Everything is made of column expressions and joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.workspace import materialize

SCOPE = 200
_BIN = 400

_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
# kind, pattern, group of the value, least length of the value, role in a credential. The first three are whole credentials.
BASE = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))" + _VALUE + r"([A-Za-z0-9+/_.=-]+)", 2, 12, "secret"),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, "id"),
    ("hex", r"[0-9a-f]{16,}", 0, 16, "secret"),
)
WEAK = (
    ("weak_id", r"\b(?i:user(?:_?name)?|login|account|client_?id|key_?id|access_?key(?:_?id)?)" + _VALUE + r"([A-Za-z0-9@_.-]+)", 1, 3, "id"),
    ("weak_secret", r"(?i:pass(?:phrase|word|wd)?|pwd|secret|token|auth|credential|key)" + _VALUE + r"([A-Za-z0-9+/_.=!$%&*-]+)", 1, 6, "secret"),
    ("endpoint", r"\b[a-z][a-z0-9+.-]{1,20}://([^\s\"'<>]+)", 1, 4, "endpoint"),
)
_ORDER = {kind: i for i, (kind, *_) in enumerate((*BASE, *WEAK))}
_SPANS = "array<struct<s:int,e:int>>"


def _spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """Places of all leftmost non-overlapping matches whose value is long enough, as code points with the end exclusive.

    What lies between matches and the matches themselves alternate, so their lengths add up to the places.
    """
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lengths = F.zip_with(between, whole, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("len")))
    parts = F.zip_with(lengths, value, lambda x, v: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), (F.length(v) >= least).alias("ok")))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(_SPANS).alias("out"))

    def merge(acc: Column, x: Column) -> Column:
        s = acc["pos"] + x["gap"]
        e = s + F.coalesce(x["len"], F.lit(0))
        grown = F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"))))
        return F.struct(e.alias("pos"), F.when(x["ok"], grown).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(parts, start, merge, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPANS))


def _marked(kind: str) -> Column:
    """The spans of one kind with what they are sorted by."""
    return F.transform(
        F.col(kind), lambda x: F.struct(x["s"].alias("s"), F.lit(_ORDER[kind]).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def _written(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])))


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row: `id`, `text_hash`, the base spans `assign`, `access`, `hex`, and `linked`: the weak parts reported.

    Spans are (s, e); linked ones (s, k, e, kind). Null texts are empty and have none. Equal rows get equal results; rows without
    an id are scanned like others. Only rows with parts that could complement each other take part in the joins.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    docs = docs.select(F.col(id_column).alias("id"), text.alias("text"))
    columns = {kind: _spans(F.col("text"), pattern, group, least) for kind, pattern, group, least, _ in (*BASE, *WEAK)}
    scanned = materialize(
        docs.select("id", F.xxhash64("text").alias("text_hash"), *[c.alias(k) for k, c in columns.items()]), "secrets")
    key = ["id", "text_hash"]
    any_weak = reduce(lambda a, b: a | b, [F.size(k) > 0 for k, *_ in WEAK])
    parts = (
        scanned.filter(any_weak)
        .select(*key, F.explode(F.concat(*[_marked(k) for k in _ORDER])).alias("p"))
        .select(*key, "p.*")
        .distinct()
    )
    roles = {kind: role for kind, _, _, _, role in (*BASE, *WEAK)}
    is_secret = F.col("kind").isin([k for k, r in roles.items() if r == "secret"])

    def binned(df: DataFrame, reach: int) -> DataFrame:
        first, last = ((F.col("s") - reach) / _BIN).cast("int") - 1, ((F.col("e") + reach) / _BIN).cast("int") + 1
        return df.withColumn("bin", F.explode(F.sequence(first, last)))

    # A place holds a bounded number of parts, so a bin does too, however long its text.
    secrets, others = parts.filter(is_secret), parts.filter(~is_secret)

    def near(a: DataFrame, b: DataFrame) -> DataFrame:
        """The weak parts of `a` with a part of `b` in their scope."""
        a = binned(a.filter(F.col("kind").isin([k for k, *_ in WEAK])), SCOPE).alias("a")
        b = binned(b, 0).alias("b")
        within = (F.col("b.s") <= F.col("a.e") + SCOPE) & (F.col("a.s") <= F.col("b.e") + SCOPE)
        same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.text_hash") == F.col("b.text_hash")) & (F.col("a.bin") == F.col("b.bin"))
        return a.join(b, same & within, "left_semi").select(*key, "s", "k", "e", "kind")

    linked = (
        near(secrets, others).unionByName(near(others, secrets)).distinct()
        .groupBy(*key).agg(F.collect_list(F.struct("s", "k", "e", "kind")).alias("linked"))
        .withColumnRenamed("id", "linked_id").withColumnRenamed("text_hash", "linked_hash")
    )
    on = F.col("id").eqNullSafe(F.col("linked_id")) & (F.col("text_hash") == F.col("linked_hash"))
    empty = F.array().cast("array<struct<s:int,k:int,e:int,kind:string>>")
    return scanned.join(linked, on, "left").select(
        *key, *[k for k, *_ in BASE], F.coalesce("linked", empty).alias("linked"))


def report(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans written out as kind:start:end."""
    base = F.concat(*[_marked(k) for k, *_ in BASE])
    return found.select(
        "id", *[F.size(k).cast("long").alias(f"n_{k}") for k, *_ in BASE],
        F.sha2(_written(base), 256).alias("base_sha256"), _written(F.concat(base, F.col("linked"))).alias("spans"))


def redact_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """`docs` with each reported span of its texts replaced by `mask`; overlapping spans become one.

    Texts without any are left as they are, null ones too. Only texts that match a pattern are joined with their spans. Names of input
    columns do not matter: all columns are carried as one.
    """
    row = docs.select(F.struct(*docs.columns).alias("row"))
    suspect = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"row.{text_column}"), F.lit("")).rlike(p) for _, p, *_ in (*BASE, *WEAK)])
    row = row.withColumn("suspect", suspect)
    clean, dirty = row.filter(~F.col("suspect")), row.filter("suspect")
    found = find_secrets(dirty.select(F.col(f"row.{id_column}").alias("id"), F.col(f"row.{text_column}").alias("text")), "id", "text")
    spans = found.select(
        F.col("id").alias("found_id"), "text_hash",
        F.array_sort(F.concat(*[_marked(k) for k, *_ in BASE], F.col("linked"))).alias("spans")).filter("size(spans) > 0").distinct()
    text = F.coalesce(F.col(f"row.{text_column}"), F.lit(""))
    joined = dirty.join(spans, F.col(f"row.{id_column}").eqNullSafe(F.col("found_id")) & (F.xxhash64(text) == F.col("text_hash")), "left")
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def merge(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["pos"] + 1, x["s"] - acc["pos"])
        apart = F.concat(acc["out"], gap, F.lit(mask))
        return F.struct(
            F.greatest(acc["pos"], x["e"]).alias("pos"), F.when(x["s"] >= acc["pos"], apart).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(F.col("spans"), start, merge, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    new = F.when(F.col("spans").isNull(), F.col(f"row.{text_column}")).otherwise(done)
    redacted = joined.select(F.col("row").withField(text_column, new).alias("row"))
    return clean.select("row").unionByName(redacted).select("row.*")

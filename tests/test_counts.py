"""Value counts by storage kind, and what is cut before it is sorted."""

import datetime
import hashlib

from pyspark.sql import functions as F

from tablescout import TableSource, profile
from tablescout.functions.text import with_word_stats
from tablescout.operators import counts as c
from tablescout.operators import profile as p
from tablescout.operators import sketch

TEXTS = ["", " ", "A b", "a b ", "x" * 256, "X" * 257, "y z" * 100, None, "1.0", "-7"]


def odd_tables(spark):
    """All storage kinds, with NULLs, long texts and odd numbers."""
    rows = [
        (i % 5 - 2 if i % 7 else None, [0.0, -0.0, 1e7, 1e20, 5e-4, float("nan"), -2.5][i % 7], TEXTS[i % 10],
         datetime.datetime(2024, 1, 1 + i % 3, 10, 0, 0, 1000 * (i % 2)), datetime.date(2024, 2, 1 + i % 4), i % 2 == 0)
        for i in range(60)]
    df = spark.createDataFrame(rows, "i int, d double, s string, t timestamp_ntz, day date, b boolean")
    return {"t": df.withColumn("m", F.col("i").cast("decimal(9,2)"))}


def test_dates_and_short_texts_are_counted_by_plain_keys(spark):
    source = TableSource(odd_tables(spark))
    kinds = {f.name: c.storage_of(f.data_type) for f in source.fields["t"]}
    assert kinds == {"i": "whole", "d": "real", "s": "text", "t": "timestamp_ntz", "day": "date", "b": "text", "m": "text"}
    got = {}
    for r in source.raw_counts().join(source.columns().select("column_id", "column_name"), "column_id").collect():
        name, value = r["column_name"], (r["long"]["digest"] if r["long"] else r["v"])
        got.setdefault(name, {})[value] = r["n"]
        assert (r["long"] is not None) == (r["v"] is not None and name == "s" and len(r["v"]) == 256 and r["v"] != "x" * 256)
    for f in source.fields["t"]:
        text = F.expr(c.text_sql(f"`{f.name}`", f.data_type))
        value = F.when(F.length(text) > c.HEAD_CHARS, F.sha2(text, 256)).otherwise(text)
        want = odd_tables(spark)["t"].groupBy(value.alias("v")).count().collect()
        merged = {}
        for r in want:
            merged[r["v"]] = merged.get(r["v"], 0) + r["count"]
        # Both zeros are one number.
        if f.name == "d":
            merged["0.0"] += merged.pop("-0.0", 0)
        assert got[f.name] == merged, f.name


def test_moments_that_are_printed_alike_are_one_value(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        df = spark.createDataFrame([(1603585800,), (1603589400,), (1603593000,)], "s bigint").select(F.timestamp_seconds("s").alias("t"))
        rows = TableSource({"t": df}).raw_counts().select("v", "n", "type_class").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted(map(tuple, rows)) == [("2020-10-25 02:30:00", 2, "date"), ("2020-10-25 03:30:00", 1, "date")]


def test_texts_of_numbers_are_not_stored(spark):
    prof = profile(TableSource(odd_tables(spark)))
    raw = prof.source.raw_counts()
    stored = c.to_store(raw)
    assert stored.where("(i is not null or d is not null) and v is not null").isEmpty()
    again = c.from_store(stored).select(raw.columns)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, raw.collect()))
    # A text that is another than its number's own is kept.
    other = raw.where("i = 1").withColumn("v", F.lit("+01"))
    assert [r["v"] for r in c.from_store(c.to_store(other)).collect()] == ["+01"]


def test_numbers_are_one_word(spark):
    rows = profile(TableSource(odd_tables(spark))).counts.where("digest is null")
    assert {r["words"] for r in rows.where("i is not null or d is not null").collect()} == {1}
    again = with_word_stats(rows.drop(*c.WORD_STATS), "v").select(rows.columns)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, rows.collect()))


def test_first_numbers_need_no_sort_of_all(spark):
    """Of 20,000 numbers of a column that tie, few are sorted, and they are the first by frequency and size."""
    tied = spark.range(20_000).selectExpr("1L as column_id", "'numeric' as type_class", "pmod(hash(id), 1000003) + 0L as i", "cast(null as double) as d", "7L as n")
    mixed = spark.range(3_000).selectExpr(
        "2L as column_id", "'numeric' as type_class", "cast(null as bigint) as i", "(id * 37 % 3001) / 4 as d", "if(id < 4, 9L, if(id < 9, 8L, 3L)) as n")
    few = spark.range(3).selectExpr("3L as column_id", "'numeric' as type_class", "id as i", "cast(null as double) as d", "id + 1 as n")
    rest = spark.range(50).selectExpr(
        "4L as column_id", "'numeric' as type_class", "if(id % 2 = 0, id, null) as i", "if(id % 2 = 1, if(id = 7, double('nan'), id + 0.5), null) as d", "5L as n")
    numbers = tied.distinct().unionByName(mixed).unionByName(few).unionByName(rest)
    kept = p._may_lead(numbers, p.TOP_VALUES)
    # Two kinds of numbers in a column are cut by themselves, and 64 parts seldom hide many of the first ten.
    assert kept.count() < 150
    order = [F.col("n").desc(), F.col("i"), F.col("d")]

    def first(df):
        return sorted(map(repr, c.top_per_group(df.select("column_id", "n", "i", "d"), ["column_id"], order, p.TOP_VALUES, rank="r").collect()))

    assert first(kept) == first(numbers)


def test_sketches_sort_few_hashes(spark, monkeypatch):
    """Columns whose values merge, and bounds that leave too few hashes, give the same sketches."""
    words = [f"{'K' if i % 3 else 'k'}ey {i // 2}{' ' * (i % 2)}" for i in range(3_000)]
    df = spark.createDataFrame([(i, w, "z" * 300 + str(i % 40)) for i, w in enumerate(words)], "i bigint, s string, long string")
    raw = profile(TableSource({"t": df})).raw_counts

    def hashes(values):
        return sorted({hashlib.md5(v.strip().lower().encode()).hexdigest()[:16] for v in values})

    all_of = [hashes(map(str, range(3_000))), hashes(words), hashes({"z" * 300 + str(i) for i in range(40)})]
    want = sorted((h[:128], len(h)) for h in all_of)
    assert sorted((r["sig"], r["n"]) for r in sketch.minhash(raw).collect()) == want
    # A bound that leaves some 28 hashes of each column.
    monkeypatch.setattr(sketch, "MARGIN", -100)
    assert sorted((r["sig"], r["n"]) for r in sketch.minhash(raw).collect()) == want

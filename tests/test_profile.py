"""Profiles of small tables against hand-worked values and brute force."""

import hashlib
import math
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablescout import TableSource, profile, profile_lake
from tablescout.operators.counts import HEAD_CHARS
from tablescout.operators.sketch import minhash


def one(prof, column):
    return prof.column_profile.where(F.col("column_name") == column).head()


def test_frequencies(spark):
    df = spark.createDataFrame([("x",), ("y",), ("z",), ("z",)], "v string")
    row = one(profile(TableSource({"t": df})), "v")
    assert row["frequency_avg"] == pytest.approx(4 / 3, abs=1e-9)
    assert (row["frequency_min"], row["frequency_max"]) == (1, 2)
    assert row["frequency_sd"] == pytest.approx(0.471404521, abs=1e-9)
    assert row["val_pct_max"] == row["constancy"] == 0.5
    assert row["entropy"] == 1.5
    assert (row["frequency_4qo"], row["frequency_7qo"], row["frequency_iqr"]) == (0.25, 0.5, 0.25)
    assert row["freq_word_containment"] == ["z", "x", "y"]


def test_words(spark):
    df = spark.createDataFrame([("a bb",), ("cccc",), (None,)], "v string")
    row = one(profile(TableSource({"t": df})), "v")
    assert (row["len_avg_word"], row["len_min_word"], row["len_max_word"]) == (2.75, 1, 4)
    assert (row["number_words"], row["words_cnt_avg"], row["words_cnt_sd"]) == (3, 1.5, 0.5)
    assert (row["row_count"], row["non_null"]) == (3, 2)
    assert row["incompleteness"] == pytest.approx(1 / 3, abs=1e-9)
    assert row["uniqueness"] == pytest.approx(2 / 3, abs=1e-9)


def test_all_null_columns_are_dropped_but_described(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    prof = profile(TableSource({"t": df}))
    assert [r["column_name"] for r in prof.column_profile.collect()] == ["a"]
    assert prof.table_profile.head()["col_count"] == 1
    assert prof.summaries.head()["summary"].startswith("This dataset has 2 columns: 1 numeric column (a); 1 text column (b). ")


def test_types_order_and_bounds(spark):
    df = spark.createDataFrame([(9, 1.5), (10, 10.25), (-3, 9.0), (2**60 + 1, 0.0), (2**60, 0.0)], "i bigint, d double")
    df = df.withColumn("m", F.col("d").cast("decimal(10,2)"))
    prof = profile(TableSource({"t": df}))
    assert (one(prof, "i")["first_word"], one(prof, "i")["last_word"]) == ("-3", str(2**60 + 1))
    assert one(prof, "i")["freq_word_containment"] == ["-3", "9", "10", str(2**60), str(2**60 + 1)]
    assert (one(prof, "d")["first_word"], one(prof, "d")["last_word"]) == ("0.0", "10.25")
    assert (one(prof, "m")["first_word"], one(prof, "m")["last_word"]) == ("0.00", "10.25")
    assert one(prof, "m")["freq_word_containment"] == ["0.00", "1.50", "9.00", "10.25"]


def test_nested_columns_and_varchar_only(spark):
    df = spark.createDataFrame([(1, "a", [1], True)], "i int, s string, arr array<int>, b boolean")
    assert {r["column_name"] for r in profile(TableSource({"t": df})).column_profile.collect()} == {"i", "s", "b"}
    prof = profile(TableSource({"t": df}, varchar_only=True))
    assert {r["column_name"] for r in prof.column_profile.collect()} == {"s", "b"}
    with pytest.raises(ValueError):
        TableSource({"t": df.select("arr")})


def long_rows():
    base = "Same beginning " * 40
    rows = [base + str(i % 7) + (" x" * i) for i in range(12)]
    return [*rows, *rows[:3], base + "0", "short", "  Short ", "short\n", base.upper() + "6" + " X" * 6, None, " " * 300 + "Pad"]


def brute(values, clean):
    counts = Counter(clean(v) for v in values if v is not None)
    return counts, [v for v, _ in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:10]]


def test_long_values_match_brute_force(spark):
    rows = long_rows()
    assert sum(len(v or "") > HEAD_CHARS for v in rows) > 10
    prof = profile(TableSource({"t": spark.createDataFrame([(v,) for v in rows], "v string")}))
    row = one(prof, "v")

    def clean(v):
        return v.strip(" ").replace("\n", "").replace("\r", "").lower()

    counts, top = brute(rows, clean)
    present = [clean(v) for v in rows if v is not None]
    words = [v.split(" ") for v in present]
    assert row["cardinality"] == len(counts)
    assert row["freq_word_containment"] == top
    assert (row["first_word"], row["last_word"]) == (min(present), max(present))
    assert row["entropy"] == pytest.approx(
        -sum(n / len(present) * math.log2(n / len(present)) for n in counts.values()), abs=1e-9)
    assert row["len_max_word"] == max(len(w) for ws in words for w in ws)
    assert row["len_min_word"] == min(len(w) for ws in words for w in ws)
    assert row["len_avg_word"] == pytest.approx(statistics.mean(statistics.mean(map(len, ws)) for ws in words), abs=1e-9)
    assert row["words_cnt_sd"] == pytest.approx(statistics.pstdev(map(len, words)), abs=1e-7)
    raw = [v for v in rows if v is not None]
    assert (row["val_len_min"], row["val_len_max"]) == (min(map(len, raw)), max(map(len, raw)))

    # The summary shows raw values, most frequent first.
    raw_counts = Counter(raw)
    top_raw = [v for v, _ in sorted(raw_counts.items(), key=lambda kv: (-kv[1], kv[0]))[:10]]
    assert ": " + ", ".join(top_raw) + ")" in prof.summaries.head()["summary"]

    hashes = sorted({hashlib.md5(v.lower().strip().encode()).hexdigest() for v in raw})
    sketch = minhash(prof.raw_counts).head()
    assert sketch["n"] == len(hashes)
    assert sketch["sig"] == [h[:16] for h in hashes]


def test_hot_value(spark):
    """A third of all rows hold one value, the rest are unique."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), "id")).alias("v"))
    row = one(profile(TableSource({"t": df})), "v")
    assert (row["cardinality"], row["frequency_max"], row["freq_word_containment"][0]) == (2001, 1000, "hot")


def test_profile_lake(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "i int, s string")
    raw, z, typed = profile_lake(TableSource({"t": df}))
    got = {r["column_name"]: r["cardinality"] for r in z.collect()}
    assert got == {"i": pytest.approx(0.707107), "s": pytest.approx(-0.707107)}
    assert dict(typed.dtypes)["is_binary"] == "double"
    assert {r["column_name"]: r["freq_word_containment"] for r in typed.collect()}["s"] == ["a", "b"]
    assert raw.count() == 2


def test_soundex(spark):
    df = spark.createDataFrame([("Robert",), ("Rupert",), ("Tymczak",)], "v string")
    row = one(profile(TableSource({"t": df})), "v")
    assert row["freq_word_soundex_containment"] == ["R163", "R163", "T522"]


def test_ties_of_long_values_are_settled_on_whole_texts(spark):
    """Many values of one head, more frequent ones before them, and a value that is the head itself."""
    head = "h" * 256
    tails = [f"{i:05d}" for i in range(3000)]
    values = [head + t for t in tails] + [head] + ["often"] * 3 + [head + "00042"] * 2 + ["a", "z" * 256, "z" * 256 + "y", "z" * 300]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(6)
    row = profile(TableSource({"t": df})).column_profile.head()
    counts = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    top = sorted(counts, key=lambda v: (-counts[v], v))[:10]
    assert row["freq_word_containment"] == top
    assert (row["first_word"], row["last_word"]) == (min(counts), max(counts))
    only_long = spark.createDataFrame([(head + t,) for t in tails], "v string")
    row = profile(TableSource({"t": only_long})).column_profile.head()
    assert row["freq_word_containment"] == [head + t for t in tails[:10]]
    assert (row["first_word"], row["last_word"]) == (head + tails[0], head + tails[-1])


def test_types_of_long_values_are_of_their_whole_text(spark):
    from tablescout.plans.profiling import Profile
    from tablescout.plans.registry import _inferred

    zeros = "0" * 260
    df = spark.createDataFrame(
        [(zeros + "text", zeros + "7", "01:02:03." + zeros, "1"), ("1", "2.5", "01:02:03", zeros + "x")], "a string, b string, c string, d string")
    types = {r["column_name"]: r["data_type"] for r in _inferred(Profile(TableSource({"t": df}))).collect()}
    assert types == {"a": "string", "b": "double", "c": "time", "d": "string"}

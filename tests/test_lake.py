"""Building and searching a lake."""

import pytest
from pyspark.sql import functions as F

from tablescout import Lake, TableSource, build_lake, list_lakes
from tablescout.operators.embedding import hashing_encoder, model_encoder, nearest, nearest_approx
from tablescout.operators.joinability import best_pairs, column_pairs, table_joinability
from tablescout.operators.ranking import RANKING_COLUMNS
from tablescout.plans.lake import BuildConflict, drop_old_versions
from tablescout.sources.source import parquet_source


def names(spark, prefix, start, stop, column):
    return spark.range(start, stop).select(F.format_string(f"{prefix}%04d", "id").alias(column))


@pytest.fixture(scope="module")
def tables(spark):
    people = names(spark, "Name#", 0, 300, "person").withColumn("city", F.concat(F.lit("c"), F.col("person").substr(-1, 1)))
    return {
        "people": people,
        "buyers": names(spark, "name#", 100, 400, "buyer"),
        "copy_a": people, "copy_b": people,
        "other": names(spark, "Zed", 0, 50, "thing"),
        "numbers": spark.range(100).withColumnRenamed("id", "n"),
    }


@pytest.fixture(scope="module")
def lake(spark, tables, tmp_path_factory):
    folder = tmp_path_factory.mktemp("lakes")
    return build_lake(TableSource(tables), f"{folder}/one", "One", "first")


def test_search_indexed(lake):
    ranking = lake.search_indexed("people")
    assert ranking.columns == ["query_table", *RANKING_COLUMNS]
    rows = ranking.collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
    assert {r["candidate_table"] for r in rows} == {"buyers", "copy_a", "copy_b", "other", "numbers"}
    assert {r["candidate_table"] for r in rows[:2]} == {"copy_a", "copy_b"}
    assert rows[0]["joinability_score"] == 1.0 and rows[0]["n_join_keys"] == 2
    assert rows[0]["join_columns"] == "person ↔ person (1.00); city ↔ city (1.00)"
    # The zero tail is in lake order.
    assert [r["candidate_table"] for r in rows[3:]] == ["numbers", "other"]
    assert rows[3]["similarity_score"] == 0.0 and rows[3]["best_query_column"] is None


def test_unknown_names(lake):
    with pytest.raises(KeyError):
        lake.search_indexed("nobody")


def test_search_all_equals_single_searches(lake, tables):
    full = [r for t in tables for r in lake.search_indexed(t, top_n=None).collect()]
    for top_n in (1, 2, 10):
        got = {tuple(r) for r in lake.search_all(top_n=top_n).collect()}
        assert got == {tuple(r) for r in full if r["rank"] <= top_n}


def test_search_of_an_unseen_table(lake, tables):
    stored = [tuple(r) for r in lake.search_indexed("people", top_n=None).collect()]
    assert [tuple(r) for r in lake.search(tables["people"], top_n=None, query_name="people").collect()] == stored
    fresh = lake.search(tables["people"]).collect()
    assert fresh[0]["query_table"] == "query" and len(fresh) == 6
    with pytest.raises(ValueError):
        lake.search(tables["people"].limit(0))


def test_pool(lake):
    pool = lake.search_indexed("people", rerank_pool=3).collect()
    assert len(pool) == 2
    everything = lake.search_indexed("people", top_n=None).collect()
    assert [tuple(r) for r in lake.search_indexed("people", top_n=None, rerank_pool=100).collect()] == [
        tuple(r) for r in everything]
    assert lake.search_indexed("people", rerank_pool=3, approximate=True).count() == 2


def test_empty_ranking_keeps_its_columns(lake):
    ranking = lake.search_indexed("people", rerank_pool=1)
    assert ranking.columns == ["query_table", *RANKING_COLUMNS] and ranking.count() == 0


def test_catalog(spark, lake, tables):
    again = Lake(spark, lake.path)
    assert again.meta["n_tables"] == len(tables)
    assert again.search_indexed("buyers").head() == lake.search_indexed("buyers").head()
    folder = lake.path.rsplit("/", 1)[0]
    rebuilt = build_lake(TableSource({"people": tables["people"]}), lake.path, "Two")
    assert rebuilt.meta["name"] == "Two" and Lake(spark, lake.path).meta["n_tables"] == 1
    build_lake(TableSource({"other": tables["other"]}), f"{folder}/another", "Another")
    assert [(r["lake"], r["name"], r["n_tables"]) for r in list_lakes(spark, folder).collect()] == [
        ("another", "Another", 1), ("one", "Two", 1)]
    # A loaded lake keeps reading the version it was loaded with.
    assert lake.search_indexed("people").count() == 5


def test_tables_without_values_are_skipped(spark, tables, tmp_path):
    empty = spark.createDataFrame([], "a string")
    lake = build_lake(TableSource({"people": tables["people"], "empty": empty}), str(tmp_path / "l"), "L")
    assert lake.meta["skipped"] == ["empty"] and lake.meta["n_tables"] == 1
    with pytest.raises(ValueError):
        build_lake(TableSource({"empty": empty}), str(tmp_path / "m"), "M")


def test_ranks_of_a_long_ranking(spark):
    from tablescout.operators.ranking import ranked

    rows = spark.range(700).select(
        F.lit("q").alias("query_table"), F.format_string("t%03d", (F.col("id") * 37) % 700).alias("candidate_table"),
        (F.floor(F.col("id") / 90) / 10).alias("similarity_score"), *(F.lit(0.0).alias(c) for c in RANKING_COLUMNS[3:6]),
        *(F.lit("").alias(c) for c in RANKING_COLUMNS[6:]))
    rows = rows.unionByName(rows.limit(9).withColumn("query_table", F.lit("r")))
    full = ranked(rows, None)
    got = [(r["query_table"], r["rank"], r["candidate_table"]) for r in full.collect()]
    expected = sorted(rows.collect(), key=lambda r: (r["query_table"], -r["similarity_score"], r["candidate_table"]))
    places = {"q": 0, "r": 0}
    for row, (q, rank, name) in zip(expected, got, strict=True):
        places[q] += 1
        assert (q, rank, name) == (row["query_table"], places[q], row["candidate_table"])
    assert full.schema["rank"].dataType == ranked(rows, 3).schema["rank"].dataType
    assert ranked(rows.limit(0), None).count() == 0


def test_of_two_builds_at_once_one_is_refused(spark, tables, tmp_path):
    path = f"{tmp_path}/lake"
    small = TableSource({"people": tables["people"]})
    others = iter([lambda: build_lake(TableSource({"other": tables["other"]}), path, "second")])

    def meanwhile(step, done, total):
        next(others, lambda: None)()

    with pytest.raises(BuildConflict):
        build_lake(small, path, "first", progress=meanwhile)
    lake = Lake(spark, path)
    assert (lake.meta["name"], lake.meta["number"]) == ("second", 1)
    assert len(list((tmp_path / "lake").glob("v-*"))) == 1
    assert build_lake(small, path, "third").meta["number"] == 2
    assert drop_old_versions(spark, path, older_than_s=3600) == []
    assert drop_old_versions(spark, path, older_than_s=0) == [lake.meta["version"]]
    assert Lake(spark, path).meta["name"] == "third" and len(list((tmp_path / "lake").glob("v-*"))) == 1
    assert [r["name"] for r in list_lakes(spark, str(tmp_path)).collect()] == ["third"]


def test_tables_that_cannot_be_read_are_skipped(spark, tables, tmp_path):
    good = {"people": tables["people"], "buyers": tables["buyers"], "other": tables["other"]}
    for name, df in good.items():
        df.write.parquet(f"{tmp_path}/in/{name}.parquet")
    people = next((tmp_path / "in" / "people.parquet").glob("part-*.parquet"))
    raw = people.read_bytes()
    # The footer stays, so the table opens, but its data cannot be read.
    people.write_bytes(raw[:4] + b"\xff" * (len(raw) // 3) + raw[4 + len(raw) // 3 :])
    for crc in (tmp_path / "in" / "people.parquet").glob(".*.crc"):
        crc.unlink()
    (tmp_path / "in" / "junk.parquet").write_bytes(b"no table")
    source = parquet_source(spark, f"{tmp_path}/in")
    assert source.skipped == ["junk"] and set(source.tables) == set(good)
    lake = build_lake(source, f"{tmp_path}/lake", "L")
    assert lake.meta["skipped"] == ["junk", "people"] and lake.meta["n_tables"] == 2
    assert [w.split(":")[0] for w in lake.meta["skip_reasons"]] == ["junk", "people"]
    assert {r["candidate_table"] for r in lake.search_indexed("buyers", top_n=None).collect()} == {"other"}
    with pytest.raises(Exception):
        build_lake(TableSource({"people": spark.read.parquet(f"{tmp_path}/in/people.parquet")}), f"{tmp_path}/none", "N")


def test_nearest(spark):
    import random

    rng = random.Random(7)
    vecs = []
    for i in range(400):
        v = [rng.gauss(0, 1) for _ in range(16)]
        norm = sum(x * x for x in v) ** 0.5
        vecs.append((str(i), [x / norm for x in v]))
    df = spark.createDataFrame(vecs, "table_name string, vec array<double>")
    hits = 0
    for q in range(5):
        exact = [r["table_name"] for r in nearest(df, vecs[q][1], 10).collect()]
        brute = sorted(vecs, key=lambda v: -sum(a * b for a, b in zip(v[1], vecs[q][1])))[:10]
        assert exact == [name for name, _ in brute]
        approx = [r["table_name"] for r in nearest_approx(df, vecs[q][1], 10).collect()]
        assert len(approx) == 10
        hits += len(set(exact) & set(approx))
    assert hits >= 40, f"recall {2 * hits}%"


class LengthModel:
    def encode(self, texts):
        return [[float(len(t)), 1.0] for t in texts]


def test_encoders(spark):
    texts = spark.createDataFrame([("a", "one two two"), ("b", "123")], "table_name string, table_text string")
    vecs = {r["table_name"]: r["vec"] for r in hashing_encoder(texts).collect()}
    assert sorted(x for x in vecs["a"] if x) == pytest.approx([5**-0.5, 2 * 5**-0.5])
    assert vecs["b"] == [0.0] * 384
    custom = {r["table_name"]: r["vec"] for r in model_encoder(LengthModel)(texts).collect()}
    assert custom["b"] == pytest.approx([3 / 10**0.5, 1 / 10**0.5])


@pytest.mark.parametrize("many_queries,chunk", [(False, 1000), (True, 1000), (True, 2)])
def test_pairs_equal_the_nested_loop(spark, monkeypatch, many_queries, chunk):
    """Matching through shared hashes loses no pair, copies and hot hashes included."""
    monkeypatch.setattr("tablescout.operators.joinability.KEY_CHUNK", chunk)
    import random

    rng = random.Random(3)
    words = [f"{i:016x}" for i in range(60)]
    cols = []
    for t in range(14):
        for c in range(2):
            sig = sorted({words[0], *rng.sample(words, rng.randint(1, 20))}) if t % 3 else ["0" * 16]
            cols.append((f"t{t:02d}", f"c{c}", c, "CATEGORY", sig, len(sig), "string", 1, rng.randint(1, 4)))
    schema = ("table_name string, column_name string, column_pos int, role string, sig array<string>, n bigint,"
              " type string, len_min int, len_max int")
    df = spark.createDataFrame(cols, schema)

    def score(a, b):
        union = sorted({*a[4], *b[4]})[:128]
        jac = len([h for h in union if h in a[4] and h in b[4]]) / len(union)
        inter = jac * (a[5] + b[5]) / (1 + jac)
        span = max(a[8], b[8]) - min(a[7], b[7])
        ov = 1.0 if span <= 0 else max(0, min(a[8], b[8]) - max(a[7], b[7])) / span
        return min(1.0, max(inter / a[5], inter / b[5])) * (0.5 + 0.5 * ov)

    want = {(a[0], a[1], b[0], b[1]): score(a, b) for a in cols for b in cols if a[0] != b[0] and score(a, b) > 0}
    pairs = column_pairs(df, df, many_queries)
    assert pairs.count() == len(want)
    got = {(r["q_table"], r["q_column"], r["c_table"], r["c_column"]): r["j"] for r in pairs.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    for r in table_joinability(best_pairs(pairs)).collect():
        best = sorted((max(want.get((r["q_table"], f"c{q}", r["c_table"], f"c{c}"), 0) for c in range(2))
                       for q in range(2)), reverse=True)
        assert r["joinability"] == pytest.approx(1 - (1 - best[0]) * (1 - best[1]))

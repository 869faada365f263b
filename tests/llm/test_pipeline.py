"""The pipeline: every stage's decisions take effect, and what is clean stays."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from tablescout.llm import queries as Q

from .conftest import EDGES, SF, prose, table
from .test_near_copies import brute_components, window_similarity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS
    told, single, clean, masked, coded = seen
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert told == {i: t for i, t in given.items() if t and any(map(str.isalpha, t))}
    roots = brute_components(list(told.items()))
    assert single == {i: t for i, t in told.items() if roots[i] == i}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert clean.keys() == {i for i, t in single.items() if max(window_similarity(t, x) for x in items) < 0.75}
    assert masked.keys() == clean.keys() == coded.keys()
    changed = {i for i in masked if masked[i] != clean[i]}
    assert changed == {i for i, t in clean.items() if re.search(r"token = \"[0-9a-f]{40}", t) or "AKIA" in t or "[SECRET]" in masked[i]}
    assert docs.filter("n_tokens = 0").count() == 0


def test_run_is_its_stages(spark):
    assert dict(corpus_pipeline.STAGES).keys() == {
        "language ID", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "SentencePiece encoding and decoding"}
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*COLUMNS, "token_ids", "n_tokens"]
    assert out.filter("n_chars <> char_length(text)").count() == 0


def test_stages_on_odd_and_empty_tables(spark, edges, nothing):
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, edges, SF)
        assert set(out.columns) >= set(edges.columns)
        assert f(spark, nothing, SF).count() == 0
    assert stage("language ID")(spark, edges, SF).count() == len(EDGES) - 4
    rows = [(1, "a text with token = abcdef123456 in it"), (2, prose(3, 20))]
    got = {r["doc_id"]: r["text"] for r in stage("secret scans")(spark, table(spark, rows), SF).collect()}
    assert got == {1: "a text with [SECRET] in it", 2: rows[1][1]}


def test_first_stage_keeps_what_has_no_label_and_clashing_values(spark, edges):
    plain = [(i, prose(i, 30)) for i in range(20)]
    unlabelled = table(spark, plain).withColumn("lang", F.lit(None).cast("string"))
    kept = stage("language ID")(spark, unlabelled, SF)
    assert kept.columns == unlabelled.columns and kept.count() == 20
    out = stage("language ID")(spark, edges, SF)
    assert out.columns == edges.columns
    assert {(r["lang_pred"], r["lang_score"], r["lang"]) for r in out.collect()} == {("lang_pred!", "lang_score!", "en")}


def test_all_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(Q.QUERIES) <= set(names)

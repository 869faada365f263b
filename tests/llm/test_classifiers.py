"""Language ID and quality scores: held-out accuracy, and a defined result for every odd row."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tablescout.llm import language as L
from tablescout.llm import quality as Q
from tablescout.llm.arrow_text import utf8
from tablescout.llm.queries import QUERIES

from .conftest import EDGES


def test_language_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op1_language_id"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas()
    both = out.merge(docs, on="doc_id")
    assert len(both) == len(docs)
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert out.score.between(0, 1).all()


def test_look_ups_equal_the_convolution():
    rng = np.random.default_rng(0)
    texts = ["the one and the other " * 20, "der eine und die anderen " * 20, "un et deux " * 40] * 4
    net = L.train(L.as_windows(texts), ["en", "de", "fr"] * 4, epochs=2)
    x = rng.integers(0, 256, (3, L.WINDOW))
    expected = []
    for w, weights in zip(L.WIDTHS, net.filters):
        e = net.embedding[x]
        columns = np.concatenate([e[:, j : j + L.WINDOW - w + 1] for j in range(w)], axis=2)
        expected.append((columns @ weights).max(axis=1))
    hidden = np.maximum(np.concatenate(expected, axis=1) + net.filter_bias, 0)
    assert np.allclose(net.window_logits(x.astype(np.uint8)), hidden @ net.output + net.output_bias, atol=1e-4)


def test_gradients_are_right():
    rng = np.random.default_rng(1)
    texts = [f"{w} " * 60 for w in ("the", "der", "les")]
    net = L.train(L.as_windows(texts), ["a", "b", "c"], epochs=1)
    p = {"e": net.embedding, **{f"w{w}": f for w, f in zip(L.WIDTHS, net.filters)}, "fb": net.filter_bias + 0.3, "o": net.output, "ob": net.output_bias}
    p = {k: v.astype(np.float64) for k, v in p.items()}
    x, y, weight = L.as_windows(texts).astype(np.int64), np.array([0, 1, 2]), np.ones(3)

    def loss(q):
        pooled = [np.concatenate([q["e"][x][:, j : j + L.WINDOW - w + 1] for j in range(w)], axis=2) @ q[f"w{w}"] for w in L.WIDTHS]
        hidden = np.maximum(np.concatenate([c.max(axis=1) for c in pooled], axis=1) + q["fb"], 0)
        z = hidden @ q["o"] + q["ob"]
        return -np.mean(z[np.arange(3), y] - np.log(np.exp(z).sum(axis=1)))

    grads = L._gradients(p, x, y, weight)
    for name in p:
        at = tuple(rng.integers(0, n) for n in p[name].shape)
        if name == "e":
            at = (ord("e"), 2)
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert grads[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-3)


def test_odd_texts(spark, edges, nothing):
    model = L.fit_language_model(edges)
    out = L.identify_languages(edges, model)
    assert set(out.columns) == set(edges.columns)
    got = [(r["doc_id"], r["lang_pred"], r["lang_score"]) for r in out.collect()]
    assert len(got) == len(EDGES)
    assert {i for i, lang, score in got if lang == "und" and score == 0} == {1, 2, 3, 11}
    assert all(lang == "en" for i, lang, _ in got if i not in (1, 2, 3, 11))
    empty = L.identify_languages(nothing, L.fit_language_model(nothing))
    assert empty.count() == 0
    only_und = L.identify_languages(edges, L.fit_language_model(nothing)).select("lang_pred").distinct().collect()
    assert [r[0] for r in only_und] == ["und"]


def test_a_language_without_text_teaches_nothing(spark):
    df = spark.createDataFrame([(None, "xx"), ("123 456", "yy"), ("plain words", None)], "text string, lang string")
    assert L.fit_language_model(df).languages == ["und"]


def test_quality_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op2_quality_classifier"](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    assert (out.predicted == (out.score >= 0.3)).all() and out.score.between(0, 1).all()
    held = out.merge(labels, on="doc_id")
    held = held[held.held_out]
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert (held.predicted == held.quality).mean() > 0.93


def test_quality_of_odd_texts(spark, edges, nothing):
    labels = spark.createDataFrame([(6, 1), (8, 0), (8, 1), (9, None), (None, 1), (10, 1), (5, 0)], "doc_id long, quality int")
    model = Q.fit_quality_model(edges, labels)
    out = Q.score_quality(edges, model).collect()
    assert len(out) == len(EDGES) and all(0 <= r["quality_score"] <= 1 for r in out)
    assert len({r["quality_score"] for r in out if r["doc_id"] in (1, 2, 3)}) == 1
    assert len({r["quality_score"] for r in out if r["doc_id"] in (6, 7)}) == 1
    untaught = Q.fit_quality_model(edges, labels.filter("false"))
    assert {r[0] for r in Q.score_quality(edges, untaught).select("quality_score").collect()} == {0.5}
    assert Q.score_quality(nothing, model).count() == 0


def test_score_is_the_sparse_dot_product():
    texts = pa.array(["a b c a b", "", "UP UP!! done."])
    slots, bounds = Q.feature_slots(*utf8(texts))
    rng = np.random.default_rng(2)
    model = Q.FtrlModel(rng.normal(size=1 << Q.BITS).astype(np.float32), 0.25)
    for i, score in enumerate(model.score(*utf8(texts))):
        part = slots[:, bounds[i] : bounds[i + 1]]
        dot = sum(float(model.weights[s]) for s in part.ravel()) * Q.SCALE / max(1, part.shape[1])
        assert score == pytest.approx(1 / (1 + np.exp(-dot - 0.25)))


def test_features_do_not_reach_over_texts():
    one = Q.feature_slots(*utf8(pa.array(["a b", "c d"])))[0]
    alone = np.concatenate([Q.feature_slots(*utf8(pa.array([t])))[0] for t in ("a b", "c d")], axis=1)
    assert (one == alone).all()

"""Merkle manifest, toxicity and source divergence against plain Python, and a defined result for every odd row."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablescout.llm import divergence as D
from tablescout.llm import merkle as M
from tablescout.llm import toxicity as X
from tablescout.llm.arrow_text import utf8
from tablescout.llm.queries import QUERIES

from .conftest import CLASHING, EDGES, table

SF1 = "/root/testdata/sf0.1"


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text=None):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"] if text is None else text]
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def manifest(rows):
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r["lang"]].append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        held = sorted(by_lang[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[lang] = (held, levels_of([leaf_of(r) for r in held]))
    top = levels_of([trees[lang][1][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        held, levels = trees[lang]
        for i, r in enumerate(held):
            steps = [(level, i // 8**n) for n, level in enumerate(levels[:-1])] + [(level, k // 8**n) for n, level in enumerate(top[:-1])]
            proof = []
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None
            h = leaf_of(r, r["text"].translate({c: c + 32 for c in range(65, 91)})) if tampered else leaf_of(r)
            for level, at in steps:
                start = at // 8 * 8
                proof += [*level[start:at], *level[at + 1 : start + 8]]
                h = sha(*level[start:at], h, *level[at + 1 : start + 8])
            out.append((r["doc_id"], leaf_of(r), levels[-1][0], top[-1][0], sha(*proof), h, h == top[-1][0]))
    return sorted(out, key=str)


def manifest_of(df):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    out = M.merkle_manifest(df, tampered=tampered)
    return sorted((tuple(r) for r in out.withColumn("proof", M.proof_digest(F.col("proof"))).collect()), key=str)


SCHEMA = ", ".join([*(f"`{n}` string" for n in (*CLASHING, "tree", "pos", "mid", "leaf", "kids")), "doc_id long, source string, lang string, n_chars long, text string"])


def records(spark, rows):
    return spark.createDataFrame([(*["!"] * (len(CLASHING) + 5), *r) for r in rows], SCHEMA)


@pytest.mark.parametrize("sizes", [[1], [8], [9], [65], [1, 1], [70, 1, 8, 0, 2], [3] * 10 + [17]])
def test_manifest_of_any_shape(spark, sizes):
    rows = [(100 * k + i, "s", f"l{k}" if k else None, i, f"Text {i}") for k, n in enumerate(sizes) for i in range(n)]
    random.Random(4).shuffle(rows)
    df = records(spark, rows)
    assert manifest_of(df) == manifest([r.asDict() for r in df.collect()])


def test_manifest_of_odd_rows(spark):
    rows = [(i % 5 or None, None, None if i % 7 == 0 else "é" if i % 3 else "e", None if i % 4 else i, [None, "", "ÄB", "same"][i % 4]) for i in range(90)]
    df = records(spark, [*rows, *rows[:20]])
    got = manifest_of(df)
    assert got == manifest([r.asDict() for r in df.collect()])
    assert len(got) == 110
    assert M.merkle_manifest(records(spark, [])).collect() == []


def test_manifest_of_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted((tuple(r) for r in QUERIES["op11_merkle_manifest"](spark, sf).collect()), key=str)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got == manifest([r.asDict() for r in docs])
    assert {r[-1] for r in got} == {True, False}


# Toxicity


def grams(text):
    words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    out = []
    for w in words:
        w = "".join(c.lower() if c.isascii() or (0xC0 <= ord(c) <= 0xDE and c != "×") else c for c in w)
        b = b" " + w.encode() + b" "
        out += [b[i : i + n] for n in X.LENGTHS for i in range(len(b) - n + 1)]
    return out


def slot(gram):
    h = 0
    for b in gram:
        h = (h * 0x01000193 + b + 1) & 0xFFFFFFFF
    h = h * 0x9E3779B1 & 0xFFFFFFFF
    h ^= h >> 15
    return (h * 0x85EBCA6B & 0xFFFFFFFF) >> 32 - X.BITS


TEXTS = ["", None, "a", "An Idiot, they SAID: idiot!", "ÀÉ× ÿß", "1 2 3", "x" * 40, " pad ded ", "日本 語"]


def test_grams_are_those_of_each_word():
    slots, texts = X.gram_slots(*utf8(pa.array(TEXTS)))
    for i, text in enumerate(TEXTS):
        assert Counter(slots[texts == i].tolist()) == Counter(slot(g) for g in grams(text)), text


def test_score_is_the_scaled_linear_form():
    rng = np.random.default_rng(0)
    slots, _ = X.gram_slots(*utf8(pa.array(TEXTS)))
    chosen = np.unique(slots)[::2]
    place = np.full(1 << X.BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    model = X.NaiveBayesLinear(place, rng.normal(size=len(chosen)), -0.7)
    got = model.score(*utf8(pa.array(TEXTS)))
    for text, score in zip(TEXTS, got):
        count = Counter(slot(g) for g in grams(text))
        z = model.bias + sum(X.SCALE * np.sqrt(n / count.total()) * model.weights[place[s]] for s, n in count.items() if place[s] >= 0)
        assert score == pytest.approx(1 / (1 + np.exp(-z)))


def test_ratios_are_logarithms_of_shares():
    toxic, other = np.zeros(1 << X.BITS, np.int64), np.zeros(1 << X.BITS, np.int64)
    toxic[[3, 4]], other[[4, 5]] = [3 * X.UNIT, X.UNIT], [X.UNIT, 7 * X.UNIT]
    slots, ratios = X.log_count_ratios(toxic, other, 2)
    assert slots.tolist() == [3, 5] and ratios[0] > 0 > ratios[1]
    smooth = X.UNIT / 2000
    p = (toxic[3] + smooth) / (4 * X.UNIT + smooth * len(toxic))
    q = smooth / (8 * X.UNIT + smooth * len(toxic))
    assert ratios[0] == pytest.approx(np.log(p / q))


def test_toxicity_query_on_held_out_labels(spark):
    out = QUERIES["op12_toxicity"](spark, SF1).toPandas()
    labels = spark.read.parquet(f"{SF1}/labels.parquet").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    assert (out.predicted == (out.score >= 0.5)).all() and out.score.between(0, 1).all()
    held = out.merge(labels, on="doc_id")
    held = held[held.held_out]
    hits = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert hits / (held.predicted == 1).sum() > 0.95 and hits / held.toxic.sum() > 0.88


def test_toxicity_of_odd_texts(spark, edges, nothing):
    labels = spark.createDataFrame([(4, 1), (13, 1), (8, 0), (9, 0), (8, 1), (None, 1), (5, None), (5, 0)], "doc_id long, toxic int")
    model = X.fit_toxicity_model(edges, labels)
    out = X.score_toxicity(edges.withColumn("toxicity_score", F.lit("mine")), model)
    got = [(r["doc_id"], r["toxicity_score"], r["toxicity_label"], r["text"]) for r in out.collect()]
    assert len(got) == len(EDGES)
    assert all(0 <= s <= 1 and t == (s >= 0.5) for _, s, t, _ in got)
    assert len({s for i, s, _, _ in got if i in (1, 2, 3)}) == 1
    assert len({s for _, s, _, text in got if text == "one"}) == 1
    for unlabelled in (labels.limit(0), labels.filter("toxic = 0")):
        plain = X.score_toxicity(edges, X.fit_toxicity_model(edges, unlabelled)).select("toxicity_score").distinct().collect()
        assert len(plain) == 1 and plain[0][0] < 0.5
    assert X.score_toxicity(nothing, X.fit_toxicity_model(nothing, labels)).count() == 0


# Source divergence


def audit(rows, least, top):
    groups, docs, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups[lang, source].update(terms)
        total[lang].update(terms)
        docs[lang].update(set(terms))
    out = []
    for (lang, source), mine in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = shares(mine), shares(total[lang])
        pairs = []
        for (other_lang, other), theirs in groups.items():
            if other_lang == lang and other != source:
                r = shares(theirs)
                pairs.append((-sum(abs(p[t] - r[t]) for t in kept), other.encode()))
        terms = [(q[t] - p[t], t.encode()) for t in kept if mine[t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(sorted(found))]
    return sorted(out)


def divergence_of(spark, rows, least=2, top=5):
    schema = ", ".join([*(f"`{n}` string" for n in (*CLASHING, "term", "tile", "block", "docs")), "lang string, source string, text string"])
    df = spark.createDataFrame([(*["!"] * (len(CLASHING) + 4), *r) for r in rows], schema)
    return sorted(tuple(r) for r in D.source_divergence(df, least, top).collect())


def term_rows(seed, n, sources=4):
    r = random.Random(seed)
    words = [w * k for w in ("a", "Bc", "é", "日本", "zz") for k in (1, 2, 4, 5, 7, 9, 16, 17, 33)] + ["eightabc", "sixteensixteenab", "seventeenseventeen"]
    return [(r.choice(["x", "y", None]), f"s{r.randrange(sources)}", " ".join(r.choices(words, k=r.randrange(12)))) for _ in range(n)]


def test_divergence_against_plain_counts(spark):
    rows = [*term_rows(1, 80), ("x", None, None), ("z", "lonely", "word"), ("z", "silent", ""), (None, None, "42 \t _"), ("x", "s0", "a" * 5000 + " " + "a" * 5000)]
    rows += rows[:10]
    assert divergence_of(spark, rows) == audit(rows, 2, 5)


@pytest.mark.parametrize("terms,sources", [(3, 2), (1, 1), (7, 100)])
def test_divergence_in_blocks_and_tiles(spark, monkeypatch, terms, sources):
    monkeypatch.setattr(D, "BLOCK_TERMS", terms)
    monkeypatch.setattr(D, "BLOCK_SOURCES", sources)
    rows = term_rows(2, 120, sources=7)
    assert divergence_of(spark, rows, 3, 50) == audit(rows, 3, 50)


def test_divergence_without_terms_or_rows(spark):
    rows = [("x", "b", "1"), ("x", "a", None), ("x", "c", "rare")]
    got = divergence_of(spark, rows)
    assert got == audit(rows, 2, 5) and {r[4] for r in got} == {0} and len(got) == 6
    assert divergence_of(spark, []) == []
    assert divergence_of(spark, [("x", "only", "one one")], 1) == audit([("x", "only", "one one")], 1, 5)


def test_counter_gives_back_all_it_held():
    counter, rows = D.TermCounter(), term_rows(3, 60)
    for i in range(0, 60, 7):
        part = rows[i : i + 7]
        counter.add(pa.array([t for _, _, t in part], pa.string()), [(a or "", b) for a, b, _ in part])
        if i % 2:
            counter.merge()
    got, expected, docs = Counter(), Counter(), Counter()
    for b in counter.flush(step=10):
        for r in b.to_pylist():
            got[r["lang"], r["source"], r["term"]] += r["n"]
            docs[r["lang"], r["source"], r["term"]] += r["docs"]
    seen = Counter()
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
        expected.update((lang or "", source, t) for t in terms)
        seen.update((lang or "", source, t) for t in set(terms))
    assert got == expected and docs == seen and counter.rows == 0


def test_radix_order_is_a_stable_sort():
    rng = np.random.default_rng(2)
    keys = [rng.integers(0, top, 500).astype(np.uint64) for top in (3, 1 << 40)]
    assert (D.radix_order(*keys) == np.lexsort(keys)).all()

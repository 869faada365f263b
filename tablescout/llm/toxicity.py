"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The n-grams (3 to 6 bytes) lie within a word or take the boundary at its start or end; letters are lower-cased,
everything that is no letter is a boundary. They are hashed into one table. A feature's naive Bayes ratio is the logarithm
of its share in toxic texts over its share in the others; the linear model learns weights for features of the
value `sqrt(share in the text) * ratio`, so a text's length does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.llm.arrow_text import append_columns, bound_batches, map_texts, slices, utf8

BITS = 18
LENGTHS = range(3, 7)
SCALE = 3.0
# Shares are counted in units of 2^-28, so that sums do not depend on their order.
UNIT = 1 << 28

_BOUNDARY = 32
_LETTER = np.full(256, _BOUNDARY, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts with single boundaries between words and texts, and the texts' new offsets."""
    n = len(offsets) - 1
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    out = np.full(len(data) + n + 1, _BOUNDARY, np.uint8)
    out[at] = _LETTER[data]
    # Capitals of two bytes in the Latin-1 range: C3 80 to C3 9E, but for the multiplication sign.
    second = out[1:]
    second[(out[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] += 0x20
    boundary = out == _BOUNDARY
    keep = np.ones(len(out), bool)
    keep[1:] = ~(boundary[1:] & boundary[:-1])
    places = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=places[1:])
    return out[keep], places[offsets + np.arange(n + 1)]


def gram_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, text) of every n-gram of the texts. None reaches over a boundary."""
    x, bounds = _letters(data, offsets)
    # A text starts with the boundary before its first word, which may be the one at the end of the text before.
    text = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    text = np.append(text, np.full(len(x) - len(text), max(len(bounds) - 2, 0), np.int32))
    boundary = x == _BOUNDARY
    byte = x.astype(np.uint32) + np.uint32(1)
    running, whole = byte, np.ones(len(x), bool)
    slots, texts = [], []
    for size in range(2, LENGTHS.stop):
        m = len(x) - size + 1
        if m <= 0:
            break
        running = running[:m] * np.uint32(0x01000193) + byte[size - 1 :]
        whole = whole[:m] & ~boundary[size - 2 : size - 2 + m] if size > 2 else whole[:m]
        if size in LENGTHS:
            h = running[whole] * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            slots.append((h >> np.uint32(32 - BITS)).astype(np.int32))
            # The second byte of an n-gram is always of its own text.
            texts.append(text[1 : m + 1][whole])
    if not slots:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(slots), np.concatenate(texts)


def _chosen_counts(slots: np.ndarray, texts: np.ndarray, n: int, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, feature, count) of the chosen features, and the number of all n-grams of each text."""
    totals = np.bincount(texts, minlength=n)
    feature = place[slots]
    kept = feature >= 0
    width = int(place.max(initial=0)) + 1
    keys = np.sort(texts[kept].astype(np.int64) * width + feature[kept])
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    return keys[first] // width, keys[first] % width, counts, totals


@dataclass
class NaiveBayesLinear:
    """`place` maps slots to chosen features (or -1); `weights` already hold the features' ratios."""

    place: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text; a text without n-grams has that of the intercept."""
        n = len(offsets) - 1
        if not n:
            return np.zeros(0)
        text, feature, count, totals = _chosen_counts(*gram_slots(data, offsets), n, self.place)
        value = np.sqrt(count / np.maximum(totals, 1)[text]) * SCALE
        z = np.bincount(text, weights=value * self.weights[feature], minlength=n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def log_count_ratios(toxic: np.ndarray, other: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the `features` most telling ones, in rising order, and their ratios, from the sums of shares by slot.

    Every slot gets a small share in both classes beforehand. How telling a slot is: its ratio's size times its share.
    """
    smooth = UNIT / 2000
    p, q = ((x + smooth) / (x.sum() + smooth * len(x)) for x in (toxic.astype(np.float64), other.astype(np.float64)))
    ratio = np.log(p) - np.log(q)
    telling = np.abs(ratio) * (p + q)
    telling[(toxic == 0) & (other == 0)] = 0
    best = np.argsort(-telling, kind="stable")[:features]
    best = np.sort(best[telling[best] > 0])
    return best, ratio[best]


def train_linear(
    rows: np.ndarray, features: np.ndarray, values: np.ndarray, labels: np.ndarray, width: int,
    l2: float = 1e-4, steps: int = 120, rate: float = 0.05,
) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over all examples, given as (row, feature, value) entries."""
    n, mean = len(labels), float((labels.sum() + 0.5) / (len(labels) + 2))
    w, bias = np.zeros(width), float(np.log(mean / (1 - mean)))
    if not n or labels.min() == labels.max():
        return w, bias
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = np.bincount(rows, weights=values * w[features], minlength=n) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels) / n
        g = np.append(np.bincount(features, weights=values * error[rows], minlength=width) + l2 * w, error.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
        w -= move[:-1]
        bias -= move[-1]
    return w, bias


def _class_shares(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sums of shares by slot, of toxic texts and of the others: one dense table a task, added up by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                label = part.column("label").to_numpy() > 0
                slots, texts = gram_slots(*utf8(part.column("text")))
                share = UNIT // np.maximum(np.bincount(texts, minlength=len(label)), 1)
                for k in (0, 1):
                    mine = label[texts] == k
                    sums[k] += np.bincount(slots[mine], weights=share[texts[mine]], minlength=1 << BITS).astype(np.int64)
        used = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[1][used]), pa.array(sums[0][used])], names=["slot", "toxic", "other"])

    found = sample.mapInArrow(run, "slot long, toxic long, other long").groupBy("slot").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).toArrow()
    out = np.zeros((2, 1 << BITS), np.int64)
    slot = found.column("slot").to_numpy()
    out[1][slot], out[0][slot] = found.column("toxic").to_numpy(), found.column("other").to_numpy()
    return out[1], out[0]


def fit_toxicity_model(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
    count_rows: int = 30_000, max_rows: int = 6_000, features: int = 1 << 13,
) -> NaiveBayesLinear:
    """Learn from a bounded number of labelled texts, chosen by a hash of their ids, whatever the size of the tables.

    The log-count ratios are taken from about `count_rows` texts, the linear weights from about `max_rows` of these. Null
    ids, labels and texts teach nothing; of several labels of one id the largest counts. Without texts of both
    labels, every text gets the smoothed share of label 1 (0.25 without any).
    """
    labelled = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).dropna()
    total = labelled.count()
    h = F.xxhash64("id")
    chosen = (
        labelled.filter(F.pmod(h, F.lit(1 << 20)) < (1 << 20) * min(1.0, count_rows / max(total, 1)))
        .groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(2 * count_rows)
    )
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter("text is not null")
    # `chosen` has at most 2 * count_rows rows of two numbers.
    sample = texts.join(F.broadcast(chosen), "id").select(h.alias("h"), "label", "text")
    bound_batches(docs.sparkSession)
    chosen_slots, ratios = log_count_ratios(*_class_shares(sample), features)
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen_slots] = np.arange(len(chosen_slots))

    def entries(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = part.num_rows
        text, feature, count, totals = _chosen_counts(*gram_slots(*utf8(part.column("text"))), n, place)
        value = (np.sqrt(count / np.maximum(totals, 1)[text]) * SCALE).astype(np.float32)
        at = np.searchsorted(text, np.arange(n + 1))
        packed = [[x[a:b].tobytes() for a, b in zip(at[:-1], at[1:])] for x in (feature.astype(np.int32), value)]
        yield pa.RecordBatch.from_arrays(
            [part.column("h"), part.column("label"), *(pa.array(x, pa.binary()) for x in packed)], names=["h", "label", "features", "values"])

    share = max_rows / max(min(total, count_rows), 1)
    learned = map_texts(
        sample.filter(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < (1 << 20) * min(1.0, share)), "text", entries,
        T.StructType.fromDDL("h long, label int, features binary, values binary"),
    ).orderBy("h", "features", "values").limit(2 * max_rows).toArrow()
    y = (learned.column("label").to_numpy() > 0).astype(np.float64) if learned.num_rows else np.zeros(0)
    feature = [np.frombuffer(x, np.int32) for x in learned.column("features").to_pylist()]
    value = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(x, np.float32) for x in learned.column("values").to_pylist())])
    row = np.repeat(np.arange(len(y), dtype=np.int32), [len(x) for x in feature])
    feature = np.concatenate([np.zeros(0, np.int32), *feature])
    weights, bias = train_linear(row, feature, value * ratios[feature].astype(np.float32), y, max(len(ratios), 1))
    return NaiveBayesLinear(place, weights * ratios if len(ratios) else weights, bias)


def score_toxicity(docs: DataFrame, model: NaiveBayesLinear, text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """`docs` with `toxicity_score` (0 to 1) and `toxicity_label` (1 from `threshold` up) of each whole text.

    A null text counts as empty; texts without letters get the intercept's probability. Equal texts score alike,
    rows are neither dropped nor merged. Columns of those two names are replaced.
    """
    fields = T.StructType([T.StructField("toxicity_score", T.DoubleType()), T.StructField("toxicity_label", T.IntegerType())])

    def compute(texts: pa.Array) -> list[pa.Array]:
        score = model.score(*utf8(texts))
        return [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())]

    return append_columns(docs, text_column, compute, fields)

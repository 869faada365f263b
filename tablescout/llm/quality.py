"""Quality scores: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Features are the words and word pairs of a text and the n-grams (1 to 3) of its words' shapes, hashed into one table. The
shape of a word is its case, its first and last byte classes, its length class and whether it repeats the
word before. The value of a feature is its share among the text's n-grams of its kind, so length does not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.llm.arrow_text import append_columns, map_texts, utf8
from tablescout.llm.words import Words, mix, words

BITS = 18
KINDS = 5
SCALE = 8.0

# Byte classes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 ASCII punctuation, 5 part of a non-ASCII character.
_CLASS = np.zeros(256, np.int64)
_CLASS[33:127] = 4
_CLASS[48:58] = 3
_CLASS[65:91] = 2
_CLASS[97:123] = 1
_CLASS[128:] = 5


_SALTS = mix(np.arange(1, KINDS + 1, dtype=np.uint64))


def _shapes(w: Words) -> np.ndarray:
    """A small number for each word's shape."""
    length = w.ends - w.starts
    first, last = _CLASS[w.data[w.starts]], _CLASS[w.data[w.ends - 1]]
    middle = _CLASS[w.data[(w.starts + w.ends) // 2]]
    # The last byte itself, where it is punctuation, tells full stops from noise.
    mark = np.where(last == 4, w.data[w.ends - 1].astype(np.int64), 0)
    same = np.zeros(len(length), np.int64)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    same[w.bounds[:-1][w.bounds[:-1] < len(same)]] = 0
    size = np.minimum(length // 4, 5)
    return ((((first * 6 + middle) * 6 + last) * 128 + mark) * 6 + size) * 2 + same


def feature_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots [KINDS, words] of the n-grams that start at each word, and the texts' word bounds.

    An n-gram stops at the end of its text.
    """
    w = words(data, offsets)
    shape = _shapes(w) if len(w.hashes) else np.zeros(0, np.int64)
    n = len(w.hashes)
    ends = np.repeat(w.bounds[1:], w.counts)

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        if by < n:
            out[: n - by] = x[by:]
        out[np.arange(n) + by >= ends] = 0
        return out

    s = shape.astype(np.uint64) + np.uint64(1)
    keys = [
        w.hashes,
        w.hashes * np.uint64(3) + shifted(w.hashes, 1),
        s,
        s * np.uint64(0x9E3779B1) + shifted(s, 1),
        (s * np.uint64(0x9E3779B1) + shifted(s, 1)) * np.uint64(0x85EBCA6B) + shifted(s, 2),
    ]
    return np.stack([(mix(k ^ salt) >> np.uint64(64 - BITS)).astype(np.int64) for k, salt in zip(keys, _SALTS)]), w.bounds


@dataclass
class FtrlModel:
    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text; a text without words has that of the intercept."""
        slots, bounds = feature_slots(data, offsets)
        total = np.zeros(slots.shape[1] + 1)
        per_word = self.weights[slots[0]].astype(np.float64)
        for kind in range(1, KINDS):
            per_word += self.weights[slots[kind]]
        np.cumsum(per_word, out=total[1:])
        counts = np.diff(bounds)
        dot = (total[bounds[1:]] - total[bounds[:-1]]) * SCALE / np.maximum(counts, 1)
        return 1 / (1 + np.exp(-np.clip(dot + self.bias, -35, 35)))


def train_ftrl(
    examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray,
    alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, epochs: int = 4, seed: int = 11,
) -> FtrlModel:
    """FTRL-proximal over (slots, values) examples, one update an example."""
    z = np.zeros(1 << BITS)
    n = np.zeros(1 << BITS)
    rate = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    z0, n0, bias = 0.0, 0.0, float(np.log(rate / (1 - rate)))
    start = bias
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            slot, value = examples[i]
            zi, ni = z[slot], n[slot]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w @ value + bias, -35, 35)))
            error = p - labels[i]
            g = error * value
            grown = ni + g * g
            z[slot] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[slot] = grown
            grown0 = n0 + error * error
            z0 += error - (np.sqrt(grown0) - np.sqrt(n0)) / alpha * (bias - start)
            n0 = grown0
            bias = start - z0 / ((beta + np.sqrt(n0)) / alpha)
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return FtrlModel(w.astype(np.float32), bias)


def _features_of_rows(part: pa.RecordBatch):
    """Each text's distinct slots and values, as bytes."""
    slots, bounds = feature_slots(*utf8(part.column("text")))
    packed_slots, packed_values = [], []
    for a, b in zip(bounds[:-1], bounds[1:]):
        slot, count = np.unique(slots[:, a:b], return_counts=True)
        packed_slots.append(slot.astype(np.int32).tobytes())
        packed_values.append((count * (SCALE / max(1, b - a))).astype(np.float32).tobytes())
    yield pa.RecordBatch.from_arrays(
        [part.column("h"), part.column("label"), pa.array(packed_slots, pa.binary()), pa.array(packed_values, pa.binary())],
        names=["h", "label", "slots", "values"])


def fit_quality_model(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                      label_column: str = "quality", max_rows: int = 6000) -> FtrlModel:
    """Train on about `max_rows` labelled texts at most, chosen by a hash of their ids, whatever the size of the tables.

    Null ids, labels and texts teach nothing; of several labels of one id the largest counts. Without labelled
    rows every text scores 0.5.
    """
    labelled = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).dropna()
    total = labelled.count()
    h = F.xxhash64("id")
    chosen = (
        labelled.filter(F.pmod(h, F.lit(1 << 20)) < (1 << 20) * min(1.0, max_rows / max(total, 1)))
        .groupBy("id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(2 * max_rows)
    )
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter("text is not null")
    # `chosen` has at most 2 * max_rows rows of two numbers.
    sample = texts.join(F.broadcast(chosen), "id").select(h.alias("h"), "label", "text")
    schema = T.StructType([
        T.StructField("h", T.LongType()), T.StructField("label", T.IntegerType()),
        T.StructField("slots", T.BinaryType()), T.StructField("values", T.BinaryType()),
    ])
    rows = map_texts(sample, "text", _features_of_rows, schema).orderBy("h", "slots").limit(2 * max_rows).collect()
    examples = [(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["values"], np.float32).astype(np.float64)) for r in rows]
    return train_ftrl(examples, np.array([float(r["label"] > 0) for r in rows]))


def score_quality(docs: DataFrame, model: FtrlModel, text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """`docs` with `quality_score` (0 to 1) and `quality_label` (1 from `threshold` up) of each whole text.

    A null text counts as empty; texts without words get the intercept's probability. Equal texts score alike,
    rows are neither dropped nor merged. Columns of those two names are replaced.
    """
    fields = T.StructType([T.StructField("quality_score", T.DoubleType()), T.StructField("quality_label", T.IntegerType())])

    def compute(texts: pa.Array) -> list[pa.Array]:
        score = model.score(*utf8(texts))
        return [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())]

    return append_columns(docs, text_column, compute, fields)

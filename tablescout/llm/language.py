"""Language identification by a byte-level convolutional network.

Byte embeddings, filters of several widths, the maximum of each filter over a window, a softmax layer. The
network is trained in numpy on a bounded sample of labelled texts. Texts of any length are read as fixed-length
windows; the logits of all windows of a text are averaged, weighted by their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.llm.arrow_text import append_columns, utf8

UNDETERMINED = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
# Windows that go through the network at once: the intermediate arrays then fit a core's cache.
WINDOWS_AT_ONCE = 48


@dataclass
class ByteConvNet:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    filter_bias: np.ndarray
    output: np.ndarray
    output_bias: np.ndarray
    _tables: list | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}

    def tables(self) -> list[list[np.ndarray]]:
        """Each filter bank as sums of look-ups: a table by byte pairs for every two positions, by bytes for an odd one."""
        if self._tables is None:
            made = []
            for width, weights in zip(WIDTHS, self.filters):
                by_byte = [self.embedding @ weights[j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(width)]
                parts = []
                for j in range(0, width - 1, 2):
                    parts.append((by_byte[j][:, None, :] + by_byte[j + 1][None, :, :]).reshape(65536, FILTERS))
                if width % 2:
                    parts.append(by_byte[-1])
                made.append(parts)
            self._tables = made
        return self._tables

    def window_logits(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(windows), WINDOWS_AT_ONCE):
            x = windows[at : at + WINDOWS_AT_ONCE].astype(np.int64)
            pairs = x[:, :-1] * 256 + x[:, 1:]
            pooled = []
            for width, parts in zip(WIDTHS, self.tables()):
                n = WINDOW - width + 1
                total = None
                for k, table in enumerate(parts):
                    at_position = 2 * k
                    source = pairs if len(table) == 65536 else x
                    looked_up = np.take(table, source[:, at_position : at_position + n], axis=0)
                    total = looked_up if total is None else np.add(total, looked_up, out=total)
                pooled.append(total.max(axis=1))
            hidden = np.maximum(np.concatenate(pooled, axis=1) + self.filter_bias, 0)
            out.append(hidden @ self.output + self.output_bias)
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language (its index) and its probability for each text."""
        sizes = np.diff(offsets)
        per_text = -(-sizes // WINDOW)
        n = int(per_text.sum())
        text = np.repeat(np.arange(len(sizes)), per_text)
        first = np.cumsum(per_text) - per_text
        starts = offsets[text] + (np.arange(n) - first[text]) * WINDOW
        lengths = np.minimum(WINDOW, offsets[text + 1] - starts)
        logits = np.zeros((len(sizes), len(self.languages)))
        padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
        step = WINDOWS_AT_ONCE * 64
        for at in range(0, n, step):
            part = slice(at, at + step)
            windows = padded[starts[part, None] + np.arange(WINDOW)]
            windows[np.arange(WINDOW) >= lengths[part, None]] = 0
            np.add.at(logits, text[part], self.window_logits(windows) * lengths[part, None])
        logits /= np.maximum(sizes, 1)[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


def as_windows(texts: list[str]) -> np.ndarray:
    """The first window of each text, padded with zero bytes."""
    out = np.zeros((len(texts), WINDOW), np.uint8)
    for i, text in enumerate(texts):
        raw = text.encode()[:WINDOW]
        out[i, : len(raw)] = np.frombuffer(raw, np.uint8)
    return out


def train(windows: np.ndarray, labels: list[str], epochs: int = 14, seed: int = 7) -> ByteConvNet:
    """Fit the network by Adam on cross-entropy. Rows of each language weigh the same in total."""
    languages = sorted(set(labels))
    index = {name: i for i, name in enumerate(languages)}
    y = np.array([index[name] for name in labels], np.int64)
    rng = np.random.default_rng(seed)
    n_hidden = FILTERS * len(WIDTHS)
    params = {
        "e": rng.normal(0, 0.3, (256, EMBEDDING)),
        **{f"w{w}": rng.normal(0, 1.2 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS)) for w in WIDTHS},
        "fb": np.zeros(n_hidden),
        "o": rng.normal(0, 1 / np.sqrt(n_hidden), (n_hidden, len(languages))),
        "ob": np.zeros(len(languages)),
    }
    params = {k: v.astype(np.float32) for k, v in params.items()}
    m = {k: np.zeros_like(v) for k, v in params.items()}
    v = {k: np.zeros_like(x) for k, x in params.items()}
    weight = len(y) / (len(languages) * np.bincount(y, minlength=len(languages)))
    step = 0
    for _ in range(epochs if len(languages) > 1 else 0):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            grads = _gradients(params, windows[rows].astype(np.int64), y[rows], weight[y[rows]])
            step += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                params[k] -= 0.004 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return ByteConvNet(languages, params["e"], [params[f"w{w}"] for w in WIDTHS], params["fb"], params["o"], params["ob"])


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    rows = np.arange(len(x))[:, None]
    embedded = p["e"][x]
    columns, best, pooled = [], [], []
    for w in WIDTHS:
        n = WINDOW - w + 1
        c = np.concatenate([embedded[:, j : j + n] for j in range(w)], axis=2)
        response = c @ p[f"w{w}"]
        at = response.argmax(axis=1)
        columns.append(c)
        best.append(at)
        pooled.append(response[rows, at, np.arange(FILTERS)])
    before = np.concatenate(pooled, axis=1) + p["fb"]
    hidden = np.maximum(before, 0)
    logits = hidden @ p["o"] + p["ob"]
    logits -= logits.max(axis=1, keepdims=True)
    q = np.exp(logits)
    q /= q.sum(axis=1, keepdims=True)
    q[np.arange(len(y)), y] -= 1
    q *= (weight / len(y))[:, None]
    q = q.astype(np.float32)
    grads = {"o": hidden.T @ q, "ob": q.sum(axis=0)}
    back = (q @ p["o"].T) * (before > 0)
    grads["fb"] = back.sum(axis=0)
    embedding = np.zeros_like(p["e"])
    for k, w in enumerate(WIDTHS):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        grads[f"w{w}"] = np.einsum("bfc,bf->cf", columns[k][rows, best[k]], g)
        to_columns = g[:, :, None] * p[f"w{w}"].T[None]
        for j in range(w):
            np.add.at(embedding, x[rows, best[k] + j], to_columns[:, :, j * EMBEDDING : (j + 1) * EMBEDDING])
    grads["e"] = embedding
    return grads


def fit_language_model(
    labelled: DataFrame, text_column: str = "text", lang_column: str = "lang",
    per_language: int = 1500, max_languages: int = 100, windows_per_text: int = 2,
) -> ByteConvNet:
    """Train on at most about `per_language` texts for each of the `max_languages` most frequent languages.

    Those bounds hold whatever the size of the table: a text is in the sample if a hash of it is below a threshold
    that its language's row count sets. Each gives `windows_per_text` windows at hashed places.
    Rows without text, language or any letter teach nothing. Without any labelled row the model knows only `und`.
    """
    rows = labelled.select(F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang")).filter(
        "text is not null and lang is not null")
    counts = {
        r["lang"]: r["n"]
        for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    }
    if not counts:
        return train(np.zeros((0, WINDOW), np.uint8), [UNDETERMINED])
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    order = F.xxhash64("text")
    place = [
        F.expr(f"substr(text, cast(1 + pmod(xxhash64(text, {k}), greatest(char_length(text) - {WINDOW}, 1)) as int), {WINDOW})")
        for k in range(windows_per_text)
    ]
    # Equal texts (copies) hash alike, so they are in or out together.
    sample = (
        rows.filter(F.pmod(order, F.lit(1 << 20)) < share * (1 << 20))
        .select("lang", order.alias("h"), F.explode(F.array(*place)).alias("w"))
        .filter(F.col("w").rlike(r"\p{L}"))
        .orderBy("h", "lang", "w")
        .limit(2 * per_language * windows_per_text * len(counts))
        .collect()
    )
    if not sample:
        return train(np.zeros((0, WINDOW), np.uint8), [UNDETERMINED])
    return train(as_windows([r["w"] for r in sample]), [r["lang"] for r in sample])


def identify_languages(docs: DataFrame, model: ByteConvNet, text_column: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `lang_score` (0 to 1) of each whole text.

    Null texts and texts without a letter are `und` with score 0. Equal texts get equal results; rows are neither
    dropped nor merged. Columns of those two names are replaced.
    """
    fields = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    def compute(texts: pa.Array) -> list[pa.Array]:
        best, score = model.predict(*utf8(texts))
        has_letter = np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
        names = np.array(model.languages, object)[best]
        return [
            pa.array(np.where(has_letter, names, UNDETERMINED), pa.string()),
            pa.array(np.where(has_letter, score, 0.0), pa.float64()),
        ]

    return append_columns(docs, text_column, compute, fields)


def remainder(id_column: str, divisor: int) -> Column:
    """crc32 of an id as text, modulo `divisor`; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % divisor

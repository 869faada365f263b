"""Encoding and decoding with a SentencePiece vocabulary, by a shared-prefix Viterbi over distinct marked words.

A text is marked (a space becomes U+2581, one is put in front) and cut into words that start with marks; no piece reaches over such
a cut, so a word's ids do not depend on its neighbours. The distinct words of a slice are sorted, which is the depth-first order of
their trie. The forward state of a prefix is the last piece of its best segmentation; states of the prefix that a word shares
with the one before it are kept, only the rest is computed.

The vocabulary's merges are ordered by score (byte-pair encoding). Its best segmentation of a prefix ends in the one piece that is stable
next to the last piece of what is before it: merging the two pieces' characters by score gives the two pieces again. So the
forward step tests that instead of adding up scores, and the ids are those of the library's encoder, not those of a unigram model.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablescout.llm.arrow_text import append_columns

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# Distinct words whose ids a task keeps from slice to slice. Beyond it those of the last slice stay; results do not depend on it.
KEPT_WORDS = 300_000

_WORD = re.compile(f"{MARK}+[^{MARK}]*")


class PieceVocabulary:
    """Pieces, scores and byte pieces of a model file; small and fixed, so it travels with the tasks."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], special: set[int]):
        self.pieces, self.byte_ids, self.special = pieces, byte_ids, special
        of_bytes = set(byte_ids.values())
        self.rank = {p: (s, i) for i, (p, s) in enumerate(zip(pieces, scores)) if i not in of_bytes and i not in special}
        self.id_of = {p: i for p, (_, i) in self.rank.items()}
        # The pieces as a trie of their reversed characters; None marks where one starts.
        self.ends: dict = {}
        for piece in self.rank:
            node = self.ends
            for char in reversed(piece):
                node = node.setdefault(char, {})
            node[None] = None
        by_id = {i: bytes([b]) for b, i in byte_ids.items()}
        self.bytes_of = [by_id.get(i, b"" if i in special else p.encode()) for i, p in enumerate(pieces)]
        self._stable: dict[tuple[str, str], bool] = {}
        # As the bytes of 32-bit numbers, which are joined as they are.
        self._ids: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_stable": {}, "_ids": {}}

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> PieceVocabulary:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = range(model.get_piece_size())
        pieces = [model.id_to_piece(i) for i in n]
        return cls(
            pieces, [model.get_score(i) for i in n], {int(pieces[i][3:5], 16): i for i in n if model.is_byte(i)},
            {i for i in n if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)})

    def merged(self, word: str) -> list[str]:
        """Merge the characters of a short string: the best-scored neighbours first, the leftmost of equals."""
        parts = list(word)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.rank.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[0] > best):
                    best, at = found[0], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _is_stable(self, pair: tuple[str, str]) -> bool:
        left, right = pair
        if len(self._stable) > 4 * KEPT_WORDS:
            self._stable.clear()
        known = self._stable[pair] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def segment(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """Pieces of each distinct word, in sorted order."""
        before, last, ends, stable = "", [""], self.ends, self._stable
        for word in sorted(words):
            shared = 0
            limit = min(len(before), len(word))
            while shared < limit and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                # Where the pieces that end here start; a character that is no piece stands for itself.
                starts = [end - 1]
                node, at = ends, end
                while at:
                    node = node.get(word[at - 1])
                    if node is None:
                        break
                    at -= 1
                    if None in node:
                        starts.append(at)
                while True:
                    at = starts.pop()
                    pair = (last[at], word[at:end])
                    known = stable.get(pair)
                    if known or known is None and self._is_stable(pair):
                        last.append(pair[1])
                        break
            pieces, end = [], len(word)
            while end:
                pieces.append(last[end])
                end -= len(last[end])
            pieces.reverse()
            yield word, pieces
            before = word

    def _ids_of(self, pieces: list[str]) -> bytes:
        try:
            return array("i", [self.id_of[p] for p in pieces]).tobytes()
        except KeyError:
            return array("i", chain.from_iterable(
                (self.id_of[p],) if p in self.id_of else [self.byte_ids[b] for b in p.encode()] for p in pieces)).tobytes()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and n + 1 offsets."""
        words: list[str] = []
        counts = []
        for text in texts:
            found = _WORD.findall(MARK + text.replace(" ", MARK)) if text else []
            counts.append(len(found))
            words += found
        here = set(words)
        new = here - self._ids.keys()
        if len(self._ids) + len(new) > KEPT_WORDS:
            self._ids = {w: self._ids[w] for w in here - new}
        for word, pieces in self.segment(new):
            self._ids[word] = self._ids_of(pieces)
        of_words = [self._ids[w] for w in words]
        ids = np.frombuffer(b"".join(of_words), np.int32)
        ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, of_words), np.int64, len(of_words)) // ids.itemsize)))
        return ids, ends[np.concatenate(([0], np.cumsum(counts)))].astype(np.int64)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes that are no UTF-8 become U+FFFD, the mark in front goes, special pieces are empty."""
        text = b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_IDS = T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])


def _shared(df: DataFrame, vocabulary: PieceVocabulary) -> Broadcast:
    """A vocabulary that a Python worker unpacks once, so that it keeps what it has computed from task to task."""
    return df.sparkSession.sparkContext.broadcast(vocabulary)


def encode(docs: DataFrame, vocabulary: PieceVocabulary, text_column: str = "text") -> DataFrame:
    """`docs` with `token_ids` and `n_tokens` of each whole text.

    Null and empty texts have no tokens. Equal texts get equal ids; rows are neither dropped nor merged. Columns of those names are replaced.
    """
    shared = _shared(docs, vocabulary)

    def compute(texts: pa.Array) -> list[pa.Array]:
        ids, offsets = shared.value.encode([t or "" for t in texts.to_pylist()])
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
        return [lists, pa.array(np.diff(offsets))]

    return append_columns(docs, text_column, compute, _IDS)


def decode(df: DataFrame, vocabulary: PieceVocabulary, ids_column: str = "token_ids", out: str = "decoded") -> DataFrame:
    """`df` with the text of its ids. A null list or one without ids gives an empty text.

    U+2581 in an encoded text comes back as a space, the one loss of the vocabulary's marking.
    """
    # Slices are cut by the size of a column of bytes; ids are four bytes each.
    schema = T.StructType([*df.drop(out).schema.fields, T.StructField(out, T.StringType())])
    kept = df.drop(out)
    shared = _shared(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [shared.value.decode(x) if x else "" for x in part.column(ids_column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return kept.mapInArrow(run, schema)


def encode_and_check(docs: DataFrame, vocabulary: PieceVocabulary, text_column: str = "text") -> DataFrame:
    """`encode`, with `decoded_sha256` of the text decoded from the ids and `round_trip`: whether it is the text again.

    Both are made where the ids are, so that decoded texts do not leave the task.
    """
    fields = T.StructType([*_IDS.fields, T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())])

    shared = _shared(docs, vocabulary)

    def compute(texts: pa.Array) -> list[pa.Array]:
        vocabulary = shared.value
        given = [t or "" for t in texts.to_pylist()]
        ids, offsets = vocabulary.encode(given)
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
        decoded = [vocabulary.decode(ids[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])]
        return [
            lists, pa.array(np.diff(offsets)), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
            pa.array([a == b for a, b in zip(given, decoded)], pa.bool_()),
        ]

    return append_columns(docs, text_column, compute, fields)

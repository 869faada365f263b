"""The pipeline over documents: each stage is one operator, and works on what the stage before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm.jaccard import jaccard_components, keep_one_each
from tablescout.llm.language import fit_language_model, identify_languages, remainder
from tablescout.llm.leaks import drop_leaked, find_leaks
from tablescout.llm.pieces import PieceVocabulary, encode
from tablescout.llm.secrets import redact_secrets
from tablescout.workspace import shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a letter, which are those with a score above 0, also where no row has a language to learn from.

    Only the letter check rejects rows; the network's predictions decide about none. Columns keep their values, whatever their names.
    """
    model = fit_language_model(docs.filter(remainder("doc_id", 4) != 2))
    # The operator would replace columns that are named like its own.
    own = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    told = identify_languages(own, model, text_column=f"_{docs.columns.index('text')}")
    return told.filter("lang_score > 0").select(*own.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of near copies."""
    return keep_one_each(docs, jaccard_components(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a near copy of a benchmark item."""
    return drop_leaked(docs, find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in texts; `n_chars` follows the text."""
    return redact_secrets(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the ids of each text's pieces and their number."""
    return encode(docs, PieceVocabulary.load())


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece encoding and decoding", sentencepiece),
]

# No SQL states it: the first stage only drops texts without a letter, but the later ones compare, mask and encode texts beyond what SQL can.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{i}")
        docs = spark.read.parquet(f"{out}/{i}")
    return docs

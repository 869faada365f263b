import random
import re

import pytest

SF = "/root/testdata/sf0.001"

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text, lower=False):
    raw = (text or "").encode()
    return WORD.findall(raw.translate(UPPER) if lower else raw)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}{r.choice(['', '.', ','])}" for _ in range(n))


# Names that operators use themselves, as columns of the input.
CLASHING = (
    "id", "text_hash", "tokens", "n", "a", "b", "group", "row", "spans", "slot", "shard", "lang_pred", "lang_score", "token_ids",
    "n_tokens", "component_id", "bucket", "h", "o", "key", "quality_score", "fingerprint", "found_id", "gone", "suspect", "start", "node")


def table(spark, rows, extra=True):
    """(doc_id, text) rows as documents, with clashing columns around them."""
    names = list(CLASHING) if extra else []
    schema = ", ".join([*(f"`{n}` string" for n in names), "doc_id long, text string, lang string, source string, n_chars long"])
    data = [(*(f"{n}!" for n in names), i, t, "en", "s", len(t or "")) for i, t in rows]
    return spark.createDataFrame(data, schema)


LONG = prose(5, 60_000)
EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Three words here"), (6, prose(1, 80)), (6, prose(1, 80)), (7, prose(1, 80)),
    (8, prose(2, 300)), (9, prose(2, 300) + " tail"), (10, LONG), (11, "5 6 7 !!"), (12, "àéî ßø 日本語 テキスト"), (None, prose(3, 70)), (13, "one"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return table(spark, EDGES).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")

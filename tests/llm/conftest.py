import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Frame of documents from ``(doc_id, text)`` pairs, with columns that clash with inner names."""

    def make(pairs, **extra):
        schema = T.StructType([*DOCS.fields, *[
            T.StructField(n, T.StringType())
            for n in ("id", "n", "kept", "bucket", "hashes", "node", "key", "part", "piece", "label", "score")
        ]])
        rows = [
            (i, t, extra.get("lang"), None if k % 2 else "s", None if t is None else len(t), *["x"] * 11)
            for k, (i, t) in enumerate(pairs)
        ]
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, odd characters, one very long text, repeated rows."""
    long = " ".join(random.Random(5).choices(["alpha", "beta", "gamma", "delta", "é", "漢字"], k=30_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "Ünïcode 漢字 🙂  two  spaces\r\nnext"), (6, long),
        (7, "same text of seven words in all"), (7, "same text of seven words in all"), (8, "x" * 50_000),
        (None, "a text without any id at all"), (None, None), (-9, "a text without any id at all"),
    ]


@pytest.fixture(scope="session")
def near_copies():
    """Documents over a small vocabulary with groups of exact and near copies."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    shared = rng.choices(words, k=40)
    out, number = [], 0
    for group in range(12):
        base = rng.choices(words, k=rng.choice([3, 8, 30, 60, 120]))
        for _ in range(rng.choice([1, 2, 5, 25])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                at = rng.randrange(len(text) + 1)
                text[at:at] = shared
            if rng.random() < 0.2:
                text = text[:-2] or text
            number += 1
            out.append((number * 7 % 1009, rng.choice([" ", "  ", "\n"]).join(text)))
    return out

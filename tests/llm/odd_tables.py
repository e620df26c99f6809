"""Small odd tables: nulls, empty and long texts, repeated rows, clashing column names."""

import random

import pytest

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, size string"


def odd_rows():
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdeéñ") for _ in range(draw.randint(1, 9))) for _ in range(300)]
    make = lambda n: " ".join(draw.choice(words) for _ in range(n)) + "."
    long, passage = make(4000), make(90)
    texts = [None, "", "   \n\t", "one", "Two words", "!!! 123", long, long + " tail", passage]
    texts += [make(40) + "\n" + passage + "\n" + make(40) for _ in range(4)]
    texts += [make(draw.randint(5, 120)) for _ in range(25)]
    texts += [texts[10], texts[11], "ab " * 700, passage]
    rows = [(i * 7, t, ["aa", "bb", None][i % 3], ["s2", "s1", None, "s3"][i % 4], i, 0.5, "x")
            for i, t in enumerate(texts)]
    return [*rows, rows[12], rows[12], (None, "no id here", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)

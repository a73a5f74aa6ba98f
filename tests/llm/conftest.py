import random

import pytest

from gradeloom.llm.common import small_batches

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, bucket string, key string, words string, doc string, n_words string, node string, mark string, lines string, gone string, kept string, rank string"


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls everywhere, empty and long texts, ties, repeated rows."""
    rnd = random.Random(5)
    long = prose(rnd, 30_000)
    texts = [None, "", " \n\t ", "one two", "Ünï cödé ßtraße 😀 end.", prose(rnd, 120), prose(rnd, 60) + ".\n" + prose(rnd, 40) + ".", long, "x" * 5000]
    rows = [(i, t, "en", "a" if i % 2 else None) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "a"), (5, texts[5], "en", "a"), (5, "another text under one id", None, "b"), (None, texts[6], "de", "b"), (None, None, None, None), (None, texts[5], None, "c")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    small_batches(spark)
    wide = [(i, t, lang, source, None if t is None else len(t)) + ("clash",) * 0 + (7,) + ("clash",) * 11 for i, t, lang, source in odd_rows]
    return spark.createDataFrame(wide, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

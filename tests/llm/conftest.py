import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

WORDS = "river stone lamp winter garden yellow market bridge copper silver window letter travel paper circle forest planet bottle summer engine harbour candle meadow velvet thunder whisper lantern orchard pebble saddle timber violet walnut zephyr anchor basket cradle dagger ember falcon".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


#: Nulls, empty and blank texts, few words, other scripts, a very long one, and repeated rows.
def odd_texts(seed=1):
    r = random.Random(seed)
    long = sentence(r, 6000)
    base = sentence(r, 90)
    return [None, "", " \n\t ", "one", "four words are here", "Ünï cödé – 中文 текст   \U0001f600 end", base, base, base + " more", long, long, base.replace(" ", "\n"), "a " * 300, "é" * 400, base.upper()]


CLASH = ["kept", "n", "key", "rep", "fp", "body", "spans", "id", "u", "v", "hub", "mentions", "at", "Quality", "_new"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """texts -> documents with further columns of clashing names and nulls in them."""

    def make(texts, ids=None):
        from pyspark.sql import types as T

        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASH)
        rows = [(i, t, None if i is None or i % 2 else "en", None, None if t is None else len(t), *[None if k % 2 else "x" for k in range(len(CLASH))]) for i, t in zip(ids or range(len(texts)), texts)]
        return spark.createDataFrame(rows, schema) if rows else spark.createDataFrame([], T._parse_datatype_string(schema))

    return make

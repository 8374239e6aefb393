import re
from collections import defaultdict

import pytest

from strandlake.llm import pii_surrogates


@pytest.fixture(scope="module")
def run(spark):
    def go(texts, ids=None, key="a key"):
        rows = [(i, t, k) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts))]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, place int")
        return [r["text"] for r in sorted(pii_surrogates.with_surrogates(df, spark, key).collect(), key=lambda r: r["place"])]

    return go


def test_every_word_is_replaced_from_the_original_alone(run):
    """Against a plain version: equal names get equal words, different ones different words, in whatever chain the surrogates stand."""
    import random

    r = random.Random(4)
    names = [n for n in pii_surrogates.GIVEN["latin", "f"]]
    texts = []
    for _ in range(25):
        people = [(r.choice(names), f"Q{r.choice('abcdefgh')}{r.choice('uvwxyz')}llby") for _ in range(6)]
        words = [w for p in people for w in (" ".join(p), "met", r.choice(p), "with", r.choice(p).upper(), "and")]
        texts.append(" ".join(words) + ".")
    for before, after in zip(texts, run(texts)):
        a, b = before.rstrip(".").split(), after.rstrip(".").split()
        assert len(a) == len(b)
        to = defaultdict(set)
        for x, y in zip(a, b):
            if x in ("met", "with", "and"):
                assert x == y
            else:
                assert x.isupper() == y.isupper()
                to[x.lower()].add(y.lower())
        assert all(len(v) == 1 for v in to.values())
        assert len({min(v) for v in to.values()}) == len(to)
        assert not any(k == min(v) for k, v in to.items())


def test_names_by_title_label_and_address(run):
    texts = [
        "Dr. Natarajan and Mr Wei Zhang came; Zhang left.", "Patient: Priya Natarajan, aged 40", "Write to Priya Natarajan <priya@mail.example.org>.",
        "Maria de la Cruz met Ludwig J. Harrow-Smith's son.", "Call 020 7946 0958 today.", "The European Union and New York stay, Monday too.", "Контакт Мария П. Иванова",
    ]
    got = run(texts)
    for t, gone in zip(got, ("Natarajan Wei Zhang", "Priya Natarajan", "Priya Natarajan priya", "Maria Cruz", "7946", "", "Мария Иванова П.")):
        assert not set(gone.split()) & set(re.findall(r"[\w.]+", t)), t
    assert re.fullmatch(r"Dr\. (\w+) and Mr (\w+) (\w+) came; \3 left\.", got[0])
    assert got[0].split()[1] == got[1].split()[2].rstrip(",") == got[2].split()[3]
    assert " de la " in got[3] and re.fullmatch(r"Call 0\d\d \d{4} \d{4} today\.", got[4]) and got[5] == texts[5]


def test_initials_stay_different(run):
    got = run([" ; ".join(f"Emily {c}. Watson" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")])[0].split(" ; ")
    assert len(set(got)) == 26 and not any(f" {c}. " in x for c, x in zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", got))


def test_null_ids_equal_rows_and_short_locals(run):
    locals_ = [f"{c}@x.example" for c in "abcdefghijklmnopqrstuvwxyz"]
    texts = ["Call 28.101.129.61 now", "ann.berg@mail.example.org or so", "ann.berg@mail.example.org or so", "Emma Harrow wrote", *locals_]
    got = run(texts, [None, 1, 1, None, *range(2, 28)])
    assert got[1] == got[2] and re.fullmatch(r"[^@ ]+@[^@ ]+\.[^@ ]+\.org or so", got[1])
    assert re.fullmatch(r"Call \d+\.\d+\.\d+\.\d+ now", got[0]) and re.fullmatch(r"[A-Z]\w+ [A-Z]\w+ wrote", got[3])
    assert len(set(got[4:])) == 26 and not set(got[4:]) & set(locals_)


def test_the_key_decides(run, spark):
    text = ["Emma Harrow, ann.berg@mail.example.org"]
    assert run(text) == run(text) != run(text, key="another")
    assert pii_surrogates.secret_of(spark) == pii_surrogates.secret_of(spark) and len(pii_surrogates.secret_of(spark)) >= 32

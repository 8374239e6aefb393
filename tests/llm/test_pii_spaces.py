import string

import pytest

from strandlake.llm import pii_surrogates


def chosen(spark, rows):
    got = pii_surrogates.surrogates(spark.createDataFrame(rows, "part string, canon string"), spark).collect()
    assert sorted((r["part"], r["canon"]) for r in got) == sorted(rows)
    for part in {p for p, _ in rows}:
        assert len({r["surrogate"] for r in got if r["part"] == part}) == sum(p == part for p, _ in rows)
    assert all(r["surrogate"] != r["canon"] for r in got)
    return {(r["part"], r["surrogate"]) for r in got}


def test_short_local_parts_and_domains(spark):
    letters = string.ascii_lowercase
    rows = [("local", a) for a in letters + "_"] + [("domain", a + b + ".com") for a in letters for b in letters]
    assert not chosen(spark, rows) & set(rows)


@pytest.mark.parametrize("n", [50, 51, 100])
def test_full_spaces(spark, monkeypatch, n):
    """Two-digit numbers: up to half of the space has surrogates outside the corpus; beyond, the canons trade places."""
    monkeypatch.setattr(pii_surrogates, "DRAWS", 3)
    rows = [("phone", f"{i:02d}") for i in range(n)] + [("ssn", "123456789")]
    new = chosen(spark, rows)
    assert all(len(s) == 2 for p, s in new if p == "phone")
    assert n > 50 or not new & set(rows)

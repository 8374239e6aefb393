import math
import random

import pytest
from brute import shingles
from conftest import odd_texts, sentence

import corpus_pipeline
from strandlake.llm import near_dedup


def edited(text, places):
    """A changed word costs five shingles on either side."""
    w = text.split()
    for p in places:
        w[p] += "x"
    return " ".join(w)


def kept_at(texts, percent):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]) and root[i] != root[j]:
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return {i for i, r in enumerate(root) if i == r}


def test_stage_takes_pairs_from_080_on(spark, make_docs):
    r = random.Random(31)
    texts = odd_texts()
    for k in range(40):
        base = sentence(r, 204)
        texts += [base, edited(base, range(10, 200, 200 // (2 + k % 5)))]  # similarities from about 0.9 to 0.73
    want = kept_at(texts, 80)
    assert len(want) < len(kept_at(texts, 85))
    got = corpus_pipeline.near_duplicates(spark, make_docs(texts), "")
    assert {x["doc_id"] for x in got.collect()} == want
    assert {x["doc_id"] for x in near_dedup.without_near_duplicates(make_docs(texts), spark).collect()} == kept_at(texts, 85)


@pytest.mark.parametrize("percent", [50, 70, 80, 85, 90, 100])
def test_layouts(percent):
    """One error a chunk covers the radius, which a pair at the threshold exceeds in fewer than 1 of 10,000 cases."""
    of = near_dedup.layout(percent)
    p = (1 - percent / 100) * 255 / 256
    assert of.radius // of.chunks <= 1 and of.symbols <= near_dedup.MOST_SYMBOLS
    assert sum(math.comb(of.symbols, k) * p**k * (1 - p) ** (of.symbols - k) for k in range(of.radius + 1, of.symbols + 1)) < 1e-4

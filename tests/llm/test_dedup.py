import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from brute import near_components, without_strings, without_windows
from conftest import WORDS, odd_texts, sentence

from strandlake.llm import anchors, common, near_dedup, quality_rules, substring_dedup, suffix_dedup
from strandlake.llm.graph import components


def edited(r, text, share):
    return " ".join(r.choice(WORDS) if r.random() < share else w for w in text.split())


def copies(seed, n=70):
    """Groups of near copies on both sides of the threshold, exact copies, shared passages, and texts of their own."""
    r = random.Random(seed)
    bases = [sentence(r, k) for k in (60, 140, 400)]
    passage = sentence(r, 60)
    out = []
    for _ in range(n):
        b = r.choice(bases)
        kind = r.random()
        out.append(b if kind < 0.15 else edited(r, b, r.choice([0.005, 0.01, 0.02, 0.03, 0.1])) if kind < 0.7 else sentence(r, 40) + " " + passage + "\n" + sentence(r, 30) if kind < 0.85 else sentence(r, r.randint(1, 120)))
    return out


def test_near_duplicates(spark, make_docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 8)  # many blocks
    texts = odd_texts() + copies(3)
    got = near_dedup.near_duplicates(make_docs(texts), spark).collect()
    want = near_components(dict(enumerate(texts)))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert len({c for _, c in want.values()}) < len(want)


def test_borderline_group(spark, make_docs):
    """One group whose members are mostly just below the threshold to each other."""
    r = random.Random(5)
    base = sentence(r, 150)
    texts = [edited(r, base, 0.015) for _ in range(90)]
    got = near_dedup.near_duplicates(make_docs(texts), spark).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_components(dict(enumerate(texts)))


def test_near_duplicates_without_rows_or_ids(spark, make_docs):
    assert near_dedup.near_duplicates(make_docs([]), spark).count() == 0
    text = "the same text for all of the rows here"
    got = near_dedup.near_duplicates(make_docs([text, text, text, text], [None, 4, 4, 9]), spark).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [(-1, -1, True), (4, 4, True), (4, 4, True), (9, 4, False)]
    kept = near_dedup.without_near_duplicates(make_docs([text, text, text, text], [None, 4, 4, 9]), spark)
    assert kept.columns == make_docs([]).columns and kept.count() == 3


def test_every_pair_within_the_radius_shares_a_key():
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(300):
        a = r.integers(0, 256, near_dedup.SYMBOLS)
        b = a.copy()
        at = r.choice(near_dedup.SYMBOLS, near_dedup.RADIUS, replace=False)
        b[at] = (b[at] + 1) % 256
        x, y = a.reshape(near_dedup.CHUNKS, -1), b.reshape(near_dedup.CHUNKS, -1)
        assert ((x != y).sum(axis=1) <= near_dedup.RADIUS // near_dedup.CHUNKS).any()


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {row["node"]: row["root"] for row in components(spark.createDataFrame(edges, "u bigint, v bigint"), spark).collect()}
    assert {n: got.get(n, n) for e in edges for n in e} == {n: find(n) for e in edges for n in e}


@pytest.mark.parametrize("group", [1000, 3])
def test_repeated_strings(spark, make_docs, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    r = random.Random(8)
    passage = sentence(r, 40)
    texts = odd_texts() + copies(9, 40) + [passage[:199] + "!", "x" + passage[:199], passage[:200], "zz" + passage[:200] + "yy", "ab" * 400, "abc" * 300, passage[7:] + passage]
    got = suffix_dedup.without_repeated_strings(make_docs(texts), spark).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == without_strings(dict(enumerate(texts)))


def test_repeated_strings_without_rows_or_ids(spark, make_docs):
    assert suffix_dedup.without_repeated_strings(make_docs([]), spark).count() == 0
    text = "abcdefghij" * 3
    got = suffix_dedup.without_repeated_strings(make_docs([text, text * 9], [None, 1]), spark, with_bytes=True).collect()
    assert {r["doc_id"]: len(r["kept"]) for r in got} == {None: 30, 1: 0}


def test_scan_of_sorted_rows():
    """Whatever batches the rows come in, against sets."""
    r = np.random.default_rng(3)
    n = 1500
    fp, context, doc, pos = r.integers(0, 200, n), r.integers(0, 3, n), r.integers(0, 60, n), r.integers(0, 20, n)
    copied = r.random(n) < 0.1
    order = np.lexsort((pos, doc, context, fp))
    fp, context, doc, pos, copied = (x[order] for x in (fp, context, doc, pos, copied))
    rows = pa.RecordBatch.from_arrays([pa.array(fp), pa.array(context), pa.array(doc), pa.array(pos.astype(np.int32)), pa.array((copied * anchors.COPIED).astype(np.int8))], names=["fp", "context", "doc_id", "pos", "kind"])
    places, marked = {}, set()
    for f, c, d, p, k in zip(*(x.tolist() for x in (fp, context, doc, pos, copied))):
        places.setdefault((f, c), []).append((d, p))
        if k:
            marked.add((f, c))
    runs = Counter(f for f, _ in places)
    for first_too in (False, True):
        whole = Counter((f, *x) for (f, c), v in places.items() for x in (sorted(set(v)) if first_too and (len(set(v)) > 1 or (f, c) in marked) else sorted(set(v))[1:]))
        edge = Counter((f, *min(v)) for (f, c), v in places.items() if runs[f] > 1)
        for size in (1, 7, 100, n):
            got = [(x["kind"], (x["fp"], x["doc_id"], x["pos"])) for b in anchors.scan((rows.slice(a, size) for a in range(0, n, size)), first_too) for x in b.to_pylist()]
            assert Counter(x for k, x in got if k == anchors.WHOLE) == whole and Counter(x for k, x in got if k == anchors.EDGE) == edge


def test_index_family(spark, make_docs):
    """Levels shrink geometrically, and after each batch what the adds have told of is what repeats among all documents."""
    r = random.Random(21)
    texts = [t for t in copies(22, 30) if t] + [sentence(r, 50) for _ in range(3)]
    r.shuffle(texts)
    family, gone = suffix_dedup.IndexFamily(spark), {i: set() for i in range(len(texts))}
    at = 0
    for size in (12, 3, 3, 9, 6):
        batch = range(at, min(at + size, len(texts)))
        at += size
        for x in family.add(make_docs([texts[i] for i in batch], list(batch))).collect():
            gone[x["doc_id"]].update(range(max(x["low"], 0), min(x["high"], len(texts[x["doc_id"]].encode()))))
        sizes = [n for _, n in family.levels]
        assert all(x > 2 * y for x, y in zip(sizes, sizes[1:]))
        want = without_strings({i: texts[i] for i in range(min(at, len(texts)))})
        assert {i: len(gone[i]) for i in want} == {i: v[1] for i, v in want.items()}
    assert len(family.levels) < 5


def test_shared_and_missing_ids(spark, make_docs):
    """Rows are told apart by their texts: each has what the plain version gives for distinct ids."""
    r = random.Random(33)
    passage, other = sentence(r, 60), sentence(r, 60)
    texts = [passage + " " + sentence(r, 20), other, passage + " end", other + " x", sentence(r, 60), passage + " end", other, None, ""]
    ids = [None, None, 7, 7, None, 7, 9, None, 7]
    df = make_docs(texts, ids)
    distinct = {}
    for i, t in zip(ids, texts):
        distinct.setdefault((i, t or ""), len(distinct))
    want = without_strings({k: t for (_, t), k in distinct.items()})
    got = sorted((x["doc_id"] or 0, x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.without_repeated_strings(df, spark).collect())
    assert got == sorted((i or 0, *want[distinct[i, t or ""]]) for i, t in zip(ids, texts))
    rows = substring_dedup.without_earlier_windows(df, spark, with_text=True).collect()
    assert sorted((x["doc_id"] or 0, x["n_words"]) for x in rows) == sorted((i or 0, len((t or "").split())) for i, t in zip(ids, texts))
    assert [x["n_removed"] for x in rows if x["doc_id"] is None and x["text"] == texts[4]] == [0]
    assert [x["n_removed"] for x in rows if x["doc_id"] == 9] == [60]  # after all of them
    # One of each passage's texts stays whole: that which comes first.
    assert sum(passage in x["text"] for x in rows) in (1, 2) and sum(other in x["text"] for x in rows) == 1


@pytest.mark.parametrize("shard", [1, 4, 1000])
def test_earlier_windows(spark, make_docs, monkeypatch, shard):
    monkeypatch.setattr(substring_dedup, "SHARD_CONTEXTS", shard)
    r = random.Random(4)
    passage = sentence(r, 50)
    w = passage.split()
    texts = odd_texts() + copies(12, 50) + [" ".join(w[:19]), " ".join(w[:20]), " ".join(w[5:25] + ["x"] + w[3:40]), "a b c " * 40, "a b " * 30, passage + " " + passage]
    got = substring_dedup.without_earlier_windows(make_docs(texts), spark).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == without_windows(dict(enumerate(texts)))


def test_earlier_windows_without_rows_or_ids(spark, make_docs):
    assert substring_dedup.without_earlier_windows(make_docs([]), spark).count() == 0
    text = sentence(random.Random(1), 30)
    got = substring_dedup.without_earlier_windows(make_docs([text, text + " end"], [1, None]), spark, with_text=True).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {None: text + " end", 1: ""}


def test_suffix_automaton_finds_all_earlier_windows():
    r = random.Random(6)
    for _ in range(200):
        segments = [(k, [r.randrange(3) for _ in range(r.randint(1, 30))]) for k in range(r.randint(1, 5))]
        size = r.randint(2, 6)
        got = set()
        for k, a, b in substring_dedup.earlier_windows(segments, size):
            got |= {(k, i) for i in range(a, b)}
        seen, want = set(), set()
        for k, x in segments:
            for i in range(len(x) - size + 1):
                t = tuple(x[i : i + size])
                if t in seen:
                    want |= {(k, j) for j in range(i, i + size)}
                seen.add(t)
        assert got == want


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_hashes_tell_thue_morse_words_apart(spark, make_docs):
    """Their polynomial hashes modulo a power of two are equal for any odd base."""
    r = random.Random(5)
    one, two = ("".join("ab"[x ^ k] for x in thue_morse(2048)) for k in (0, 1))
    assert len(set(common.words_of(pa.array([one, two, one]), False).hash.tolist())) == 2
    plain = [f"w{r.randrange(10**6)}" for _ in range(30)]
    texts = [" ".join([one, *plain[:19]]), " ".join([two, *plain[:19]]), " ".join([one] * 5 + plain[:4]), " ".join([two] * 5 + plain[5:9])]
    words = [["ab"[x ^ k] for x in thue_morse(32)] for k in (0, 1)]
    texts += [" ".join(w + plain) for w in words]
    docs = dict(enumerate(texts))
    df = make_docs(texts)
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, spark).collect()}
    assert near == brute.near_components(docs)
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.without_repeated_strings(df, spark).collect()} == brute.without_strings(docs)
    assert {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.without_earlier_windows(df, spark).collect()} == brute.without_windows(docs)
    lines = [f"{one}\n{two}\n{one}", f"{two}\n{one}"]
    counts, _ = quality_rules.statistics(pa.array(lines))
    assert counts["n_dup_lines"].tolist() == [1, 0]

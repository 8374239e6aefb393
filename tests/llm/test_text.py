import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import contamination, rule_counts, words
from conftest import odd_texts, sentence

from strandlake.llm import byte_bpe, common, decontaminate, language_id, ordinal_quality, quality_rules, trees

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_words_equal_the_pattern():
    texts = odd_texts() + ["\x0b\x0ca\x0bb\x0c", "x\x1cy z"]
    w = common.words_of(pa.array(texts), lower=False)
    assert np.diff(w.first).tolist() == [len(words(t)) for t in texts]
    flat = [x for t in texts for x in words(t)]
    assert [w.raw[a:b].tobytes().decode() for a, b in zip(w.start, w.end)] == flat
    assert len(set(w.hash.tolist())) == len(set(flat))


def test_rules(spark, make_docs):
    r = random.Random(2)
    texts = odd_texts() + ["same line\nsame line\n\nsame line ", "# $ % x\n \n \n", " ".join(["a b c d e f"] * 4)] + [sentence(r, 60) for _ in range(20)] + [sentence(r, 60).replace(" ", "*** ") for _ in range(20)]
    docs = make_docs(texts)
    labels = labels_of(spark, [(i, 0 if "***" in (t or "") else 1, 0) for i, t in enumerate(texts)] + [(None, 1, 0), (3, None, 0)])
    rows = quality_rules.scored(docs, quality_rules.fit(docs, labels)).collect()
    for x in rows:
        n = rule_counts(texts[x["doc_id"]])
        assert tuple(x[c] for c in quality_rules.COUNTS) == n
        assert x["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (x["base_failed"] and x["kept"])
    kept = {x["doc_id"] for x in rows if x["kept"]}
    assert set(range(len(texts) - 40, len(texts) - 20)) <= kept and not kept & set(range(len(texts) - 20, len(texts)))
    left = quality_rules.kept_documents(docs, quality_rules.fit(docs, labels))
    assert left.columns == docs.columns and {x["doc_id"] for x in left.collect()} == kept


def test_rules_without_rows_or_labels(spark, make_docs):
    none = labels_of(spark, [])
    empty = make_docs([])
    assert quality_rules.scored(empty, quality_rules.fit(empty, none)).count() == 0
    docs = make_docs(["one two three four five six seven eight nine ten", "short"], [None, 2])
    assert {x["doc_id"]: x["kept"] for x in quality_rules.scored(docs, quality_rules.fit(docs, none)).collect()} == {None: True, 2: False}


def test_trees_are_monotone():
    r = np.random.default_rng(1)
    x = r.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + r.normal(0, 0.3, 3000)) < 0.7).astype(float)
    model = trees.fit(x, y, {0: -1}, rounds=40)
    grid = np.repeat(r.random((50, 3)), 40, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    p = model.probability(grid).reshape(50, 40)
    assert (np.diff(p, axis=1) <= 1e-12).all() and ((model.probability(x) > 0.5) == (y > 0.5)).mean() > 0.75
    assert trees.fit(x[:0], y[:0]).probability(x).std() == 0


def test_bpe_equals_tiktoken(spark, make_docs):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    r = random.Random(3)
    texts = odd_texts() + ["<|endoftext|> it's we'll  two  spaces\n\n", "a" * 1500, "".join(chr(r.randrange(32, 0x2FFF)) for _ in range(3000)), "0123456789" * 60, "\x00\x01 �"]
    docs = make_docs(texts, [*range(len(texts) - 1), None])
    for row in byte_bpe.encoded(docs, RANKS, PATTERN, with_ids=True).collect():
        text = texts[row["doc_id"] if row["doc_id"] is not None else -1] or ""
        ids = own.encode_ordinary(text)
        assert row["ids"] == ids and row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.encoded(make_docs([]), RANKS, PATTERN).count() == 0


def test_bpe_generations(monkeypatch):
    """Dropping old pieces changes nothing."""
    monkeypatch.setattr(byte_bpe, "KEPT_PIECES", 50)
    coder = byte_bpe.Coder(RANKS, PATTERN)
    r = random.Random(1)
    texts = [sentence(r, 30) for _ in range(12)]
    ids = [[int(i) for i in x.split(b",")] for t in texts for x in coder.encode([t])]
    assert [d.decode() for d in coder.decode([np.array(x) for x in ids])] == texts
    assert len(coder.known) + len(coder.older) < 250


@pytest.mark.parametrize("tokens", [1, 7, 500_000])
def test_bpe_decodes_ids(monkeypatch, tokens):
    """From ids alone, also such as no text has, in however many queries."""
    monkeypatch.setattr(byte_bpe, "TOKENS", tokens)
    coder = byte_bpe.Coder(RANKS, PATTERN)
    ranks, r = {v: k for k, v in byte_bpe.read_ranks(RANKS).items()}, random.Random(8)
    lists = [[r.randrange(len(ranks)) for _ in range(n)] for n in (0, 1, 20, 0, 5)]
    assert coder.decode([np.array(x, dtype=np.int32) for x in lists]) == [b"".join(ranks[i] for i in x) for x in lists]
    assert coder.decode([]) == []


def test_bpe_coder_in_use_is_not_closed():
    coder = byte_bpe.Coder.of(RANKS, PATTERN)
    byte_bpe.Coder.release()  # a timer that fires now
    assert byte_bpe.Coder.of(RANKS, PATTERN) is coder and list(coder.encode(["some text"]))
    byte_bpe.Coder.rest()
    byte_bpe.Coder.release()
    assert list(coder.encode(["other text"]))
    byte_bpe.Coder.rest()
    byte_bpe.Coder.release()
    assert not byte_bpe.Coder._made


def naive_phrases(text, parts):
    """Greedy longest matches of text in any of parts."""
    n = i = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and any(text[i : i + k + 1] in p for p in parts):
            k += 1
        n, i = n + 1, i + k
    return n


@pytest.mark.parametrize("block", [1, 3, 7, 1024])
def test_phrases_are_greedy_longest_matches(monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    r = random.Random(7)
    parts = ["".join(r.choice("abc ") for _ in range(r.randint(1, 60))) for _ in range(6)]
    flat = np.concatenate([np.append(np.frombuffer(p.encode(), dtype=np.uint8), 0) for p in parts]).astype(np.uint8)
    model = language_id.build({"x": flat})
    texts = ["".join(r.choice("abcd") for _ in range(r.randint(1, 80))) for _ in range(60)]
    count, n = model.phrases(pa.array(texts))
    assert count[:, 0].tolist() == [naive_phrases(t, parts) for t in texts] and n.tolist() == [len(t) for t in texts]


def test_languages(spark, make_docs, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = language_id.predicted(docs, language_id.learn(docs)).join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) > 0
    assert all(0 <= r["score"] <= 1 for r in rows)
    model = language_id.learn(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predicted(make_docs([None, "", "12 34 !", "é", "the thing"], [0, 1, 2, None, 4]), model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[None][0] != "und" and got[4][0] != "und"
    assert language_id.predicted(make_docs([]), model).count() == 0
    nothing = language_id.learn(make_docs([]))
    assert [tuple(r)[2:] for r in language_id.predicted(make_docs(["some text"]), nothing).collect()] == [("und", 0.0)]


def brute_languages(samples, text):
    """(language, score) by the definition."""
    text = "".join(re.sub(r"[^a-z\x80-\uffff]+", " ", text.lower()))
    found = []
    for x, parts in samples.items():
        size = sum(len(p) + 1 for p in parts)
        found.append((naive_phrases(text, parts) * np.log2(size + 1) / len(text), -size, x))
    found.sort()
    return found[0][2], 1 - found[0][0] / found[1][0]


@pytest.mark.parametrize("at_once", [1, 2, 8])
def test_many_languages(spark, monkeypatch, at_once):
    """Whole texts are learned, every language is, and the number of passes changes nothing."""
    monkeypatch.setattr(language_id, "AT_ONCE", at_once)
    r = random.Random(17)
    letters = {x: r.sample("abcdefghijklmnop", 6) for x in ("aa", "bb", "cc", "dd", "ee")}
    rows, samples = [], {x: [] for x in letters}
    for i in range(60):
        x = r.choice(list(letters))
        text = "".join(r.choice(letters[x]) for _ in range(r.randint(30, 1500)))
        rows.append((i, text, x))
        if zlib.crc32(str(i).encode()) % 4 != 2:
            samples[x].append(text)
    rows += [rows[0], (rows[0][0], "other text of no language", None), (None, "abc", "aa")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    monkeypatch.setattr(language_id, "SAMPLE_CHARS", 10**9)
    got = [tuple(x) for x in language_id.predicted(docs, language_id.learn(docs)).collect()]
    assert len(got) == len(rows)
    want = [(i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2, *brute_languages(samples, t)) for i, t, _ in rows]
    key = lambda x: (x[0] is None, x[0] or 0, x[2], round(x[3], 9))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-9


def graded(r, n):
    texts, labels = [], []
    for i in range(n):
        t, kind = sentence(r, r.randint(20, 80)), r.random()
        if kind < 0.2:
            t = t.replace(" ", " | ")
        elif kind < 0.4:
            t += " " + r.choice(["nastyword", "Vileword!"])
        texts.append(t)
        labels.append((i, int(kind >= 0.2), int(0.2 <= kind < 0.4)))
    return texts, labels


def test_cumulative_link_likelihood():
    """The loss by its definition, and its slopes by differences."""
    r = np.random.Generator(np.random.PCG64(3))
    z, theta, grade, share = r.normal(size=40), np.array([-0.7, 0.9]), r.integers(0, 3, 40), r.random(40)
    s = lambda x: 1 / (1 + np.exp(-x))

    def loss(z, theta):
        cut = np.array([-np.inf, *theta, np.inf])
        return -sum(w * np.log(s(cut[g + 1] - x) - s(cut[g] - x)) for x, g, w in zip(z, grade, share))

    got, by_z, by_theta = ordinal_quality.link_loss(z, theta, grade, share)
    assert abs(got - loss(z, theta)) < 1e-9
    for slopes, at in ((by_z, 0), (by_theta, 1)):
        for i in range(len(slopes)):
            move = [np.zeros(40), np.zeros(2)]
            move[at][i] = 1e-5
            assert abs((loss(z + move[0], theta + move[1]) - loss(z - move[0], theta - move[1])) / 2e-5 - slopes[i]) < 1e-5


def test_ordinal_scores_by_definition(spark, make_docs):
    r = random.Random(19)
    texts, labels = graded(r, 200)
    model = ordinal_quality.learn(make_docs(texts), labels_of(spark, labels))
    odd = odd_texts()
    for x in ordinal_quality.scored(make_docs(odd), model).collect():
        features, _ = ordinal_quality.hashed(pa.array([odd[x["doc_id"]]], pa.string()))
        z = sum(model.weights[k] for k in set(features.tolist()))
        tails = [1 / (1 + np.exp(t - z)) for t in model.thresholds]
        assert abs(x["tail_probability"] - tails[1]) < 1e-9 and abs(x["expected_grade"] - sum(tails)) < 1e-9 and x["kept"] == (tails[1] >= 0.5)


def test_repeated_ids_do_not_lift_the_bound(spark, make_docs):
    labels = labels_of(spark, [(i, 1, 0) for i in range(3)])
    docs = make_docs([f"text {i}" for i in range(30)], [i % 3 for i in range(30)])
    rows = quality_rules.training_sample(docs, labels, 2).collect()
    assert len(rows) == 2 and all(r["text"] == min(f"text {i}" for i in range(30) if i % 3 == r["doc_id"]) for r in rows)


def test_ordinal_grades(spark, make_docs):
    r = random.Random(9)
    texts, labels = graded(r, 400)
    model = ordinal_quality.learn(make_docs(texts), labels_of(spark, labels))
    assert (np.diff(model.thresholds) > 0).all()
    more, truth = graded(r, 300)
    rows = {x["doc_id"]: x for x in ordinal_quality.scored(make_docs(more), model).collect()}
    right = sum(rows[i]["kept"] == (q == 1 and t == 0) for i, q, t in truth)
    assert right >= 0.95 * len(truth)
    assert all(0 <= x["tail_probability"] <= 1 and x["tail_probability"] <= x["expected_grade"] <= 2 for x in rows.values())
    mean = lambda g: np.mean([rows[i]["expected_grade"] for i, q, t in truth if (0 if q == 0 else 1 if t else 2) == g])
    assert mean(0) < mean(1) < mean(2)


def test_ordinal_odd_rows(spark, make_docs):
    texts = odd_texts()
    model = ordinal_quality.learn(make_docs(texts), labels_of(spark, [(i, i % 2, None) for i in range(len(texts))] + [(0, 0, 1), (None, 1, 1)]))
    assert ordinal_quality.scored(make_docs(texts), model).count() == len(texts)
    assert ordinal_quality.scored(make_docs([]), model).count() == 0
    untaught = ordinal_quality.learn(make_docs(texts), labels_of(spark, []))
    assert all(x["kept"] for x in ordinal_quality.scored(make_docs(texts), untaught).collect())


def test_contamination(spark, make_docs):
    r = random.Random(11)
    items = [sentence(r, n) for n in (7, 15, 30, 55)] + ["Three words only", "", None]
    rows = [(i, t) for i, t in enumerate(items)] + [(99, items[2]), (None, "x y z")]
    benchmark = spark.createDataFrame(rows, "item_id bigint, text string")

    def leak(t, share):
        return " ".join("changed" if r.random() < share else w for w in t.split())

    texts = odd_texts() + ["three, (words) ONLY!", "three words", items[0], f"({items[1].upper()})."]
    for _ in range(40):
        texts.append(sentence(r, r.randint(0, 60)) + " " + leak(r.choice(items[:4]), r.choice([0, 0.02, 0.05, 0.1])) + " " + sentence(r, r.randint(0, 60)))
    docs = make_docs(texts)
    got = {x["doc_id"]: x for x in decontaminate.contamination(docs, benchmark).collect()}
    want = contamination(dict(enumerate(texts)), [t for t in items if t])
    for k, s in want.items():
        assert got[k]["contaminated"] == (s >= 0.8), (k, s)
        assert not got[k]["contaminated"] or abs(got[k]["similarity"] - s) < 1e-9
    assert got[len(odd_texts()) + 2]["item_id"] == 0
    left = decontaminate.clean_documents(docs, benchmark)
    assert left.columns == docs.columns and {x["doc_id"] for x in left.collect()} == {k for k, s in want.items() if s < 0.8}


@pytest.mark.parametrize("items_at_once", [2, 2000])
def test_contamination_in_blocks_and_without_rows(spark, make_docs, monkeypatch, items_at_once):
    r = random.Random(12)
    items = [sentence(r, 25) for _ in range(6)]
    benchmark = spark.createDataFrame([*enumerate(items[:5]), (None, items[5])], "item_id bigint, text string")
    texts = [items[4], "clean " + sentence(r, 30), sentence(r, 9) + " " + items[1], None, items[5], items[4], items[0], "clean too", items[4] + " " + items[2]]
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", items_at_once)
    docs = make_docs(texts, [0, 1, 2, 3, 4, 0, None, None, 5])
    got = [tuple(x) for x in decontaminate.contamination(docs, benchmark).collect()]
    want = [(0, True, 4, 1.0), (1, False, None, 0.0), (2, True, 1, 1.0), (3, False, None, 0.0), (4, True, None, 1.0), (0, True, 4, 1.0), (None, True, 0, 1.0), (None, False, None, 0.0), (5, True, 2, 1.0)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(x["text"] or "" for x in decontaminate.clean_documents(docs, benchmark).collect()) == sorted(["", texts[1], "clean too"])
    assert decontaminate.contamination(make_docs([]), benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0


def recall(n, seed=31):
    """Share found of windows with a run of one word, shortened or drawn out, whose similarity is 0.8 to 0.9."""
    r, found, all_ = random.Random(seed), 0, 0
    while all_ < n:
        words, run = sentence(r, r.randint(13, 50)).split(), r.randint(6, 12)
        item = " ".join(words + ["again"] * run)
        text = " ".join(words + ["again"] * (run + r.choice([-6, -5, -4, -3, 3, 4, 5, 6])))
        if not 0.8 <= contamination({0: text}, [item])[0] < 0.9:
            continue
        all_ += 1
        found += bool(list(decontaminate.index([1], [item]).matches(decontaminate.clean_words(pa.array([text])))))
    return found / all_


def test_contamination_recall_with_repeated_shingles():
    assert recall(400) >= 0.99

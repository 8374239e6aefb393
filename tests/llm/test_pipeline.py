import hashlib
import os
import random

import pytest
from brute import contamination, near_components
from conftest import sentence

import corpus_pipeline
from strandlake.llm import byte_bpe, queries
from strandlake.llm.common import stored

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(21)
    items = [sentence(r, 30) for _ in range(3)]
    base = sentence(r, 120)
    texts = [sentence(r, r.randint(30, 90)) for _ in range(40)]
    texts += [base, base, base + " tail", sentence(r, 20) + " " + items[1] + " " + sentence(r, 20), "short", None, "", " ".join(["again and again it goes"] * 20)]
    texts += [sentence(r, 40) + " write to first.last@mail.example.com or 81.12.13.14 " + sentence(r, 10)] + [sentence(r, 50).replace(" ", "$$$ ") for _ in range(20)]
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int("$$$" not in (t or "")), 0) for i, t in enumerate(texts)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, texts, items


def test_stages(spark, folder):
    d, texts, items = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, d), spark)
        seen.append({x["doc_id"]: x for x in docs.collect()})
        if name != "tokens":
            assert docs.columns == columns
    good, unlike, clean, safe, tokens = seen
    assert set(good) == {i for i, t in enumerate(texts) if t and "$$$" not in t and len(t.split()) >= 10 and "again and again" not in t}
    assert set(unlike) == {k for k, (_, c) in near_components({k: texts[k] for k in good}).items() if k == c}
    similar = contamination({k: texts[k] for k in unlike}, items)
    assert set(clean) == {k for k, s in similar.items() if s < 0.8} and len(clean) < len(unlike)
    assert set(safe) == set(clean) == set(tokens)
    changed = [k for k in safe if safe[k]["text"] != texts[k]]
    assert len(changed) == 1 and "first.last" not in safe[changed[0]]["text"] and "81.12.13.14" not in safe[changed[0]]["text"]
    assert all(safe[k]["n_chars"] == len(safe[k]["text"]) for k in safe)
    tiktoken = pytest.importorskip("tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for k, row in tokens.items():
        assert row["ids"] == own.encode_ordinary(safe[k]["text"])
        assert row["decoded_sha256"] == hashlib.sha256(safe[k]["text"].encode()).hexdigest()
    run = corpus_pipeline.run(spark, d)
    assert sorted((x["doc_id"], x["ids_sha256"]) for x in run.collect()) == sorted((k, x["ids_sha256"]) for k, x in tokens.items())


def test_every_operator_has_a_query(spark, tiny):
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))
    counts = {"op8": spark.read.parquet(f"{tiny}/pages.parquet").count()}
    documents = spark.read.parquet(f"{tiny}/documents.parquet").count()
    for name, f in queries.QUERIES.items():
        assert f(spark, tiny).count() == counts.get(name.split("_")[0], documents), name
    assert os.path.isfile(corpus_pipeline.__file__)

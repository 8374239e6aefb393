from strandlake.llm import pii_surrogates


def test_repeated_rows_and_shared_ids(spark, make_docs):
    """A row's new text depends on its text alone: repeated rows, shared and null ids change nothing."""
    texts = ["Emily R. Watson has a.berg@mail.example.org", "Call +1 (974) 555-3436 or write to b@c.example", "10.0.0.1 belongs to William Watson; Watson left", "nobody"]
    plain = {r["doc_id"]: (r["text"], r["n_entities"]) for r in pii_surrogates.with_surrogates(make_docs(texts), spark).collect()}
    many = [0, 0, 1, 2, 3, 0, 1, 2, 3, 3]
    ids = [7, 7, 7, 7, 7, None, None, None, None, None]
    got = pii_surrogates.with_surrogates(make_docs([texts[k] for k in many], ids), spark).collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["n_entities"]) for r in got) == sorted((i or 0, *plain[k]) for i, k in zip(ids, many))

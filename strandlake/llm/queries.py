"""The registered queries of the text operators, and their SQL where SQL can express them.

SQL has no trained models, signatures of its own, merges or parsers: those queries are tested against plain versions in tests/llm.
"""

from __future__ import annotations

from strandlake.llm.byte_bpe import op4_byte_bpe
from strandlake.llm.decontaminate import op2_simhash_decontamination
from strandlake.llm.html_extract import op8_html_extract
from strandlake.llm.language_id import op6_language_id
from strandlake.llm.near_dedup import op3_minhash_near_dedup
from strandlake.llm.ordinal_quality import op5_ordinal_quality
from strandlake.llm.pii_surrogates import op1_pii_surrogates
from strandlake.llm.quality_rules import op9_quality_rules
from strandlake.llm.substring_dedup import op10_substring_dedup
from strandlake.llm.suffix_dedup import op7_suffix_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_surrogates, op2_simhash_decontamination, op3_minhash_near_dedup, op4_byte_bpe, op5_ordinal_quality,
        op6_language_id, op7_suffix_dedup, op8_html_extract, op9_quality_rules, op10_substring_dedup,
    )
}

WORDS = r"'[^\x20\x09-\x0D]+'"
UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE: dict[str, str] = {
    "op3_minhash_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}), {WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id""",
    "op7_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS byte FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM d)),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d)),
k AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM w JOIN k ON k.s = w.s),
g AS (SELECT b.doc_id, b.i, byte, max(hit.i) OVER (PARTITION BY b.doc_id ORDER BY b.i) AS last FROM b LEFT JOIN hit ON hit.doc_id = b.doc_id AND hit.i = b.i),
m AS (SELECT *, coalesce(i - last < 200, false) AS gone FROM g),
t AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM m),
a AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM t GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN a ON a.doc_id = d.doc_id""",
    "op10_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM v) WHERE k > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
g AS (SELECT x.doc_id, p, word, max(i) OVER (PARTITION BY x.doc_id ORDER BY p) AS last FROM x LEFT JOIN hit ON hit.doc_id = x.doc_id AND i = p),
m AS (SELECT *, coalesce(p - last < 20, false) AS gone FROM g),
a AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a ON a.doc_id = d.doc_id""",
}
ORACLE = {k: " ".join(v.split()) if "\\x" not in v else v.strip() for k, v in ORACLE.items()}

"""Quality rules: gradient-boosted trees over document statistics.

Statistics of each whole text are computed in numpy for a piece of texts at a time; trees trained on labelled documents
are flat node arrays (trees.py), and chosen features are monotone: more repetition or symbols never raises a score.

Null and empty texts have no words and fail. Repeated rows each get their own result. Without labels of both classes
only the base rules decide. Columns of the input other than the id and text are passed by, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import trees
from strandlake.llm.common import U64, mix, pieces, spans_hash, table, windows_hash, words_of

#: Labelled documents that a model is fitted on at most: those of the smallest hashes of their ids.
SAMPLE = 8000
#: Probability of good quality from which a document is kept.
KEEP_FROM = 0.5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share",
    "stop_mark_share", "letter_share", "words_per_line", "bar_share", "top_word_share", "exclaim_per_word",
]
#: Features along which quality may only fall.
FALLING = {FEATURES.index(f): -1 for f in ("symbols_per_word", "dup_line_share", "repeat_share", "bar_share", "top_word_share")}

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_DIGIT = np.isin(np.arange(256), list(range(48, 58)))
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
_STOP = np.isin(np.arange(256), list(b".,;:?"))
_HEAD = (np.arange(256) & 0xC0) != 0x80


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(COUNTS by name, FEATURES as a matrix) of each text."""
    w = words_of(texts, lower=False)
    n = len(w.first) - 1

    def per_row(where: np.ndarray) -> np.ndarray:
        """How many marked bytes each row has."""
        sums = np.concatenate([[0], np.cumsum(where)])
        return sums[w.offsets[1:]] - sums[w.offsets[:-1]]

    n_words = np.diff(w.first)
    is_space = np.isin(w.raw, list(b" \t\n\x0b\x0c\r"))
    chars = per_row(_HEAD[w.raw] & ~is_space)
    runs = windows_hash(w.hash, 5)
    repeat, distinct, top, dup_lines, lines = (np.zeros(n, dtype=np.int64) for _ in range(5))
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
        if b > a:
            _, counts = np.unique(w.hash[a:b], return_counts=True)
            distinct[i], top[i] = len(counts), counts.max()
        if b - a > 5:
            _, which, counts = np.unique(runs[a : b - 4], return_inverse=True, return_counts=True)
            if len(counts) < len(which):
                cover = np.zeros(b - a + 1, dtype=np.int32)
                at = np.flatnonzero(counts[which] > 1)
                cover[at] += 1
                cover[at + 5] -= 1
                repeat[i] = np.count_nonzero(np.cumsum(cover))
    # Lines that have a word, by the hash of all their bytes.
    raw, total = w.raw, len(w.raw)
    if total:
        cut = np.union1d(np.flatnonzero(raw == 10) + 1, w.offsets[:-1][np.diff(w.offsets) > 0])
        start = np.union1d(cut, [0])
        start = start[start < total]
        row = np.searchsorted(w.offsets, start, side="right") - 1
        stop = np.minimum(np.append(start[1:], total), w.offsets[row + 1])
        stop = np.where((stop > start) & (raw[np.maximum(stop - 1, 0)] == 10), stop - 1, stop)
        has = np.searchsorted(w.start, stop) > np.searchsorted(w.start, start)
        start, stop, row = start[has], stop[has], row[has]
        h = spans_hash(raw, start, stop)
        lines = np.bincount(row, minlength=n)
        key = mix(h + row.astype(np.uint64) * U64(0xD6E8FEB86659FD93))
        _, once = np.unique(key, return_index=True)
        dup_lines = lines - np.bincount(row[once], minlength=n)
    counts = {"n_words": n_words, "word_chars": chars, "n_symbols": per_row(_SYMBOL[raw]), "n_dup_lines": dup_lines, "n_repeat_words": repeat}
    many = np.maximum(n_words, 1)
    some = np.maximum(per_row(~is_space), 1)
    features = [
        np.log1p(n_words), chars / many, counts["n_symbols"] / many, dup_lines / np.maximum(lines, 1), repeat / many, distinct / many, per_row(_UPPER[raw]) / some, per_row(_DIGIT[raw]) / some,
        per_row(_STOP[raw]) / many, per_row(_LETTER[raw]) / some, n_words / np.maximum(lines, 1), per_row(raw == ord("|")) / many, top / many, per_row(raw == ord("!")) / many,
    ]
    return counts, np.stack(features, axis=1).astype(np.float64)


def training_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, text, quality): the labelled documents of the smallest hashes of their ids, at most so many; conflicting labels count as bad,
    and of rows that share an id the least text is taken."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most `most` rows of two numbers: a bounded broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))


def fit(docs: DataFrame, labels: DataFrame) -> trees.Trees:
    schema = ", ".join(f"{f} double" for f in FEATURES) + ", quality int"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                _, x = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(x.shape[1])), part.column("quality").cast(pa.int32())], names=[*FEATURES, "quality"])

    rows = training_sample(docs, labels).select("text", "quality").mapInArrow(measure, schema).toPandas()
    rows = rows.sort_values(list(rows.columns), ignore_index=True)  # the model doesn't depend on the order of tasks
    return trees.fit(rows[FEATURES].to_numpy(float), (rows["quality"].to_numpy() > 0).astype(float), FALLING)


def scored(docs: DataFrame, model: trees.Trees) -> DataFrame:
    """doc_id, COUNTS, base_failed, quality_score and kept of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, quality_score double, kept boolean"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                counts, x = statistics(part.column("text"))
                failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
                p = shared.value.probability(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(p), pa.array(~failed & (p >= KEEP_FROM))],
                    names=["doc_id", *COUNTS, "base_failed", "quality_score", "kept"],
                )

    return docs.select("doc_id", "text").mapInArrow(score, schema)


def kept_documents(docs: DataFrame, model: trees.Trees) -> DataFrame:
    """The rows of docs that pass, with all their columns, in one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                counts, x = statistics(part.column("text"))
                failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
                yield part.filter(pa.array(~failed & (shared.value.probability(x) >= KEEP_FROM)))

    return docs.mapInArrow(keep, docs.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))

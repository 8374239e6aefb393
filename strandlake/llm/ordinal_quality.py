"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - w . x): hashed-text weights w are shared by all grades and the thresholds are ordered. x has the
presence of each hashed word, of the first 4, 5 and 6 bytes of each word, and of each hashed bucket of a document statistic. Grades come from the label columns: 0 poor,
1 good but toxic, 2 good. A score has the expected grade and the tail probability P(grade >= 2), by which documents are kept.

Null and empty texts have no words and are scored by their statistics; repeated rows each get a row; labels that
conflict count as the worst, and of rows that share a labelled id the least text is learned. Without labels all documents get the same score and are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import U64, Words, mix, pieces, table, words_of
from strandlake.llm.quality_rules import FEATURES, statistics

#: Labelled documents in the fit at most, hashed features, and the tail probability from which a document is kept.
SAMPLE, WIDTH, KEEP_FROM = 8000, 1 << 18, 0.5
GRADES = 3
#: Standard errors at which a feature counts half, and how steeply it counts less below.
SIGMA, POWER = 7.0, 4
#: Lengths of the heads of words that are features of their own: inflected words share them.
HEADS = (4, 5, 6)

_WORDS = np.frombuffer(bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(128)) + bytes(range(128, 256)), dtype=np.uint8)
#: Edges of the buckets of each statistic.
_EDGES = {
    "log_words": [2.4, 3.5, 5, 7], "mean_word_chars": [3, 5, 7, 9, 12], "symbols_per_word": [0.02, 0.1, 0.3, 1], "dup_line_share": [0.05, 0.2, 0.5], "repeat_share": [0.02, 0.1, 0.2, 0.5], "distinct_share": [0.1, 0.3, 0.5, 0.8],
    "upper_share": [0.1, 0.3, 0.6], "digit_share": [0.05, 0.2, 0.5], "bar_share": [0.02, 0.2, 0.5], "top_word_share": [0.1, 0.3, 0.6], "exclaim_per_word": [0.05, 0.3, 1],
}


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features, first): row i has the distinct hashed features first[i] .. first[i + 1] - 1."""
    low = pa.array([None if t is None else t.lower() for t in texts.to_pylist()], pa.large_utf8())
    raw_words = words_of(low, lower=False, codes=_WORDS)
    _, x = statistics(texts)
    n = len(texts)
    row = raw_words.row()
    buckets = []
    for name, edges in _EDGES.items():
        f = FEATURES.index(name)
        buckets.append(mix((np.digitize(x[:, f], edges) + 100 * f + 7).astype(np.uint64) * U64(0xA24BAED4963EE407)))
    heads, head_rows = _heads(raw_words, row)
    of_row = np.concatenate([row, *head_rows, np.tile(np.arange(n), len(buckets))])
    feature = np.concatenate([raw_words.hash, *heads, *buckets]) % U64(WIDTH)
    key = np.unique((of_row.astype(np.uint64) << U64(32)) | feature)
    return (key & U64(0xFFFFFFFF)).astype(np.int64), np.searchsorted(key >> U64(32), np.arange(n + 1))


def _heads(w: Words, row: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes of the words' first bytes, one array for each length, and the rows of the words that are so long."""
    if not len(w.start):
        return [], []
    value, found, rows = np.zeros(len(w.start), dtype=np.uint64), [], []
    for k in range(max(HEADS)):
        byte = w.raw[np.minimum(w.start + k, len(w.raw) - 1)].astype(np.uint64)
        value |= np.where(w.start + k < w.end, byte, U64(0)) << U64(8 * k)
        if k + 1 in HEADS:
            there = w.end - w.start > k
            found.append(mix(value[there] + U64(((k + 1) * 0xC2B2AE3D27D4EB4F) % (1 << 64))))
            rows.append(row[there])
    return found, rows


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, feature: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each row."""
        total = np.concatenate([[0], np.cumsum(self.weights[feature])])
        z = total[first[1:]] - total[first[:-1]]
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -40, 40)))


def strength(feature: np.ndarray, row: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """How much each feature counts, from 0 to 1, by the standard errors that its documents' grades deviate from the sample's at some
    level: its ridge penalty grows by the square of the inverse. Long texts hold thousands of words that say nothing, and with full
    weights they would drown a few that do; but no feature is cut, however rare."""
    n = np.bincount(feature, minlength=WIDTH)
    most = np.zeros(WIDTH)
    for level in range(GRADES - 1):
        above = (grade > level).astype(float)
        p = above.mean()
        z = (np.bincount(feature, above[row], WIDTH) - n * p) / np.sqrt(np.maximum(n * p * (1 - p), 1e-9))
        most = np.maximum(most, np.abs(z))
    return most**POWER / (most**POWER + SIGMA**POWER)


def link_loss(z: np.ndarray, theta: np.ndarray, grade: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(negative log-likelihood, its slopes along z, its slopes along theta), where P(grade = k) = s(theta_k - z) - s(theta_(k-1) - z) and s is
    the logistic function; theta beyond either end is infinite. share: weights of the rows."""
    below = 1 / (1 + np.exp(np.clip(z[:, None] - theta[None, :], -40, 40)))
    edges = np.column_stack([np.zeros(len(z)), below, np.ones(len(z))])
    rows = np.arange(len(z))
    low, high = edges[rows, grade], edges[rows, grade + 1]
    p = np.maximum(high - low, 1e-12)
    by_theta = np.zeros((len(z), len(theta) + 2))
    by_theta[rows, grade + 1] = -share * high * (1 - high) / p
    by_theta[rows, grade] += share * low * (1 - low) / p
    return float(-(share * np.log(p)).sum()), share * (1 - low - high), by_theta[:, 1:-1].sum(axis=0)


def fit(feature: np.ndarray, first: np.ndarray, grade: np.ndarray, steps: int = 200, rate: float = 0.15, ridge: float = 3e-4) -> Ordinal:
    """Full-batch Adam on the mean of link_loss with a ridge; the gaps between thresholds are exponentials and so stay positive."""
    w = np.zeros(WIDTH)
    cuts = np.array([-1.0, *np.zeros(GRADES - 2)])  # the first threshold, then logs of gaps
    if not len(grade):
        return Ordinal(w, np.array([-2.0, -1.0]))
    row = np.repeat(np.arange(len(grade)), np.diff(first))
    used = np.flatnonzero(np.bincount(feature, minlength=WIDTH))
    scale = strength(feature, row, grade)[used]
    place = np.zeros(WIDTH, dtype=np.int64)
    place[used] = np.arange(len(used))
    col = place[feature]
    v = np.zeros(len(used))
    state = [np.zeros(len(used) + len(cuts)) for _ in range(2)]
    share = 1 / np.maximum(np.bincount(grade, minlength=GRADES), 1)[grade] / GRADES  # rare grades count as much
    for k in range(1, steps + 1):
        z = np.bincount(row, (v * scale)[col], len(grade))
        _, slope, gt = link_loss(z, np.cumsum([cuts[0], *np.exp(cuts[1:])]), grade, share)
        gv = np.bincount(col, slope[row], len(used)) * scale + ridge * v
        gc = np.array([gt.sum(), *(gt[j:].sum() * np.exp(cuts[j]) for j in range(1, len(cuts)))])
        g = np.concatenate([gv, gc])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        move = rate * (state[0] / (1 - 0.9**k)) / (np.sqrt(state[1] / (1 - 0.99**k)) + 1e-8) * min(1, 2 * (1 - k / (steps + 1)))
        v, cuts = v - move[: len(used)], cuts - move[len(used) :]
    w[used] = v * scale
    return Ordinal(w, np.cumsum([cuts[0], *np.exp(cuts[1:])]))


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Ordinal:
    """Fitted on the labelled documents of the smallest hashes of their ids."""
    grade = F.when(F.col("quality") <= 0, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) > 0, 1).otherwise(2)
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(grade).alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `most` pairs of numbers are broadcast
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("grade").alias("grade"))  # one row an id

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                feature, first = hashed(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("grade").cast(pa.int32()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(feature, pa.int32()))], names=["doc_id", "grade", "feature"])

    found = rows.mapInArrow(measure, "doc_id bigint, grade int, feature array<int>").toArrow().sort_by("doc_id")
    lists = found.column("feature").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    first = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]).astype(np.int64) if len(found) else np.zeros(1, dtype=np.int64)
    return fit(np.asarray(lists.flatten(), dtype=np.int64), first, found.column("grade").to_numpy().astype(np.int64))


def scored(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, expected_grade (0 to 2), tail_probability and kept of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                tails = shared.value.tails(*hashed(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= KEEP_FROM)], names=["doc_id", "expected_grade", "tail_probability", "kept"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id bigint, expected_grade double, tail_probability double, kept boolean")


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, learn(docs, table(spark, sf_dir, "labels")))

"""Benchmark decontamination: SimHash fingerprints of item-sized windows, a multi-index of Hamming blocks, exact verification.

For each benchmark item, windows of the item's length slide over a document. A window and an item are fingerprinted by a
SimHash of BITS bits over their 5-word shingles, where the second, third ... occurrence of a shingle is a feature of its own: so the counts
weigh, all features weigh the same, and the weighted Jaccard similarity of the counts is the share of features in common. Fingerprints
within RADIUS bits agree, by pigeonhole, up to RADIUS // BLOCKS bits in one of
BLOCKS blocks; the item side lists every value within that many bits of each block, so a window finds all items within the
radius by one look-up a block. RADIUS is four standard deviations above the distance expected at the threshold. Candidates
are verified by exact weighted Jaccard similarity: the counts of shingles, least over greatest, at least 0.8.

Only windows that hold a shingle of some item are fingerprinted: others have similarity 0. Words are lower-cased (A-Z) runs of bytes other
than space and \\x09-\\x0D, without ASCII punctuation at their ends. Items of fewer words than a shingle are one shingle of all their words; items
without words match nothing. A benchmark is broadcast in blocks of at most BLOCK_ITEMS items and BLOCK_BYTES bytes, one after another, and all
documents are checked against each; a block's size is known before it is sent, and its hits are written before the next one is made. The number of
blocks doesn't change the result.

Null and empty texts are clean. Repeated items are reported under the least item_id; an item without an id counts, and is reported as null.
Every row of the documents gets a row, whatever ids they share or lack: hits are joined back by id and a hash of the text. Further columns
are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import IS_SPACE, LOWER, U64, mix, pieces, stored, table, text_buffer, windows_hash, words_of

SHINGLE, SIMILARITY = 5, 0.8
BITS, BLOCKS, RADIUS = 128, 16, 36
BLOCK_BITS, NEAR = BITS // BLOCKS, RADIUS // BLOCKS
BLOCK_ITEMS, BLOCK_BYTES = 2000, 8 << 20

_PUNCTUATION = np.isin(np.arange(256), [b for b in range(33, 127) if not chr(b).isalnum()])


def clean_words(texts: pa.Array):
    """Words with ASCII punctuation at their ends taken off, lower-cased; words of punctuation alone are none."""
    raw, offsets = text_buffer(texts)
    soft = _PUNCTUATION[raw] | IS_SPACE[raw]
    # Punctuation goes if only punctuation stands between it and a space or an end of the text.
    n = len(raw)
    if not n:
        return words_of(texts, lower=True)
    hard = ~soft
    place = np.arange(n)
    row_start = np.repeat(offsets[:-1], np.diff(offsets))
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    space = IS_SPACE[raw]
    last_hard = np.maximum.accumulate(np.where(hard, place, -1))
    last_space = np.maximum.accumulate(np.where(space, place, -1))
    next_hard = np.minimum.accumulate(np.where(hard, place, n)[::-1])[::-1]
    next_space = np.minimum.accumulate(np.where(space, place, n)[::-1])[::-1]
    before = np.maximum(last_space, row_start - 1) >= np.maximum(last_hard, row_start - 1)
    after = np.minimum(next_space, row_end) <= np.minimum(next_hard, row_end)
    edge = _PUNCTUATION[raw] & (before | after)
    out = np.where(edge, 32, LOWER[raw]).astype(np.uint8)
    strings = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())])
    return words_of(strings, lower=False)


def _bits(h: np.ndarray) -> np.ndarray:
    """BITS signs, +1 or -1, of each hash."""
    both = np.stack([mix(h ^ U64(0x1234567)), mix(h + U64(0x9876543))], axis=1)
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int16) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    """Block values, one byte each, of the signs of sums."""
    return np.packbits(sums > 0, axis=1)


@dataclass
class Items:
    """A block of benchmark items, ready to be looked up."""

    ids: list[int | None]
    lengths: np.ndarray
    shingles: list[np.ndarray]
    counts: list[np.ndarray]
    prints: np.ndarray
    #: The shingles of the items of each length, sorted.
    known: dict[int, np.ndarray]
    #: near[block][value]: the items of which that block's value is within NEAR bits.
    near: list[list[np.ndarray]]

    def matches(self, w) -> Iterator[tuple[int, int, float]]:
        """(row, item, similarity) of verified windows, the best of each row and item."""
        if not len(self.ids) or not len(w.hash):
            return
        row = w.row()
        begin, end = w.first[:-1][row], w.first[1:][row]
        place = np.arange(len(w.hash))
        for gram in range(1, SHINGLE + 1):
            sizes = [k for k in self.known if min(k, SHINGLE) == gram]
            runs = windows_hash(w.hash, gram) if sizes else []
            if not len(runs):
                continue
            runs = runs if gram == SHINGLE else mix(runs + U64(gram))
            known = np.unique(np.concatenate([self.known[k] for k in sizes]))
            at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
            hits = np.flatnonzero((known[at] == runs) & (place[: len(runs)] + gram <= end[: len(runs)]))
            for size in sizes:
                mine = hits[np.isin(runs[hits], self.known[size])]
                if not len(mine):
                    continue
                # Windows of this size that hold a hit; a shorter text is one window.
                low = np.maximum(mine - (size - gram), begin[mine])
                starts = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(low.tolist(), mine.tolist())]))
                starts = starts[(starts + size <= end[starts]) | (starts == begin[starts])]
                yield from self._windows(runs, starts, np.minimum(starts + size, end[starts]) - gram + 1, row, np.flatnonzero(self.lengths == size))

    def _windows(self, runs, starts, stops, row, of_size) -> Iterator[tuple[int, int, float]]:
        wanted = np.zeros(len(self.ids), dtype=bool)
        wanted[of_size] = True
        repeats = _with_repeats(runs, int((stops - starts).max()))
        for begin in range(0, len(starts), 4000):
            a, b = starts[begin : begin + 4000], stops[begin : begin + 4000]
            used, base = _span_places(a, b)
            signs = np.zeros((len(used) + 1, BITS), dtype=np.int32)
            np.cumsum(_bits(runs[used]), axis=0, dtype=np.int32, out=signs[1:])
            sums = signs[base + (b - a)] - signs[base]
            again = np.flatnonzero(repeats[a] & (b - a > 1))
            for at in range(0, len(again), 500):
                _number_repeats(sums, again[at : at + 500], runs, a, b)
            prints = _pack(sums)
            candidates: set[tuple[int, int]] = set()
            for block in range(BLOCKS):
                values, which = np.unique(prints[:, block], return_inverse=True)
                for v, value in enumerate(values.tolist()):
                    items = self.near[block][value]
                    items = items[wanted[items]]
                    if len(items):
                        windows = np.flatnonzero(which == v)
                        distance = np.bitwise_count(prints[windows][:, None, :] ^ self.prints[items][None, :, :]).sum(axis=2)
                        i, j = np.nonzero(distance <= RADIUS)
                        candidates.update(zip(windows[i].tolist(), items[j].tolist()))
            best: dict[tuple[int, int], float] = {}
            for window, item in candidates:
                s = self.similarity(runs[a[window] : b[window]], item)
                key = (int(row[a[window]]), item)
                if s >= SIMILARITY and s > best.get(key, 0):
                    best[key] = s
            for (r, item), s in best.items():
                yield r, item, s

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Exact weighted Jaccard of the shingle counts."""
        values, counts = np.unique(window, return_counts=True)
        at = np.searchsorted(self.shingles[item], values)
        at = np.minimum(at, len(self.shingles[item]) - 1)
        least = np.minimum(counts, self.counts[item][at])[self.shingles[item][at] == values].sum()
        return float(least / (counts.sum() + self.counts[item].sum() - least))


def _with_repeats(runs: np.ndarray, size: int) -> np.ndarray:
    """For each place whether a shingle occurs twice among the next `size` ones (of any row, so at least where a window repeats one)."""
    order = np.argsort(runs, kind="stable")
    same = np.flatnonzero(runs[order][1:] == runs[order][:-1])
    one, two = order[same], order[same + 1]
    near = two - one < size
    low, high = np.maximum(two[near] - size + 1, 0), one[near] + 1
    n = len(runs) + 1
    return np.cumsum(np.bincount(low, minlength=n) - np.bincount(high, minlength=n)) > 0


def features(shingles: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """A hash for each occurrence of a shingle; the first one's is the shingle's own."""
    return np.where(occurrence == 0, shingles, mix(shingles + occurrence.astype(np.uint64) * U64(0xC2B2AE3D27D4EB4F)))


def _number_repeats(sums: np.ndarray, which: np.ndarray, runs: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Corrects the sums of windows with repeats: all occurrences of a shingle but the first become features of their own."""
    size = b[which] - a[which]
    window = np.repeat(which, size)
    place = np.repeat(a[which] - np.cumsum(size) + size, size) + np.arange(size.sum())
    order = np.lexsort((runs[place], window))
    window, shingle = window[order], runs[place][order]
    new = np.ones(len(window), dtype=bool)
    new[1:] = (window[1:] != window[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.arange(len(window))
    occurrence = at - np.maximum.accumulate(np.where(new, at, 0))
    later = np.flatnonzero(occurrence > 0)
    for k in range(0, len(later), 50_000):
        part = later[k : k + 50_000]
        change = _bits(features(shingle[part], occurrence[part])) - _bits(shingle[part])
        first = np.flatnonzero(np.concatenate([[True], window[part][1:] != window[part][:-1]]))
        sums[window[part][first]] += np.add.reduceat(change.astype(np.int32), first, axis=0)


def _span_places(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places that the windows a .. b cover, and where each window starts among them. a is sorted."""
    cover = np.zeros(int(b.max()) - int(a[0]) + 1, dtype=np.int32)
    np.add.at(cover, a - a[0], 1)
    np.add.at(cover, b - a[0], -1)
    used = np.flatnonzero(np.cumsum(cover) > 0)
    return used + a[0], np.searchsorted(used, a - a[0])


def index(ids: list[int | None], texts: list[str | None]) -> Items:
    w = clean_words(pa.array(texts, pa.large_utf8()))
    keep, lengths, shingles, counts, prints = [], [], [], [], []
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
        if b == a:
            continue
        gram = min(b - a, SHINGLE)
        runs = windows_hash(w.hash[a:b], gram)
        runs = runs if gram == SHINGLE else mix(runs + U64(gram))
        values, n = np.unique(runs, return_counts=True)
        keep.append(ids[i])
        lengths.append(b - a)
        shingles.append(values)
        counts.append(n)
        expanded = features(np.repeat(values, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        prints.append(_pack(_bits(expanded).sum(axis=0, dtype=np.int32)[None, :])[0])
    prints = np.array(prints, dtype=np.uint8).reshape(-1, BLOCKS)
    distance = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
    near = [[np.flatnonzero(distance[value, prints[:, block]] <= NEAR) for value in range(256)] for block in range(BLOCKS)]
    known = {size: np.unique(np.concatenate([x for x, n in zip(shingles, lengths) if n == size])) for size in sorted(set(lengths))}
    return Items(keep, np.array(lengths, dtype=np.int64), shingles, counts, prints, known, near)


def item_blocks(benchmark: DataFrame) -> Iterator[tuple[list[int | None], list[str]]]:
    """Distinct items in blocks of a bounded size, by item_id; one item larger than a block is a block of its own."""
    items = benchmark.where("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id")).orderBy(F.asc_nulls_last("item_id"), "text")
    ids, texts, size = [], [], 0
    for r in items.toLocalIterator():  # one partition at a time, in place of the whole benchmark
        if ids and (len(ids) >= BLOCK_ITEMS or size + len(r["text"]) > BLOCK_BYTES):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"])
    if ids:
        yield ids, texts


HIT = "_hit_id bigint, _hit_text bigint, item_id bigint, similarity double"


def _hits(docs: DataFrame, items: Items) -> DataFrame:
    """Contaminated documents with their most similar item of a block."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value.ids
        rank = lambda item, s: (s, ids[item] is not None, -(ids[item] or 0))
        for batch in batches:
            for part in pieces(batch, "text"):
                best: dict[int, tuple[int, float]] = {}
                for row, item, s in shared.value.matches(clean_words(part.column("text"))):
                    if row not in best or rank(item, s) > rank(*best[row]):
                        best[row] = (item, s)
                if best:
                    at = pa.array(list(best), pa.int64())
                    found = [pa.array([ids[i] for i, _ in best.values()], pa.int64()), pa.array([s for _, s in best.values()])]
                    yield pa.RecordBatch.from_arrays([part.column("_hit_id").take(at), part.column("_hit_text").take(at), *found], names=["_hit_id", "_hit_text", "item_id", "similarity"])

    return docs.select(F.col("doc_id").cast("bigint").alias("_hit_id"), F.xxhash64("text").alias("_hit_text"), "text").mapInArrow(find, HIT)


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The most similar item of each contaminated (id, hash of the text). One pass over the documents a block; each block's hits are written."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], HIT)
    for block in item_blocks(benchmark):
        found = found.union(stored(_hits(docs, index(*block)), spark))
    best = F.max_by(F.struct("item_id", "similarity"), F.struct("similarity", F.col("item_id").isNotNull(), -F.coalesce("item_id", F.lit(0))))
    return stored(found.groupBy("_hit_id", "_hit_text").agg(best.alias("_hit")), spark)


def _same(docs: DataFrame, found: DataFrame):
    return docs["doc_id"].eqNullSafe(found["_hit_id"]) & (F.xxhash64(docs["text"]) == found["_hit_text"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_id and similarity of the most similar item (null and 0 if clean) of each document."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = hits(docs, benchmark)
    # Spark broadcasts the hits if their file is small; else it splits the rows of an id that very many rows share.
    joined = docs.join(found, _same(docs, found), "left")
    return joined.select("doc_id", F.col("_hit").isNotNull().alias("contaminated"), F.col("_hit.item_id").alias("item_id"), F.coalesce("_hit.similarity", F.lit(0.0)).alias("similarity"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a benchmark passage, with all their columns."""
    found = hits(docs, benchmark)
    return docs.join(found, _same(docs, found), "left_anti").select(*docs.columns)


def op2_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

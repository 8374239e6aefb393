"""Suffix-array dedup: removes every byte covered by a 200-byte string that also starts elsewhere in the corpus.

Suffixes are sampled at the anchors of anchors.py, which any repeated 200-byte string has at equal places, and sorted by hashes of
the 64 bytes at their head and of their whole context, in place of their texts (see the README). One scan of the sorted suffixes settles
those whose whole context occurs again: they are covered whole. Suffixes that share a head but not the
context are compared byte by byte: of their contexts, every 200-byte string around the anchor is looked up among the others. A head with
more than GROUP contexts (the edge of a passage that very many documents share) is beyond one task: its 200-byte strings are
dealt one by one by their hashes instead, after each task has settled those that are equal.

IndexFamily keeps the sorted suffixes of earlier batches in levels: a new batch is sorted and scanned with them, and levels of
like size are merged. The query is its first batch: all documents at once.

Bytes are judged on the input. Null and empty texts have none. Rows that share id and text count as one text, with a row each; rows without an id, or
of an id with several texts, are told apart by their texts. Other columns are passed by.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import anchors
from strandlake.llm.common import ORDER_CODE, U64, loads, mix, pieces, shared_dir, spans_hash, stored, table, text_buffer

WINDOW, GRAM = 200, 64
LEFT = WINDOW - GRAM
PIECE = 1 << 20

#: Suffixes that share a head and are compared in one task at most.
GROUP = 1000
#: Rows that meet: a context; the hash of one window of a head with too many contexts, alone or with copies in its batch; a window with copies.
CONTEXT, WINDOW_ALONE, WINDOW_COPIED, WINDOW_KNOWN = 0, 1, 2, 3


def doubled(h: np.ndarray, width: int, level: int) -> np.ndarray:
    """Hashes of runs of twice the width, from those of runs of `width`."""
    n = max(len(h) - width, 0)
    return mix(h[:n] * ORDER_CODE[level] + h[width : width + n])


def runs_hash(raw: np.ndarray, doublings: int) -> np.ndarray:
    """Hash of the 8 << doublings bytes from each place on that has so many: a tree over eight bytes at a time."""
    h = mix(loads(raw)[: max(len(raw) - 7, 0)])
    for level in range(doublings):
        h = doubled(h, 8 << level, level)
    return h


def windows_hash(raw: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW = 128 + 64 + 8 bytes from each place on that has so many."""
    n = max(len(raw) - WINDOW + 1, 0)
    eight = runs_hash(raw, 0)
    h64 = doubled(doubled(doubled(eight, 8, 0), 16, 1), 32, 2)
    return mix(doubled(h64, 64, 3)[:n] * ORDER_CODE[20] + h64[128 : 128 + n] * ORDER_CODE[21] + eight[192 : 192 + n])


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", PIECE):
            raw, offsets = text_buffer(part.column("text"))
            n = len(raw)
            if n < WINDOW:
                continue
            gram = np.zeros(n, dtype=np.uint64)
            gram[: n - GRAM + 1] = runs_hash(raw, 3)
            size = np.diff(offsets)
            left = np.repeat(offsets[1:], size) - np.arange(n)
            at = anchors.select(gram, left, WINDOW, GRAM)
            row = np.searchsorted(offsets, at, side="right") - 1
            low, high = np.maximum(at - LEFT, offsets[row]), np.minimum(at + WINDOW, offsets[row + 1])
            context = mix(spans_hash(raw, low, high) + (at - low).astype(np.uint64) * U64(1000003))
            doc, pos = part.column("doc_id").to_numpy()[row], at - offsets[row]
            # Of copies inside this piece one goes on; the others are covered, whatever is elsewhere.
            order, _, cls = anchors.combine(gram[at], context, doc, pos)
            fp, context, doc, pos = gram[at][order], context[order], doc[order], pos[order]
            which = np.cumsum(cls) - 1
            places = np.bincount(which, ~_same_place(doc, pos) | cls) if len(fp) else np.zeros(0)
            kind = np.where(cls, np.where(places[which] > 1, anchors.COPIED, anchors.ALONE), anchors.COVERED) if len(fp) else np.zeros(0, dtype=int)
            keep = cls | (places[which] > 1) if len(fp) else np.zeros(0, dtype=bool)
            key = np.where(kind == anchors.COVERED, anchors.spread_key(doc, pos), fp.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(context.view(np.int64)[keep]), pa.array(doc[keep]), pa.array(pos[keep].astype(np.int32)), pa.array(kind[keep].astype(np.int8))], names=["fp", "context", "doc_id", "pos", "kind"])


def _same_place(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    same = np.zeros(len(doc), dtype=bool)
    same[1:] = (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])
    return same


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with anchors to compare -> (fp, doc_id, pos, before, kind, body): the bytes of each context, `before` of them before the
    anchor, or each 200-byte string of it by its hash, with its start as pos."""
    names = ["fp", "doc_id", "pos", "before", "kind", "body"]
    for batch in batches:
        for begin in range(0, batch.num_rows, 200):
            part = batch.slice(begin, 200)
            raw, offsets = text_buffer(anchors.unpack(part.column("body")))
            ids = part.column("doc_id").to_numpy()
            lists = part.column("at")
            row = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
            at = lists.flatten()
            pos, fp, hot = at.field("pos").to_numpy().astype(np.int64), at.field("fp").to_numpy(), at.field("hot").to_numpy(zero_copy_only=False)
            place = pos + offsets[row]
            low, high = np.maximum(place - LEFT, offsets[row]), np.minimum(place + WINDOW, offsets[row + 1])
            whole, cold = raw.tobytes(), ~hot
            body = [whole[a:b] for a, b in zip(low[cold].tolist(), high[cold].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(fp[cold]), pa.array(ids[row[cold]]), pa.array(pos[cold].astype(np.int32)), pa.array((place - low)[cold].astype(np.int32)), pa.array(np.full(len(body), CONTEXT, np.int8)), pa.array(body, pa.binary())], names=names)
            if hot.any():
                count = np.maximum(high - WINDOW - low + 1, 0)[hot]
                start = np.unique(np.repeat(low[hot] - np.cumsum(count) + count, count) + np.arange(count.sum()))
                h = windows_hash(raw)[start]
                of = np.searchsorted(offsets, start, side="right") - 1
                doc, start = ids[of], start - offsets[of]
                order = np.lexsort((start, doc, h))
                doc, start, h = doc[order], start[order], h[order]
                new = np.concatenate([[True], h[1:] != h[:-1]])
                which = np.cumsum(new) - 1
                copied = (np.bincount(which, ~_same_place(doc, start) | new) > 1)[which]
                kind = np.where(new, np.where(copied, WINDOW_COPIED, WINDOW_ALONE), WINDOW_KNOWN)
                keep = new | copied
                key = np.where(new, h.view(np.int64), anchors.spread_key(doc, start))
                yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(doc[keep]), pa.array(start[keep].astype(np.int32)), pa.array(np.zeros(keep.sum(), np.int32)), pa.array(kind[keep].astype(np.int8)), pa.nulls(int(keep.sum()), pa.binary())], names=names)


def compare(fp: np.ndarray, before: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts with their heads -> (found, most, least): whether a 200-byte string around the anchor is in another context of the same head,
    and the most and least bytes that such strings have before the anchor. All of them hold the anchor, so their union is one span."""
    n = len(fp)
    after = np.diff(offsets) - before
    anchor = offsets[:-1] + before
    _, group = np.unique(fp, return_inverse=True)
    salt = mix(group.astype(np.uint64) + U64(99))
    h, eight = windows_hash(raw), loads(raw)
    found, most, least = np.zeros(n, dtype=bool), np.full(n, -1), np.full(n, LEFT + 1)
    for s in range(LEFT + 1):
        there = np.flatnonzero((before >= s) & (after >= WINDOW - s))
        if len(there) < 2:
            continue
        start = anchor[there] - s
        key = mix(h[start] + salt[there])
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order][1:] == key[order][:-1])
        # Neighbours of equal hashes are compared byte by byte.
        a, b = start[order[same]], start[order[same + 1]]
        for k in range(0, WINDOW, 8):
            equal = eight[a + k] == eight[b + k]
            if not equal.all():
                same, a, b = same[equal], a[equal], b[equal]
        hit = np.zeros(len(there), dtype=bool)
        hit[same] = hit[same + 1] = True
        at = there[order[hit]]
        found[at], most[at] = True, s
        least[at] = np.minimum(least[at], s)
    return found, most, least


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of a partition, sorted by fp, and windows, which come later -> (doc_id, low, high): bytes to remove."""

    def spans(doc, low, high) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=["doc_id", "low", "high"])

    def compared(rows: pa.Table) -> pa.RecordBatch:
        fp, doc, pos = (rows.column(c).to_numpy() for c in ("fp", "doc_id", "pos"))
        again = np.concatenate([[False], (fp[1:] == fp[:-1]) & (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])])  # equal rows are one text
        rows = rows.filter(pa.array(~again))
        raw, offsets = text_buffer(rows.column("body").combine_chunks().cast(pa.large_binary()))
        found, most, least = compare(rows.column("fp").to_numpy(), rows.column("before").to_numpy().astype(np.int64), raw, offsets)
        pos = rows.column("pos").to_numpy().astype(np.int64)
        return spans(rows.column("doc_id").to_numpy()[found], (pos - most)[found], (pos + WINDOW - least)[found])

    held, size, last = [], 0, None
    repeated: list[tuple[int, int]] = []
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        contexts = batch.slice(0, int(np.count_nonzero(kind == CONTEXT)))
        if contexts.num_rows:
            held.append(contexts)
            size += contexts.nbytes
            if size > 6 << 20:
                rows = pa.Table.from_batches(held)
                fp = rows.column("fp").to_numpy()
                other = np.flatnonzero(fp != fp[-1])
                if len(other):  # the last group may go on
                    cut = int(other[-1]) + 1
                    yield compared(rows.slice(0, cut))
                    held = rows.slice(cut).to_batches()
                    size = sum(b.nbytes for b in held)
        if contexts.num_rows < batch.num_rows:
            rest = batch.slice(contexts.num_rows)
            kind, h, doc, pos = (rest.column(c).to_numpy() for c in ("kind", "fp", "doc_id", "pos"))
            known = kind == WINDOW_KNOWN
            yield spans(doc[known], pos[known], pos[known] + WINDOW)
            kind, h, doc, pos = (x[~known] for x in (kind, h, doc, pos))
            # A group of equal windows may start in the batch before: its first window waits for a second one.
            for x, k, d, p in zip(h.tolist(), kind.tolist(), doc.tolist(), pos.tolist()):
                if last is not None and last[0] == x:
                    if (d, p) != last[1]:
                        if not last[2]:
                            repeated.append(last[1])
                        repeated.append((d, p))
                        last = (x, (d, p), True)
                else:
                    last = (x, (d, p), k == WINDOW_COPIED)
                    if k == WINDOW_COPIED:
                        repeated.append((d, p))
            if repeated:
                d, p = (np.array(c, dtype=np.int64) for c in zip(*repeated))
                yield spans(d, p, p + WINDOW)
                repeated.clear()
    if held:
        rows = pa.Table.from_batches(held)
        if rows.num_rows > 1:
            yield compared(rows)


def _apply(with_bytes: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                raw, offsets = text_buffer(anchors.unpack(part.column("body")))
                n = np.diff(offsets)
                lists = part.column("spans")
                row = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
                spans = lists.flatten()
                low = np.clip(spans.field("low").to_numpy(), 0, n[row]) + offsets[row]
                high = np.clip(spans.field("high").to_numpy(), 0, n[row]) + offsets[row]
                cover = np.bincount(low, minlength=len(raw) + 1).astype(np.int64) - np.bincount(high, minlength=len(raw) + 1)
                gone = np.cumsum(cover)[:-1] > 0
                starts = gone.copy()
                starts[1:] &= ~gone[:-1]
                full = offsets[:-1][n > 0]
                starts[full] = gone[full]  # a span ends with its document
                removed, runs, kept = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(starts)]), raw[~gone].tobytes()
                at = offsets - removed[offsets]
                bodies = [kept[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                columns = [part.column("id"), pa.array(n), pa.array(np.diff(removed[offsets]), pa.int64()), pa.array(np.diff(runs[offsets]), pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(bodies, pa.binary())] if with_bytes else [])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_bytes])

    return apply


def _spans(rows: DataFrame, packed: DataFrame, spark: SparkSession) -> DataFrame:
    """(doc_id, low, high) of what repeats among suffix rows of texts that `packed` has."""
    hits = stored(anchors.decided(rows, first_too=True), spark)
    edges = hits.where(F.col("kind") == anchors.EDGE).select("doc_id", "pos", "fp")
    places = anchors.with_hot(edges, GROUP).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "fp", "hot")).alias("at"))
    contexts = packed.join(places, "doc_id").select("doc_id", "body", "at").mapInArrow(_contexts, "fp bigint, doc_id bigint, pos int, before int, kind tinyint, body binary")
    order = F.when(F.col("kind") == CONTEXT, 0).otherwise(1)
    compared = contexts.repartition("fp").sortWithinPartitions(order, "fp", F.desc("kind"), "doc_id", "pos").mapInArrow(_compare, "doc_id bigint, low int, high int")
    return hits.where(F.col("kind") == anchors.WHOLE).select("doc_id", (F.col("pos") - LEFT).alias("low"), (F.col("pos") + WINDOW).alias("high")).union(compared)


def without_repeated_strings(docs: DataFrame, spark: SparkSession, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document; with_bytes adds the bytes that stay."""
    docs = anchors.keyed(docs, spark)
    packed = anchors.bodies(docs)
    # As many spans as the document has anchors at most.
    spans = _spans(docs.select("doc_id", "text").mapInArrow(_suffix_rows, anchors.ROWS), packed, spark).groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    full = packed.join(spans, "doc_id", "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<low: int, high: int>>)")))
    return full.select("id", "body", "spans").mapInArrow(_apply(with_bytes), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_bytes)


class IndexFamily:
    """Levels of suffixes of earlier batches in a folder that driver and executors share. A new batch's suffixes are sorted in with those of all levels
    and scanned for what repeats; then they are a level of their own, and levels of like size are merged into one sorted level."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/strandlake/family-{uuid.uuid4().hex}"
        #: (folder, suffixes) of each level, the oldest and largest first.
        self.levels: list[tuple[str, int]] = []

    def _write(self, rows: DataFrame, packed: DataFrame) -> tuple[str, int]:
        at = f"{self.path}/{uuid.uuid4().hex}"
        rows.repartitionByRange("fp", "context").sortWithinPartitions("fp", "context", "doc_id", "pos").write.parquet(f"{at}/suffixes")
        packed.write.parquet(f"{at}/texts")
        return at, self.spark.read.parquet(f"{at}/suffixes").count()

    def _read(self, at: str) -> tuple[DataFrame, DataFrame]:
        return self.spark.read.schema(anchors.ROWS).parquet(f"{at}/suffixes"), self.spark.read.schema("doc_id bigint, id bigint, body binary").parquet(f"{at}/texts")

    def add(self, docs: DataFrame) -> DataFrame:
        """(doc_id, low, high): bytes of the batch's and of earlier documents that repeat, now that the batch is there. Ids must not repeat
        between batches, nor be null."""
        docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("doc_id").cast("bigint").alias("id"), "text")
        new = self._write(docs.select("doc_id", "text").mapInArrow(_suffix_rows, anchors.ROWS), anchors.bodies(docs))
        rows, packed = self._read(new[0])
        heads = stored(rows.where(F.col("kind") != anchors.COVERED).select("fp").distinct(), self.spark)
        for at, _ in self.levels:
            older, texts = self._read(at)
            rows = rows.unionByName(older.where(F.col("kind") != anchors.COVERED).join(heads, "fp", "left_semi"))
            packed = packed.unionByName(texts)
        found = stored(_spans(rows, packed, self.spark), self.spark)
        self.levels.append(new)
        while len(self.levels) > 1 and self.levels[-2][1] <= 2 * self.levels[-1][1]:
            (a, b), (c, d) = self._read(self.levels[-2][0]), self._read(self.levels[-1][0])
            self.levels[-2:] = [self._write(a.unionByName(c), b.unionByName(d))]
        return found


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_strings(table(spark, sf_dir, "documents"), spark)

"""Substring dedup by suffix automata: removes every word covered by a 20-word window that occurred earlier.

Earlier is a smaller doc_id, or the same document and an earlier start. Anchors (anchors.py) find where windows can repeat. Of
anchors with one context only the first occurrence stays undecided: later ones are covered whole. For each anchor with
several contexts, the first occurrences of the contexts are the reference: in the order of the corpus each is streamed
through the suffix automaton of those before it, whose matching statistics show the windows that occurred earlier, and then joins it.

The reference holds the corpus' repeated passages and grows with it, so its automata are not broadcast: the shuffle by
anchor deals the reference out in shards, and documents' passages meet the automaton of their shard there. An anchor with more
than SHARD_CONTEXTS contexts (the edge of a passage that very many documents share) is beyond one task: its windows are dealt
one by one by their hashes instead, after each task has kept the earliest of those that are equal.

Null and empty texts have no words. Rows without an id come before all others, in the order of a hash of their texts, and so do rows that
share an id but not the text. Rows that share id and text count as one text, with a row each; other columns are passed by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import anchors
from strandlake.llm.automata import SuffixAutomaton
from strandlake.llm.common import U64, chain_hash, mix, pieces, stored, table, windows_hash, words_of

WINDOW, GRAM = 20, 5
LEFT = WINDOW - GRAM
#: Contexts of an anchor in one automaton at most.
SHARD_CONTEXTS = 1000

#: Rows that meet: a context; the hash of one window of an anchor with too many contexts; a window that is known to have occurred earlier.
CONTEXT, SINGLE, KNOWN = 0, 1, 2


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            w = words_of(part.column("text"), lower=False)
            n = len(w.hash)
            row = w.row()
            begin, end = w.first[:-1][row], w.first[1:][row]
            gram = np.zeros(n, dtype=np.uint64)
            runs = windows_hash(w.hash, GRAM)
            gram[: len(runs)] = runs
            at = anchors.select(gram, end - np.arange(n), WINDOW, GRAM)
            low, high = np.maximum(at - LEFT, begin[at]), np.minimum(at + WINDOW, end[at])
            context = mix(chain_hash(w.hash, low, high) + (at - low).astype(np.uint64) * U64(1000003))
            doc, pos = part.column("doc_id").to_numpy()[row[at]], at - begin[at]
            # Copies inside this piece: all but the first occurrence of a context are decided here and don't meet the others.
            order, _, cls = anchors.combine(gram[at], context, doc, pos)
            doc, pos = doc[order], pos[order]
            first = cls | _same_place(doc, pos)
            key = np.where(first, gram[at][order].view(np.int64), anchors.spread_key(doc, pos))
            kind = np.where(first, anchors.ALONE, anchors.COVERED).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(context[order].view(np.int64)), pa.array(doc), pa.array(pos.astype(np.int32)), pa.array(kind)], names=["fp", "context", "doc_id", "pos", "kind"])


def _same_place(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    same = np.zeros(len(doc), dtype=bool)
    same[1:] = (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])
    return same


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their boundary anchors -> (fp, doc_id, start, kind, body): each context's words, or its windows one by one."""
    names = ["fp", "doc_id", "start", "kind", "body"]
    for batch in batches:
        for begin in range(0, batch.num_rows, 500):
            part = batch.slice(begin, 500)
            w = words_of(anchors.unpack(part.column("body")), lower=False)
            ids = part.column("doc_id").to_numpy()
            lists = part.column("at")
            size = np.asarray(lists.value_lengths())
            at = lists.flatten()
            row = np.repeat(np.arange(part.num_rows), size)
            pos, fp, hot = at.field("pos").to_numpy().astype(np.int64), at.field("fp").to_numpy(), at.field("hot").to_numpy(zero_copy_only=False)
            first, last = w.first[:-1][row], w.first[1:][row]
            low, high = np.maximum(first + pos - LEFT, first), np.minimum(first + pos + WINDOW, last)
            raw = w.raw.tobytes()
            cold = ~hot
            body = [raw[x:y] for x, y in zip(w.start[low[cold]].tolist(), w.end[high[cold] - 1].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(fp[cold]), pa.array(ids[row[cold]]), pa.array((low - first)[cold].astype(np.int32)), pa.array(np.full(len(body), CONTEXT, np.int8)), pa.array(body, pa.binary())], names=names)
            if hot.any():
                runs = windows_hash(w.hash, WINDOW)
                count = np.maximum(high - WINDOW - low + 1, 0)[hot]
                place = np.unique(np.repeat(low[hot] - np.cumsum(count) + count, count) + np.arange(count.sum()))
                word_row = w.row()
                doc, start, h = ids[word_row[place]], place - w.first[:-1][word_row[place]], runs[place]
                order = np.lexsort((start, doc, h))
                doc, start, h = doc[order], start[order], h[order]
                earliest = np.concatenate([[True], h[1:] != h[:-1]]) | _same_place(doc, start)
                key = np.where(earliest, h.view(np.int64), anchors.spread_key(doc, start))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(start.astype(np.int32)), pa.array(np.where(earliest, SINGLE, KNOWN).astype(np.int8)), pa.nulls(len(key), pa.binary())], names=names)


def earlier_windows(segments: list[tuple[int, list[int]]], size: int) -> Iterator[tuple[int, int, int]]:
    """segments: (name, words) in order. Yields (segment, from, to) for the words covered by windows that occurred earlier.

    A generalised suffix automaton is built word by word; before a word joins, the longest suffix ending with it that occurs
    among all earlier words is found (it may overlap itself), and size words or more are a window that occurred earlier."""
    known = SuffixAutomaton()
    step, link, length = known.step, known.link, known.length
    for name, words in segments:
        last = state = matched = 0
        span_from = span_to = -1
        for i, c in enumerate(words):
            while state and c not in step[state]:
                state = link[state]
                matched = length[state]
            if c in step[state]:
                state = step[state][c]
                matched += 1
            else:
                matched = 0
            if matched >= size:
                if i + 1 - size > span_to:
                    if span_to > 0:
                        yield name, span_from, span_to
                    span_from = i + 1 - size
                span_to = i + 1
            last = known.add(last, c)
            while state and matched <= length[link[state]]:  # a split state keeps only its longer strings
                state = link[state]
        if span_to > 0:
            yield name, span_from, span_to


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts and windows of a partition, sorted by kind, fp, doc_id, start -> (doc_id, low, high): words to remove."""

    def groups() -> Iterator[pa.Table]:
        rest, size = [], 0
        for batch in batches:
            rest.append(batch)
            size += batch.nbytes
            if size > 4 << 20:
                rows = pa.Table.from_batches(rest)
                fp = rows.column("fp").to_numpy()
                other = np.flatnonzero(fp != fp[-1])
                cut = int(other[-1]) + 1 if len(other) else 0  # the last group may go on
                if rows.column("kind")[-1].as_py() != CONTEXT:
                    cut = rows.num_rows  # windows need no more than their earliest
                if cut:
                    yield rows.slice(0, cut)
                    rest = rows.slice(cut).to_batches()
                    size = sum(b.nbytes for b in rest)
        if rest:
            yield pa.Table.from_batches(rest)

    before = None  # the earliest of the last group of windows
    for rows in groups():
        kind, fp, doc, start = (rows.column(c).to_numpy() for c in ("kind", "fp", "doc_id", "start"))
        start = start.astype(np.int64)
        found: list[tuple[int, int, int]] = [(d, s, s + WINDOW) for d, s in zip(doc[kind == KNOWN].tolist(), start[kind == KNOWN].tolist())]
        single = np.flatnonzero(kind == SINGLE)
        for h, d, s in zip(fp[single].tolist(), doc[single].tolist(), start[single].tolist()):
            if before is None or before[0] != h:
                before = (h, d, s)
            elif before[1:] != (d, s):
                found.append((d, s, s + WINDOW))
        there = np.flatnonzero(kind == CONTEXT)
        if len(there):
            fp, doc, start = fp[there], doc[there], start[there]
            w = words_of(rows.column("body").combine_chunks().take(pa.array(there)).cast(pa.large_binary()), lower=False)
            bounds = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1], [True]]))
            word_lists, firsts = w.hash.tolist(), w.first.tolist()
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                # Overlapping contexts of one document are one segment, so that no window is taken for an earlier copy of itself.
                segments: list[tuple[int, list[int]]] = []
                base: list[tuple[int, int]] = []
                for i in range(a, b):
                    words, d, s = word_lists[firsts[i] : firsts[i + 1]], int(doc[i]), int(start[i])
                    if base and base[-1][0] == d and s <= (reach := base[-1][1] + len(segments[-1][1])):
                        segments[-1][1].extend(words[reach - s :])
                    else:
                        base.append((d, s))
                        segments.append((len(segments), words))
                found += [(base[s][0], base[s][1] + x, base[s][1] + y) for s, x, y in earlier_windows(segments, WINDOW)]
        if found:
            d, x, y = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(x, pa.int32()), pa.array(y, pa.int32())], names=["doc_id", "low", "high"])


def _apply(with_text: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                w = words_of(anchors.unpack(part.column("body")), lower=False)
                n = np.diff(w.first)
                lists = part.column("spans")
                row = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
                spans = lists.flatten()
                low = np.minimum(np.maximum(spans.field("low").to_numpy(), 0), n[row]) + w.first[:-1][row]
                high = np.minimum(spans.field("high").to_numpy(), n[row]) + w.first[:-1][row]
                cover = np.bincount(low, minlength=len(w.hash) + 1).astype(np.int64) - np.bincount(high, minlength=len(w.hash) + 1)
                kept = np.cumsum(cover)[:-1] <= 0
                raw, counts, texts = w.raw.tobytes(), [], []
                keep_row = w.row()[kept]
                pieces_kept = [raw[a:b] for a, b in zip(w.start[kept].tolist(), w.end[kept].tolist())]
                cuts = np.searchsorted(keep_row, np.arange(part.num_rows + 1)).tolist()
                for i in range(part.num_rows):
                    counts.append(int(n[i]) - (cuts[i + 1] - cuts[i]))
                    texts.append(b" ".join(pieces_kept[cuts[i] : cuts[i + 1]]))
                columns = [part.column("id"), pa.array(n.astype(np.int64)), pa.array(counts, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array([t.decode() for t in texts])] if with_text else [])], names=["doc_id", "n_words", "n_removed", "kept_sha256", *["text"] * with_text])

    return apply


def without_earlier_windows(docs: DataFrame, spark: SparkSession, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document; with_text adds the words that stay, joined by spaces."""
    docs = anchors.keyed(docs, spark)
    hits = stored(anchors.decided(docs.select("doc_id", "text").mapInArrow(_anchor_rows, anchors.ROWS), first_too=False), spark)
    packed = anchors.bodies(docs)
    edges = hits.where(F.col("kind") == anchors.EDGE).select("doc_id", "pos", "fp")
    places = anchors.with_hot(edges, SHARD_CONTEXTS).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "fp", "hot")).alias("at"))
    contexts = packed.join(places, "doc_id").select("doc_id", "body", "at").mapInArrow(_contexts, "fp bigint, doc_id bigint, start int, kind tinyint, body binary")
    matched = contexts.repartition("fp").sortWithinPartitions("kind", "fp", "doc_id", "start").mapInArrow(_match, "doc_id bigint, low int, high int")
    whole = hits.where(F.col("kind") == anchors.WHOLE).select("doc_id", (F.col("pos") - LEFT).alias("low"), (F.col("pos") + WINDOW).alias("high"))
    # As many spans as the document has anchors and windows at most.
    spans = whole.union(matched).groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    full = packed.join(spans, "doc_id", "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<low: int, high: int>>)")))
    return full.select("id", "body", "spans").mapInArrow(_apply(with_text), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", text string" * with_text)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_earlier_windows(table(spark, sf_dir, "documents"), spark)

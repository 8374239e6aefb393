"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of its labelled text recognises every substring of the sample.
A text is parsed greedily into longest matches; c phrases over n symbols against a sample of N symbols estimate the
cross-entropy c * log2(N) / n, and the language with the least wins. Automata are dense transition tables, and numpy walks
all blocks of a piece of texts against all languages in step. Blocks of one text are first parsed as if each began a phrase; then the parse
from the true state at a block's start is followed until it meets the other one, so counts are those of one parse of the whole text.

The sample of a language: of at most SAMPLE_DOCS labelled rows, short ones first (up to LONG characters), then by a hash of the id, whole texts as
long as they make SAMPLE_CHARS characters together; the first one always counts. Every language that has labelled text is learned; automata are
broadcast for at most AT_ONCE languages, more of them in one pass over the documents each.

Texts that are null or have no letter are `und` with score 0. Without labelled text every row is `und`. Ties go to the
language with more sample symbols, then by name. Repeated rows each get a row and count once as samples; rows that share an id or have none are
told apart by their texts (a row without an id isn't learned from). Other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.automata import SuffixAutomaton
from strandlake.llm.common import pieces, stored, table, text_buffer

#: The sample of each language: labelled rows and characters at most, and from how many characters on a text is taken only for want of others.
SAMPLE_DOCS, SAMPLE_CHARS, LONG = 120, 40_000, 8000
#: Languages whose automata are broadcast at once.
AT_ONCE = 8
BLOCK = 1024

_LETTER = np.isin(np.arange(256), [*range(97, 123), *range(128, 256)])


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the lower-cased texts: letters stay, each run of other characters becomes one space."""
    raw, offsets = text_buffer(pc.utf8_lower(texts))
    if not len(raw):
        return raw, offsets
    letter = _LETTER[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    out = np.where(letter, raw, 32)[keep]
    return out.astype(np.uint8), np.concatenate([[0], np.cumsum(keep)])[offsets]


@dataclass
class Model:
    languages: list[str]
    sizes: np.ndarray
    code: np.ndarray
    #: Entry state * width + symbol: the next state times 4, plus the phrases that end: one before the symbol, one with it if no sample has it.
    moves: np.ndarray
    starts: np.ndarray
    width: int

    def phrases(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(phrases for each row and language, symbols of each row)."""
        raw, offsets = symbols(texts)
        n, count = np.diff(offsets), np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        blocks = -(-n // BLOCK)
        row = np.repeat(np.arange(len(n)), blocks)
        if not len(row):
            return count, n
        nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = offsets[:-1][row] + nth * BLOCK
        size = np.minimum(BLOCK, offsets[1:][row] - start)
        order = np.argsort(-size, kind="stable")  # long blocks first, so that those still open are a prefix
        coded = self.code[raw].astype(np.int64)
        entry = np.repeat(self.starts[:, None], len(row), axis=1)
        state, ended = entry.copy(), np.zeros(entry.shape, dtype=np.int32)
        open_at = np.searchsorted(-size[order], -np.arange(BLOCK), side="left")
        first = start[order]
        for i in range(int(size.max())):
            m = int(open_at[i])
            move = self.moves[state[:, :m] * self.width + coded[first[:m] + i]]
            ended[:, :m] += move & 3
            state[:, :m] = move >> 2
        back = np.argsort(order)
        state, ended = state[:, back], ended[:, back]
        # A block's parse goes on where the one before it ended.
        while True:
            true = entry.copy()
            true[:, 1:] = np.where(nth[1:] > 0, state[:, :-1], entry[:, 1:])
            k, at = np.nonzero(true != entry)
            if not len(k):
                break
            one, two, change = entry[k, at], true[k, at], np.zeros(len(k), dtype=np.int32)
            live, i = np.arange(len(k)), 0
            while len(live):
                symbol = coded[start[at[live]] + i]
                x, y = self.moves[one[live] * self.width + symbol], self.moves[two[live] * self.width + symbol]
                change[live] += (y & 3) - (x & 3)
                one[live], two[live] = x >> 2, y >> 2
                i += 1
                live = live[(one[live] != two[live]) & (i < size[at[live]])]
            ended[k, at] += change
            other = one != two
            state[k[other], at[other]] = two[other]
            entry = true
        last = np.append(row[1:] != row[:-1], True)
        ended += (state != self.starts[:, None]) & last[None, :]  # a phrase still open
        for k in range(len(self.languages)):
            count[:, k] = np.bincount(row, ended[k], len(n))
        return count, n


def build(samples: dict[str, np.ndarray]) -> Model:
    """samples: each language's symbols, parts ended by 0."""
    languages = sorted(samples, key=lambda x: (-len(samples[x]), x))
    used = np.unique(np.concatenate([*samples.values(), np.array([32], dtype=np.uint8)]))
    used = used[used != 0]
    code = np.full(256, len(used), dtype=np.uint8)  # a symbol that no sample has always ends a phrase
    code[used] = np.arange(len(used))
    width, tables, starts = len(used) + 1, [], []
    for x in languages:
        automaton, last = SuffixAutomaton(), 0
        for s in samples[x].tolist():
            last = automaton.add(last, int(code[s])) if s else 0
        step = automaton.step
        at = sum(len(t) for t in tables)
        moves = np.full((len(step), width), -1, dtype=np.int64)
        for s, row in enumerate(step):
            if row:
                moves[s, list(row)] = list(row.values())
        root = np.where(moves[0] >= 0, moves[0], 0)
        ends = np.where(moves >= 0, 0, np.where(moves[0] >= 0, 1, 2))
        ends[0] = moves[0] < 0
        tables.append((np.where(moves >= 0, moves + at, root + at) * 4 + ends).astype(np.int32))
        starts.append(at)
    return Model(languages, np.array([len(samples[x]) for x in languages]), code, np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32), np.array(starts, dtype=np.int64), width)


def learn(docs: DataFrame) -> list[Model]:
    """From text and lang of documents that aren't held out: models of at most AT_ONCE languages each."""
    spark = docs.sparkSession
    key = [F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.xxhash64("text").alias("_text")]
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(*key, F.char_length("text").alias("_n"))
    by_lang = Window.partitionBy("_lang").orderBy(F.col("_n") > LONG, F.xxhash64("_id"), "_id", "_text")
    # Spark keeps SAMPLE_DOCS rows of a language in each task before it shuffles them.
    ranked = known.withColumn("_place", F.row_number().over(by_lang)).where(F.col("_place") <= SAMPLE_DOCS)
    total = F.sum("_n").over(by_lang.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Written, so that Spark knows its size: SAMPLE_DOCS rows of a few numbers for a language.
    chosen = stored(ranked.withColumn("_total", total).where((F.col("_total") <= SAMPLE_CHARS) | (F.col("_place") == 1)).drop("_n", "_total"), spark)
    texts = stored(docs.select(*key, "text").join(chosen, ["_id", "_lang", "_text"]).select("_lang", "_place", "_id", "_text", "text"), spark)
    names = sorted(r[0] for r in texts.select("_lang").distinct().collect())
    samples = []
    for at in range(0, len(names), AT_ONCE):
        found: dict[str, dict[tuple, str]] = {}
        for r in texts.where(F.col("_lang").isin(names[at : at + AT_ONCE])).toArrow().to_pylist():  # AT_ONCE times SAMPLE_CHARS characters
            of = found.setdefault(r["_lang"], {})
            same = (r["_id"], r["_text"])
            of[same] = min(of.get(same, (r["_place"], r["text"])), (r["_place"], r["text"]))
        part = {}
        for x, rows in found.items():
            raw, offsets = symbols(pa.array([t for _, t in sorted(rows.values())], pa.string()))
            joined = np.concatenate([np.append(raw[a:b], 0) for a, b in zip(offsets[:-1], offsets[1:])]).astype(np.uint8)
            if (joined != 0).any():
                part[x] = joined
        samples.append(build(part))
    return [m for m in samples if m.languages] or [build({})]


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _predictor(model: Model, rest: list[str]):
    """Batches -> the columns `rest`, lettered, and for each row of text the best language with its entropy, sample size, and the second
    best entropy (infinite if the model has one language)."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array([*m.languages, None], dtype=object)
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = part.column("text")
                lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False)
                count, n = m.phrases(texts)
                entropy = np.column_stack([count * np.log2(m.sizes + 1) / np.maximum(n, 1)[:, None], np.full((len(n), 2), np.inf)])
                best = np.argmin(entropy, axis=1)
                two = np.partition(entropy, 1, axis=1)
                sizes = np.append(m.sizes, [0, 0])[best]
                found = [pa.array(names[np.minimum(best, len(m.languages))], pa.string()), pa.array(two[:, 0]), pa.array(sizes, pa.int64()), pa.array(two[:, 1])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), lettered, *found], names=[*rest, "lettered", "best", "entropy", "size", "second"])

    return predict


_PREDICTED = "lettered boolean, best string, entropy double, size bigint, second double"


def predicted(docs: DataFrame, models: list[Model]) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document. The score is 1 less the best entropy over the second best."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    shared = [spark.sparkContext.broadcast(m) for m in models]  # at most AT_ONCE automata of a sample's size each
    if len(shared) == 1:
        found = rows.mapInArrow(_predictor(shared[0], ["doc_id"]), f"doc_id bigint, {_PREDICTED}")
    else:  # each pass gives the best two of its languages; equal rows have equal results
        keyed = rows.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), "text")
        parts = [stored(keyed.mapInArrow(_predictor(m, ["_id", "_text"]), f"_id bigint, _text bigint, {_PREDICTED}").distinct(), spark) for m in shared]
        two = reduce(DataFrame.unionByName, parts).groupBy("_id", "_text").agg(F.first("lettered").alias("lettered"), F.sort_array(F.collect_list(F.struct("entropy", (-F.col("size")).alias("_s"), "best", "second"))).alias("_all"))
        second = F.array_min(F.transform("_all", lambda x, i: F.when(i == 0, x["second"]).otherwise(x["entropy"])))
        two = stored(two.select("_id", "_text", "lettered", F.get("_all", F.lit(0))["best"].alias("best"), F.get("_all", F.lit(0))["entropy"].alias("entropy"), second.alias("second")), spark)
        found = rows.join(two, rows["doc_id"].eqNullSafe(two["_id"]) & (F.xxhash64(rows["text"]) == two["_text"]))
    score = F.when(F.col("second") == float("inf"), 1.0).otherwise(1 - F.col("entropy") / F.greatest("second", F.lit(1e-12)))
    told = F.col("lettered") & F.col("best").isNotNull()
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.when(told, F.col("best")).otherwise("und").alias("lang_pred"), F.when(told, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))).otherwise(0.0).alias("score"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, learn(docs))

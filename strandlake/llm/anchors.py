"""Content-chosen anchors of fixed-size windows, and what passes between the two substring operators.

A window of `window` units (words or bytes) holds window - gram + 1 runs of `gram` units; its anchors are those with the least hash.
Equal windows have equal anchors at equal places, so all occurrences of a window meet under the hash of its anchor, while only
about one unit in (window - gram) / 2 is an anchor. An anchor's context reaches as far as any window that holds the anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import U64, mix, pieces, stored

#: Where the keys of texts without an id of their own begin.
FIRST_ID = -(1 << 63)


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of x[i : i + width]; shorter runs at the end."""
    op = np.minimum if least else np.maximum
    out, have = x.copy(), 1
    while 2 * have <= width:
        if have < len(out):
            out[: len(out) - have] = op(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    if 0 < rest < len(out):
        out[: len(out) - rest] = op(out[: len(out) - rest], out[rest:])
    return out


def select(gram_hash: np.ndarray, left: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Places of the anchors. gram_hash[i] is of units i .. i + gram - 1; left[i] units are left in the text from i on."""
    n = len(gram_hash)
    if not n:
        return np.zeros(0, dtype=np.int64)
    width = window - gram + 1
    order = (gram_hash >> U64(32)).astype(np.uint32)
    np.maximum(order, 1, out=order)
    least = _slide(order, width, True)
    least[left < window] = 0  # no whole window starts here
    most = _slide(least[::-1].copy(), width, False)[::-1]
    return np.flatnonzero((most == order) & (left >= gram))


def combine(fp: np.ndarray, context: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts a group of equal fp, starts a class of equal fp and context) for rows sorted by fp, context, doc, pos."""
    order = np.lexsort((pos, doc, context, fp))
    a, b = fp[order], context[order]
    group = np.ones(len(order), dtype=bool)
    group[1:] = a[1:] != a[:-1]
    cls = group.copy()
    cls[1:] |= b[1:] != b[:-1]
    return order, group, cls


#: What a row of anchors says: an anchor alone; one that is settled in its task, covered whole; one that has copies, which were settled there.
ALONE, COVERED, COPIED = 0, 1, 2
#: What is decided of an anchor: its context occurs elsewhere (earlier) whole; other contexts of the same run are to be compared with its own.
WHOLE, EDGE = 1, 2
ROWS = "fp bigint, context bigint, doc_id bigint, pos int, kind tinyint"
DECIDED = "fp bigint, doc_id bigint, pos int, kind tinyint"


def scan(batches: Iterator[pa.RecordBatch], first_too: bool) -> Iterator[pa.RecordBatch]:
    """ROWS sorted by fp, context, doc_id, pos -> DECIDED, in one pass that holds a batch and one row, however many rows share a run.

    All but the first of a context's places are WHOLE, and with first_too the first as well where there are others. Firsts of contexts whose
    run has other contexts are EDGE. Rows of one place are one."""
    held = None  # the first place of the last context: (fp, context, doc, pos, has copies, its run has other contexts)

    def out(fp, doc, pos, kind) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array(doc, pa.int64()), pa.array(pos, pa.int32()), pa.array(np.full(len(doc), kind), pa.int8())], names=["fp", "doc_id", "pos", "kind"])

    for batch in batches:
        fp, context, doc, pos, kind = (batch.column(c).to_numpy() for c in ("fp", "context", "doc_id", "pos", "kind"))
        done = kind == COVERED
        yield out(fp[done], doc[done], pos[done], WHOLE)
        if done.all():
            continue
        fp, context, doc, pos, copied = fp[~done], context[~done], doc[~done], pos[~done], kind[~done] == COPIED
        paired = np.zeros(len(fp), dtype=bool)
        if held is not None:
            fp, context, doc, pos, copied, paired = (np.concatenate([np.array([h], dtype=x.dtype), x]) for h, x in zip(held, (fp, context, doc, pos, copied, paired)))
        group = np.concatenate([[True], fp[1:] != fp[:-1]])
        cls = group | np.concatenate([[True], context[1:] != context[:-1]])
        real = cls | np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])])
        of_cls, of_group = np.cumsum(cls) - 1, np.cumsum(group) - 1
        copied = (np.bincount(of_cls, copied) > 0) | (np.bincount(of_cls, real) > 1)
        paired = ((np.bincount(of_group, cls) > 1) | (np.bincount(of_group, paired) > 0))[of_group]
        more = real & ~cls
        yield out(fp[more], doc[more], pos[more], WHOLE)
        first = np.flatnonzero(cls)
        last = first[-1]
        held = (fp[last], context[last], doc[last], pos[last], copied[-1], paired[last])
        first, copied = first[:-1], copied[:-1]
        if first_too:
            yield out(fp[first[copied]], doc[first[copied]], pos[first[copied]], WHOLE)
        edge = first[paired[first]]
        yield out(fp[edge], doc[edge], pos[edge], EDGE)
    if held is not None:
        fp, _, doc, pos, copied, paired = held
        for kind in [WHOLE] * (first_too and bool(copied)) + [EDGE] * bool(paired):
            yield out([fp], [doc], [pos], kind)


def decided(rows: DataFrame, first_too: bool) -> DataFrame:
    """ROWS -> DECIDED. Spark deals them by the hash of the run and sorts them, on disk where they are many."""
    dealt = rows.repartition("fp").sortWithinPartitions("fp", "context", "doc_id", "pos")
    return dealt.mapInArrow(partial(scan, first_too=first_too), DECIDED)


def keyed(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """(doc_id, id, text), where doc_id tells texts apart and id is the row's own. Rows without an id, and rows that share one but not the text, get
    a hash of id and text that lies before all ids (those under FIRST_ID + 2 ** 61 are taken for it); equal rows are one text."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    h = F.xxhash64("text")
    shared = docs.where("id is not null").groupBy("id").agg(F.min(h).alias("_a"), F.max(h).alias("_b")).where("_a <> _b").select("id", F.lit(True).alias("_shared"))
    shared = stored(shared, spark)  # Spark broadcasts them if their file is small
    own = F.lit(FIRST_ID) + F.xxhash64("id", "text").bitwiseAND(F.lit((1 << 61) - 1))
    return docs.join(shared, "id", "left").select(F.when(F.col("id").isNull() | F.col("_shared").isNotNull(), own).otherwise(F.col("id")).alias("doc_id"), "id", "text")


def with_hot(edges: DataFrame, most: int) -> DataFrame:
    """edges with a column hot: its fp has more than so many rows. There are few such values, at most one for each `most` rows; they
    are written first, so that Spark knows their size: it broadcasts them if they are small, and else splits the large side."""
    many = stored(edges.groupBy("fp").count().where(F.col("count") > most).select("fp", F.lit(True).alias("hot")), edges.sparkSession)
    return edges.join(many, "fp", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))


def bodies(docs: DataFrame) -> DataFrame:
    """(doc_id, id, body): texts as zstd frames, so that a join moves less than half of their bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("id"), pa.array([press.compress((t or "").encode()) for t in part.column("text").to_pylist()], pa.binary())], names=["doc_id", "id", "body"])

    return docs.select("doc_id", "id", "text").mapInArrow(pack, "doc_id bigint, id bigint, body binary")


def unpack(column: pa.Array) -> pa.Array:
    press = zstandard.ZstdDecompressor()
    return pa.array([press.decompress(b.as_py()) for b in column], pa.large_binary())


def spread_key(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A key that deals rows evenly."""
    return mix(doc.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + pos.astype(np.uint64)).view(np.int64)

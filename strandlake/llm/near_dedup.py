"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature has minimum hashes of 8 bits, its symbols, in chunks. Two signatures that differ in at most
`radius` symbols have, by pigeonhole, a chunk that differs in at most radius // chunks = 1 symbol; so each chunk is indexed under
all keys that leave one symbol out, and every pair within the radius meets under a key. The radius is four standard deviations
above the expected distance at the threshold: a pair of just that similarity lies beyond it with probability below 1e-4. `layout`
derives it and the chunks from the threshold: 18 chunks of 7 symbols with radius 35 at 0.85, 27 of 6 with radius 53 at 0.8.

Links are confirmed on the full shingle sets. Rows of equal sets are one class with one member in the index. In a
key's bucket the members are first compared with the bucket's least member alone, its hub (a star). Then, for hubs whose
spokes are in several components, the spokes outside the hub's component are compared with all of the hub's spokes in
blocks of bounded size: first by their signatures, and those within the radius of a member of another component by their texts. A group of
copies is never expanded into rows of pairs, and no link between components is missed.

Null and empty texts, and texts without words, have empty sets, are linked with nothing and kept. A row without an id is linked with
nothing. Rows that share an id are kept or dropped together. Other columns of the input are passed by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import U64, mix, pieces, shingle_sets, stored, table, words_of
from strandlake.llm.graph import components

SHINGLE, PERCENT = 5, 85
#: Symbols of a signature at most: each is a row in the index.
MOST_SYMBOLS = 192


@dataclass(frozen=True)
class Layout:
    """Of signatures for pairs of at least so many per cent."""

    percent: int
    chunks: int
    per_chunk: int
    radius: int

    @property
    def symbols(self) -> int:
        return self.chunks * self.per_chunk


def layout(percent: int) -> Layout:
    """The longest chunks, and the fewest of them, for which one error a chunk covers the radius."""
    differ = 1 - percent / 100
    for per_chunk in range(8, 1, -1):
        for chunks in range(2, MOST_SYMBOLS // per_chunk + 1):
            n = chunks * per_chunk
            radius = math.ceil(n * differ + 4 * math.sqrt(n * differ * (1 - differ)))
            if radius < 2 * chunks:
                return Layout(percent, chunks, per_chunk, radius)
    raise ValueError(f"no signature of {MOST_SYMBOLS} symbols has a radius for {percent} %")


CHUNKS, PER_CHUNK, RADIUS = layout(PERCENT).chunks, layout(PERCENT).per_chunk, layout(PERCENT).radius
SYMBOLS = layout(PERCENT).symbols

_R = np.random.Generator(np.random.PCG64(77))
_MULTIPLY = (_R.integers(1, 1 << 31, MOST_SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_ADD = _R.integers(0, 1 << 32, MOST_SYMBOLS, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray, of: Layout) -> np.ndarray:
    """A number for each chunk, of 8 bits for each of its symbols."""
    x = (shingles >> U64(32)).astype(np.uint32)[None, :]
    low = np.full(of.symbols, 0xFFFFFFFF, dtype=np.uint32)
    multiply, add = _MULTIPLY[: of.symbols], _ADD[: of.symbols]
    for at in range(0, x.shape[1], 512):  # blocks that stay in the cache
        np.minimum(low, (x[:, at : at + 512] * multiply + add).min(axis=1), out=low)
    symbol = (mix(low.astype(np.uint64) + U64(1)) >> U64(56)).reshape(of.chunks, of.per_chunk)
    return (symbol << (U64(8) * np.arange(of.per_chunk, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def sketches(docs: DataFrame, of: Layout) -> DataFrame:
    """doc_id, n (size of the shingle set), two hashes of the whole set, and the signature."""
    schema = "doc_id bigint, n bigint, set_a bigint, set_b bigint, chunks array<bigint>"

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingle_sets(words_of(part.column("text"), lower=True), SHINGLE)
                rows = np.zeros((len(sets), 2 + of.chunks), dtype=np.uint64)
                for i, s in enumerate(sets):
                    if len(s):
                        rows[i, 0], rows[i, 1] = s.sum(dtype=np.uint64), mix(s + U64(12345)).sum(dtype=np.uint64)
                        rows[i, 2:] = signature(s, of)
                rows = rows.view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.array([len(s) for s in sets], dtype=np.int64)), pa.array(np.ascontiguousarray(rows[:, 0])), pa.array(np.ascontiguousarray(rows[:, 1])), pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * of.chunks, pa.array(rows[:, 2:].ravel()))], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(sketch, schema)


def index_rows(classes: DataFrame, of: Layout) -> DataFrame:
    """(key, rep): a row for each chunk and each left-out symbol."""
    keep = np.array([((1 << (8 * of.per_chunk)) - 1) ^ (0xFF << (8 * j)) for j in range(of.per_chunk)], dtype=np.uint64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.arange(of.symbols, dtype=np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                chunks = part.column("chunks").flatten().to_numpy().view(np.uint64).reshape(-1, of.chunks)
                masked = (chunks[:, :, None] & keep[None, None, :]).reshape(len(chunks), of.symbols)
                key = mix(mix(masked) + places[None, :] * U64(0x9E3779B97F4A7C15)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(part.column("rep").to_numpy(), of.symbols))], names=["key", "rep"])

    return classes.select("rep", "chunks").mapInArrow(spread, "key bigint, rep bigint")


def _differing() -> Column:
    """For each chunk a number with one bit set for each symbol in which the sides a and b differ."""

    def fold(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for shift in (4, 2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        return d.bitwiseAND(F.lit(0x0101010101010101))

    return F.zip_with("a.chunks", "b.chunks", fold)


def within_radius(of: Layout) -> Column:
    """Sizes allow the similarity and the signatures differ in at most `radius` symbols."""
    sizes = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * of.percent
    return sizes & (F.aggregate(_differing(), F.lit(0), lambda total, d: total + F.bit_count(d)) <= of.radius)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for part in pieces(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([press.compress((t or "").encode()) for t in part.column("text").to_pylist()], pa.binary())], names=["id", "body"])


def _sets(bodies: list[bytes]) -> list[np.ndarray]:
    press = zstandard.ZstdDecompressor()
    return shingle_sets(words_of(pa.array([press.decompress(b) for b in bodies], pa.large_binary()), lower=True), SHINGLE)


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            u, v = part.column("u").to_pylist(), part.column("v").to_pylist()
            bodies = dict(zip(v, part.column("v_body").to_pylist())) | dict(zip(u, part.column("u_body").to_pylist()))
            of = dict(zip(bodies, _sets(list(bodies.values()))))
            good = []
            for a, b in zip(u, v):
                x, y = of[a], of[b]
                both = len(x) + len(y) - len(np.union1d(x, y))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield part.select(["u", "v"]).filter(pa.array(good, pa.bool_()))


def confirmed(pairs: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(u, v) whose full shingle sets are similar enough. Texts travel compressed and each set is made anew."""
    full = pairs.join(bodies.select(F.col("id").alias("u"), F.col("body").alias("u_body")), "u").join(bodies.select(F.col("id").alias("v"), F.col("body").alias("v_body")), "v")
    return full.select("u", "v", "u_body", "v_body").mapInArrow(partial(_confirm, percent=percent), "u bigint, v bigint")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left and each right set, by products of 0/1 matrices over shared shingles."""
    sets = [*left, *right]
    element = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(element, kind="stable")
    element, row = element[order], row[order]
    new = np.concatenate([[True], element[1:] != element[:-1]])
    which = np.cumsum(new) - 1
    shared = np.bincount(which)[which] > 1
    _, which = np.unique(which[shared], return_inverse=True)
    row, total = row[shared], np.zeros((len(left), len(right)), dtype=np.float32)
    width = 2048
    for at in range(0, int(which.max()) + 1 if len(which) else 0, width):
        a, b = np.searchsorted(which, [at, at + width])
        block = np.zeros((len(sets), width), dtype=np.float32)
        block[row[a:b], which[a:b] - at] = 1
        total += block[: len(left)] @ block[len(left) :].T
    return total.astype(np.int64)


def _compare_blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hub, i, j -> links between components, as few as join all that are linked in a block."""

    def blocks() -> Iterator[list[tuple]]:
        now, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("hub", "i", "j", "stray", "id", "root", "body"))):
                if row[:3] != now:
                    if held:
                        yield held
                    now, held = row[:3], []
                held.append(row[3:])
        if held:
            yield held

    for rows in blocks():
        left, right = [r for r in rows if r[0]], [r for r in rows if not r[0]]
        if not left or len({r[2] for r in rows}) < 2:
            continue
        bodies = {r[1]: r[3] for r in rows}
        of = dict(zip(bodies, _sets(list(bodies.values()))))
        x, y = [of[r[1]] for r in left], [of[r[1]] for r in right]
        common = common_counts(x, y)
        sizes = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :]
        link = 100 * common >= percent * (sizes - common)
        link &= np.array([r[2] for r in left])[:, None] != np.array([r[2] for r in right])[None, :]
        parent: dict[int, int] = {}

        def find(a: int) -> int:
            while (b := parent.get(a, a)) != a:
                a = b
            return a

        out = []
        for i, j in zip(*(k.tolist() for k in np.nonzero(link))):
            a, b = find(left[i][2]), find(right[j][2])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((left[i][1], right[j][1]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])


#: A block holds about so many documents and shingles of either side at most.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 500_000


def _near_blocks(batches: Iterator[pa.RecordBatch], of: Layout) -> Iterator[pa.RecordBatch]:
    """Signatures sorted by hub, i, j -> the rows of each block that have a member of another component on the other side within the radius."""

    def close(rows: pa.Table) -> pa.RecordBatch | None:
        stray = rows.column("stray").to_numpy().astype(bool)
        n, root = (rows.column(c).to_numpy() for c in ("n", "root"))
        symbols = rows.column("chunks").combine_chunks().flatten().to_numpy().view(np.uint8).reshape(len(n), of.chunks, 8)[:, :, : of.per_chunk].reshape(len(n), -1)
        left, right = np.flatnonzero(stray), np.flatnonzero(~stray)
        good = np.zeros(len(n), dtype=bool)
        for at in range(0, len(left), 64):
            x = left[at : at + 64]
            small, big = np.minimum(n[x][:, None], n[right][None, :]), np.maximum(n[x][:, None], n[right][None, :])
            i, j = np.nonzero((100 * small >= of.percent * big) & (root[x][:, None] != root[right][None, :]))
            near = np.count_nonzero(symbols[x[i]] != symbols[right[j]], axis=1) <= of.radius
            good[x[i[near]]] = good[right[j[near]]] = True
        return rows.filter(pa.array(good)).select(["hub", "i", "j", "stray", "id", "root"]).combine_chunks().to_batches()[0] if good.any() else None

    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        hub, i, j = (batch.column(c).to_numpy() for c in ("hub", "i", "j"))
        cuts = np.flatnonzero((hub[1:] != hub[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            block = (hub[a], i[a], j[a]) if b > a else now
            if held and block != now:
                if (found := close(pa.Table.from_batches(held))) is not None:
                    yield found
                held = []
            now = block
            held.append(batch.slice(a, b - a))
    if held and (found := close(pa.Table.from_batches(held))) is not None:
        yield found


def between_components(spokes: DataFrame, roots: DataFrame, signed: DataFrame, bodies: DataFrame, of: Layout) -> DataFrame:
    """Links that the stars missed. Two members of a bucket are both spokes of its hub; so, for each hub whose spokes are in several
    components, those outside the hub's component are compared with all, in blocks of bounded size. Few rows leave a block.
    signed: (id, n, chunks)."""
    known = roots.select(F.col("node").alias("id"), F.col("root").alias("_r"))
    s = spokes.select(F.col("u").alias("id"), F.col("v").alias("hub"))
    s = s.join(known, "id", "left").withColumn("root", F.coalesce("_r", "id")).drop("_r")
    s = s.join(known.select(F.col("id").alias("hub"), F.col("_r").alias("_h")), "hub", "left").withColumn("outside", F.col("root") != F.coalesce("_h", "hub")).drop("_h")
    s = s.join(signed, "id")
    per = lambda docs, n: F.greatest(F.lit(1), F.ceil(docs / BLOCK_DOCS), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    outside = F.when(F.col("outside"), F.col("n"))
    hubs = s.groupBy("hub").agg(per(F.count(outside), F.sum(outside)).alias("ni"), per(F.count("n"), F.sum("n")).alias("nj"), F.count(outside).alias("strays"), F.count("n").alias("all"))
    # One member alone has nobody but the hub, with which it was compared. The hubs are written, so that Spark can split a hub's rows in the join.
    hubs = stored(hubs.where("strays > 0 and all > 1").select("hub", "ni", "nj"), spokes.sparkSession)
    s = s.join(hubs, "hub")
    at, rest = F.xxhash64("id"), ["id", "root", "n", "chunks"]
    left = s.where("outside").select("hub", F.pmod(at, F.col("ni")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), F.lit(True).alias("stray"), *rest)
    right = s.select("hub", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), F.pmod(at, F.col("nj")).cast("int").alias("j"), F.lit(False).alias("stray"), *rest)
    dealt = lambda rows: rows.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    near = stored(dealt(left.union(right)).mapInArrow(partial(_near_blocks, of=of), "hub bigint, i int, j int, stray boolean, id bigint, root bigint"), spokes.sparkSession)
    return dealt(near.join(bodies, "id")).mapInArrow(partial(_compare_blocks, percent=of.percent), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, spark: SparkSession, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), kept (doc_id = component_id) of each document. Links are
    pairs whose shingle sets have at least so many per cent of their union in common."""
    of = layout(percent)
    sketch = stored(sketches(docs, of), spark)
    same = ["n", "set_a", "set_b"]
    classes = stored(sketch.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("chunks").alias("chunks")), spark)
    # Every member of a bucket but the least, with that least member, its hub. Minima are pre-aggregated and written before they are joined
    # back, so that Spark can split the rows of a bucket with very many members.
    index = index_rows(classes, of)
    hubs = stored(index.groupBy("key").agg(F.min("rep").alias("v"), F.count("rep").alias("_n")).where("_n > 1").select("key", "v"), spark)
    spokes = stored(index.withColumnRenamed("rep", "u").join(hubs, "key").where("u <> v").select("u", "v").distinct(), spark)

    signed = classes.select("rep", "n", "chunks")
    bodies = stored(docs.select("doc_id", "text").mapInArrow(_packed, "id bigint, body binary"), spark)
    near = spokes.join(signed.alias("a"), F.col("u") == F.col("a.rep")).join(signed.alias("b"), F.col("v") == F.col("b.rep")).where(within_radius(of)).select("u", "v")
    links = stored(confirmed(near, bodies, percent), spark)
    roots = components(links, spark)
    more = stored(between_components(spokes, roots, signed.withColumnRenamed("rep", "id"), bodies, of), spark)
    if not more.isEmpty():
        roots = components(links.union(more), spark)

    member_of = sketch.where("n > 0 and doc_id is not null").select("doc_id", *same).join(classes.select(*same, "rep"), same).join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("doc_id", "n", F.coalesce("root", "rep").alias("component_id"))
    alone = sketch.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return member_of.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, spark: SparkSession, percent: int = PERCENT) -> DataFrame:
    """The kept rows of docs, with all their columns."""
    gone = near_duplicates(docs, spark, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), spark)

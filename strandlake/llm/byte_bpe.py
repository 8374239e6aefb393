"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside each partition.

A text is cut into pieces by the vocabulary's pattern. Each new distinct piece of a partition becomes token-position rows;
a recursive query joins neighbouring rows with the merge table and contracts every piece's leftmost pair of minimum rank
until no pair is left. Ids come back by an aggregation ordered by position. Results are kept for a bounded number of
pieces, so common ones are encoded once a worker. A document is decoded from its ids alone: they join the vocabulary, and an
aggregation ordered by position joins their bytes.

Nulls are empty texts: no ids, the hash of nothing. Repeated rows give repeated results; other columns are passed by.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import threading
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import pieces, table

#: Encoded pieces that a worker keeps at most in each of two generations: those used since the last change, and those before.
KEPT_PIECES = 500_000
#: Pieces of more bytes are contracted with a heap: one round a merge would take quadratic time in the recursive query.
LONG_PIECE = 400
#: New pieces in one recursive query.
AT_ONCE = 40_000
#: Tokens in one decoding query.
TOKENS = 500_000
#: Bytes of text that are encoded at once.
PIECE = 3 << 20
#: Seconds after which a worker without a task gives its coder up.
IDLE_SECONDS = 2.0

ENCODE = """
WITH RECURSIVE state AS (
    SELECT k, t, true AS open FROM start
    UNION ALL
    SELECT k, CASE WHEN (k & 65535) = (best & 65535) THEN best >> 16 ELSE t END AS t, best IS NOT NULL AS open
    FROM (
        SELECT k, t, min(score) OVER (PARTITION BY k >> 16) AS best, lag(k) OVER (ORDER BY k) AS before
        FROM (
            SELECT k, t, (m.rank << 16) | (k & 65535) AS score
            FROM (
                SELECT k, t, CASE WHEN (lead(k) OVER (ORDER BY k)) >> 16 = k >> 16 THEN (t << 20) | lead(t) OVER (ORDER BY k) END AS pair
                FROM state WHERE open
            ) LEFT JOIN merges m USING (pair)
        )
    )
    WHERE best IS NULL OR NOT coalesce(before >> 16 = k >> 16 AND (before & 65535) = (best & 65535), false)
)
SELECT k >> 16 AS w, string_agg(t, ',' ORDER BY k) AS ids
FROM state
WHERE NOT open
GROUP BY w
"""

DECODE = """
SELECT doc, unhex(string_agg(v.bytes, '' ORDER BY place)) AS bytes
FROM tokens JOIN vocabulary v ON v.rank = id
GROUP BY doc
ORDER BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Coder:
    """Encodes and decodes; one for each worker process and vocabulary."""

    _made: dict[tuple[str, str], Coder] = {}
    _lock = threading.Lock()
    _users = 0
    _idle: threading.Timer | None = None

    @classmethod
    def of(cls, path: str, pattern: str) -> Coder:
        """The coder, in use until `rest`."""
        with cls._lock:
            cls._users += 1
            if cls._idle is not None:
                cls._idle.cancel()
            if (path, pattern) not in cls._made:
                cls._made[path, pattern] = cls(path, pattern)
            return cls._made[path, pattern]

    @classmethod
    def rest(cls) -> None:
        """After a task: if no other follows soon, the coders go, so that an idle worker doesn't hold memory that other stages need."""
        with cls._lock:
            cls._users -= 1
            if cls._idle is not None:
                cls._idle.cancel()
            cls._idle = threading.Timer(IDLE_SECONDS, cls.release)
            cls._idle.daemon = True
            cls._idle.start()

    @classmethod
    def release(cls) -> None:
        """A timer that fired while a task took the coder finds it in use."""
        with cls._lock:
            if cls._users:
                return
            for coder in cls._made.values():
                coder.db.close()
            cls._made.clear()
        gc.collect()

    def __init__(self, path: str, pattern: str):
        self.ranks, self.split = read_ranks(path), regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        ranks = self.ranks
        pairs = [((ranks[a] << 20) | ranks[b], r) for x, r in ranks.items() for i in range(1, len(x)) if (a := x[:i]) in ranks and (b := x[i:]) in ranks]
        self.load("merges", pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "rank": pa.array([r for _, r in pairs], pa.int64())}))
        self.load("vocabulary", pa.table({"rank": pa.array(list(ranks.values()), pa.int64()), "bytes": [x.hex() for x in ranks]}))

    def load(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def learn(self, new: list[str]) -> None:
        """Encodes pieces that aren't known yet."""
        rest = []
        for x in new:
            b = x.encode()
            if (r := self.ranks.get(b)) is not None:  # a piece that is a token is never cut
                self.known[x] = b"%d" % r
            elif len(b) > LONG_PIECE:
                self.known[x] = b",".join(b"%d" % i for i in self.contract(b))
            else:
                rest.append((x, b))
        for at in range(0, len(rest), AT_ONCE):
            part = rest[at : at + AT_ONCE]
            size = np.array([len(b) for _, b in part])
            first = np.cumsum(size) - size
            k = (np.repeat(np.arange(len(part)), size) << 16) | (np.arange(size.sum()) - np.repeat(first, size))
            t = self.of_byte[np.frombuffer(b"".join(b for _, b in part), dtype=np.uint8)]
            self.load("start", pa.table({"k": k, "t": t}))
            found = self.db.sql(ENCODE).to_arrow_table()
            for w, ids in zip(*(found.column(c).to_pylist() for c in ("w", "ids"))):
                self.known[part[w][0]] = ids.encode()

    def contract(self, b: bytes) -> list[int]:
        """The same contraction for one long piece: a heap of (rank, place) over a linked list of parts."""
        n, ranks = len(b), self.ranks
        after, before, end = [*range(1, n + 1)], [*range(-1, n - 1)], [*range(1, n + 1)]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(b[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray([1]) * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != stop or end[i] != j:
                continue
            alive[j], end[i], after[i] = 0, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(b[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(b[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return [ranks[b[i : end[i]]] for i in range(n) if alive[i]]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """For each text its ids, joined by commas."""
        cut = [self.split(x) if x else [] for x in texts]
        distinct = set().union(*cut)
        if len(self.known) + len(distinct) > KEPT_PIECES:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing = [x for x in distinct if x not in known]
        known.update((x, older[x]) for x in missing if x in older)
        self.learn([x for x in missing if x not in older])
        ids_of = self.known.__getitem__
        for x in cut:
            yield b",".join(map(ids_of, x))

    def decode(self, lists: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids. A query takes so many tokens at most; a longer list is put together from several."""
        out = [b""] * len(lists)
        size = np.array([len(x) for x in lists], dtype=np.int64)
        ids, doc = np.concatenate([*lists, np.zeros(0, dtype=np.int32)]), np.repeat(np.arange(len(lists)), size)
        for at in range(0, len(ids), TOKENS):
            part = slice(at, at + TOKENS)
            self.load("tokens", pa.table({"doc": doc[part], "place": np.arange(len(ids[part])), "id": ids[part].astype(np.int64)}))
            found = self.db.sql(DECODE).to_arrow_table()
            for d, b in zip(found.column("doc").to_pylist(), found.column("bytes").to_pylist()):
                out[d] += b
        return out


def encoded(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document's text; with_ids adds the ids."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path, pattern)
        try:
            for batch in batches:
                for part in pieces(batch, "text", PIECE):
                    yield encode_part(coder, part)
        finally:
            Coder.rest()

    def encode_part(coder: Coder, part: pa.RecordBatch) -> pa.RecordBatch:
        texts = list(coder.encode(part.column("text").to_pylist()))
        lists = [np.fromstring(x.decode(), dtype=np.int32, sep=",") if x else np.zeros(0, dtype=np.int32) for x in texts]
        rows = [(len(ids), hashlib.sha256(x).hexdigest(), hashlib.sha256(decoded).hexdigest(), *[ids] * with_ids) for x, ids, decoded in zip(texts, lists, coder.decode(lists))]
        columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())))]
        return pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *columns], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(encode, schema)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)

"""Shared folder, tables, and word arrays used by the text operators.

Word arrays: a column of texts is handled in pieces of a few megabytes; every piece becomes one byte buffer and numpy
arrays of word starts, ends and 64-bit word hashes, so that no Python code runs per word. What is equal has equal hashes; what differs
has with a probability of 2 ** -64 a pair, whatever its letters, as bytes pass a non-linear finaliser.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A buffer of texts is cut at about this many bytes; one longer text is still handled whole.
PIECE_BYTES = 1 << 20

#: Rows in an Arrow batch of texts.
ARROW_ROWS = 2000

U64 = np.uint64
#: Odd multipliers: one for chains of hashes, and one for each place of a run of words.
STEP = U64(0x9E3779B97F4A7C15)
ORDER_CODE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.isin(np.arange(256), list(SPACES))
LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 4096


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every output bit depends on every input bit."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def loads(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; places beyond the end hold zeros."""
    padded = np.zeros(len(raw) + 16, dtype=np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray(len(raw) + 8, "<u8", padded, strides=(1,))


def spans_hash(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes start .. stop - 1. Eight bytes at a time go through the finaliser, so that no relation between bytes (as
    the sums of a polynomial hash have) makes different runs equal."""
    size = (stop - start).astype(np.int64)
    h = mix(size.astype(np.uint64) * STEP + U64(0x5851F42D4C957F2D))
    eight = loads(raw)
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    done = 0
    while len(live):
        x = eight[start[live] + done]
        left = size[live] - done
        x = np.where(left < 8, x & ((U64(1) << (U64(8) * np.minimum(left, 7).astype(np.uint64))) - U64(1)), x)
        h[live] = mix((h[live] ^ x) * STEP)
        live = live[left > 8]
        done += 8
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : stop[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def chain_hash(h: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of each run of numbers h[low] .. h[high - 1], by the same chain."""
    out = mix((high - low).astype(np.uint64) * STEP + U64(0x14057B7EF767814F))
    live, done = np.flatnonzero(high > low), 0
    while len(live):
        out[live] = mix((out[live] ^ h[low[live] + done]) * STEP)
        done += 1
        live = live[high[live] - low[live] > done]
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset (tests), a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, spark: SparkSession) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_dir(spark)}/strandlake/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts. Arrow batches are kept small (texts are long), unless the session has a size of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_utf8()).fill_null("") if not pa.types.is_large_binary(texts.type) else texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    if not len(texts):
        return raw[:0], np.zeros(1, dtype=np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of at most about so many bytes of text each."""
    _, offsets = text_buffer(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


@dataclass
class Words:
    """The words of a piece of texts. Row i has the words first[i] .. first[i + 1] - 1."""

    raw: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(texts: pa.Array, lower: bool, codes: np.ndarray | None = None) -> Words:
    """Words are runs of bytes other than space and \\x09-\\x0D; lower: A-Z are lower-cased first. Equal words have equal hashes.
    codes: 256 bytes that stand for the bytes of the texts."""
    raw, offsets = text_buffer(texts)
    if lower or codes is not None:
        raw = (LOWER if codes is None else codes)[raw]
    n = len(raw)
    space = IS_SPACE[raw]
    begins, ends = np.empty(n + 1, dtype=bool), np.empty(n + 1, dtype=bool)
    begins[:n], begins[n:] = ~space, False
    begins[1:n] &= space[:-1]
    ends[0], ends[1:] = False, ~space
    ends[1:n] &= space[1:]
    # A text's first byte starts a word and its last one ends it, whatever the neighbouring text has there.
    full = offsets[:-1][np.diff(offsets) > 0]
    begins[full] |= ~space[full]
    last = offsets[1:][np.diff(offsets) > 0]
    ends[last] |= ~space[last - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    h = spans_hash(raw, start, end)
    return Words(raw, offsets, start, end, np.searchsorted(start, offsets), h)


def windows_hash(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of so many consecutive words; the array is size - 1 shorter. Runs that cross rows are the caller's to drop."""
    if len(h) < size:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for j in range(size):
        total += h[j : len(h) - size + 1 + j] * ORDER_CODE[j]
    return mix(total)


def shingle_sets(words: Words, size: int = 5) -> list[np.ndarray]:
    """Each row's distinct shingles, sorted; with fewer words than size, the whole sequence as one; none without words."""
    runs = windows_hash(words.hash, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(mix((words.hash[a:b] * ORDER_CODE[: b - a]).sum(keepdims=True) + ORDER_CODE[40 + b - a]))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out

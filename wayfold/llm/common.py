"""Pieces that several corpus operators share: scratch tables, byte-level tokenising and hashing."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------- scratch tables

_LIVE: dict[str, list[tuple[SparkSession, str]]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset a local session (tests) gets one
    of its own; on a cluster that is an error, as executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="wayfold-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir() or found
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str, owner: str = "query") -> str:
    """A new path in the shared folder; ``release(owner)`` or the end of the process deletes it."""
    path = f"{shared_dir(spark)}/wayfold/{tag}-{uuid.uuid4().hex}"
    if not _LIVE:
        atexit.register(lambda: [release(o) for o in list(_LIVE)])
    _LIVE.setdefault(owner, []).append((spark, path))
    return path


def release(owner: str) -> None:
    """Delete the scratch tables of ``owner``; their readers must have finished."""
    for spark, path in _LIVE.pop(owner, []):
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone at exit; its folder goes with it
            pass


def adopt(owner: str, by: str) -> None:
    """Make the scratch tables of ``owner`` those of ``by``."""
    if owner in _LIVE:
        _LIVE.setdefault(by, []).extend(_LIVE.pop(owner))


def table(df: DataFrame, tag: str, owner: str = "query", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, tag, owner)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    # shuffle files of what is written now go as soon as the driver collects their owners; else they stay until it happens to
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- text as bytes

#: ASCII space and the controls 0x09 to 0x0D part words; every other byte belongs to one.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII letters only, as in LOWER('A'..'Z'); other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SLICE_BYTES = 1 << 19


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and the offsets of each (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``limit`` bytes each; a longer text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of concatenated texts, and the bounds of each text among them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = SEPARATOR[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    after[-1], after[:-1] = True, gap[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = True
    after[edges - 1] = True
    np.logical_not(gap, out=gap)
    starts = np.flatnonzero(gap & before)
    return starts, np.flatnonzero(gap & after) + 1, np.searchsorted(starts, offsets)


# ---------------------------------------------------------------- hashing

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SYMBOL_BYTES = 8
_BASES = (0xD1342543DE82EF95, 0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x = x * _M2
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base modulo 2**64, and of its inverse."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[which] = (out[0], out[1])
    return have


def byte_symbols(data: np.ndarray) -> np.ndarray:
    """Every ``SYMBOL_BYTES`` consecutive bytes as a scrambled number (one to one)."""
    if len(data) < SYMBOL_BYTES:
        return np.zeros(0, np.uint64)
    return mix(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, SYMBOL_BYTES)).view("<u8")[:, 0] + np.uint64(_BASES[2]))


class Rolling:
    """Prefix sums of a polynomial hash: the hash of any span of ``width`` places or more in O(1).

    ``symbols`` are scrambled values of every ``width`` consecutive places. As they overlap, swapping two parts of a span
    changes symbols at the seams too: spans that a power-of-two modulus would confuse place by place (Thue-Morse words and
    their complements) don't cancel."""

    def __init__(self, symbols: np.ndarray, which: int = 0, width: int = 1):
        n, self.short = len(symbols), width - 1
        up, self.down = powers(which, n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbols * up[:n], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends - self.short] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words at ``starts`` to ``ends``: scrambled (byte, place in the word) values summed. Being no polynomial,
    it has no words that cancel for every base, as Thue-Morse words do modulo a power of two."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    x = np.ones(n, np.uint64)
    x[0] = 0
    x[starts[1:]] -= np.diff(starts).astype(np.uint64)
    x[starts[0]] -= np.uint64(starts[0])
    np.cumsum(x, out=x)  # place in the word, at its bytes
    x <<= np.uint64(8)
    x |= data
    x += np.uint64(0x9E3779B97F4A7C15)
    x *= _M1
    x ^= x >> np.uint64(32)
    x *= _M2
    x ^= x >> np.uint64(29)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(x, out=sums[1:])
    return mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64))


def chained(word: np.ndarray, length: int) -> np.ndarray:
    """Hashes of every ``length`` consecutive words (by their hashes), scrambled after each word."""
    n = len(word) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, length, np.uint64)
    for k in range(length):
        out *= _M1
        out += word[k : k + n]
        out = mix(out)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of ``counts`` members: each member's group, and its place in the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def file_system(uri: str):
    """The pyarrow file system of a URI or path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(work):
    """``work`` over Arrow batches, giving its memory back to the system at the end: Python workers outlive their tasks."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def trim() -> None:
    """Give unused memory back to the system."""
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Documents are long: pass fewer rows at a time to Python than Spark's default, unless the user has chosen."""
    for key, usual, ours in (("maxRecordsPerBatch", "10000", rows), ("maxBytesPerBatch", "67108864b", 32 << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, str(ours))

"""Shared parts: shared-folder tables, skew-safe joins, and a numpy word kernel over Arrow buffers."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argusledger.functions.tables import BROADCAST_ROWS, Shield, cut, drop_cut, partitions, scratch, shared_dir, skew_join, small

__all__ = ["BROADCAST_ROWS", "NOT_SPACE", "WORD", "Shield", "Words", "binary", "chunks", "crc32_sql", "cut", "drop_cut", "grams", "limit_batches", "mix64", "partitions", "process_cache", "read", "release", "runs", "row_key", "scratch", "shared_dir", "skew_join", "small", "text_bytes", "ws_trim_count"]

#: Bytes of text that one pass of the numpy kernel handles at once (a longer text is one chunk).
CHUNK_BYTES = (1 << 18) - 1


#: Rows and bytes of an Arrow batch, unless the session sets its own: texts can be long.
BATCH_ROWS, BATCH_BYTES = 256, 1 << 19


def limit_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows and about BATCH_BYTES at most (or one row)."""
    rows, size = (f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes"))
    if spark.conf.get(rows) == "10000":  # Spark's default
        spark.conf.set(rows, BATCH_ROWS)
    if spark.conf.get(size, None) is None:
        spark.conf.set(size, BATCH_BYTES)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    limit_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ws_trim_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def row_key(*columns: str | Column) -> list[Column]:
    """Two 64-bit hashes with different seeds, ``k1`` and ``k2``: rows equal in the columns have equal keys, and at 2e10 rows
    two different ones share both with a chance below 1e-17."""
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit("k2"), *reversed(columns)).alias("k2")]


def process_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, over tasks."""
    mod = sys.modules.setdefault("_argusledger_process_cache", types.ModuleType("_argusledger_process_cache"))
    return mod.__dict__.setdefault(name, {})


def release(keep: str = "") -> None:
    """Give back memory that this Python worker no longer uses: workers stay for later tasks.  What other kinds of tasks
    cached goes, but for the cache named ``keep``, and so do tables of powers that just a very long text needed."""
    import ctypes

    for name in {"encoders"}.difference([keep]):
        process_cache(name).clear()
    kept = process_cache("powers")
    for base in [b for b, pair in kept.items() if len(pair[0]) > CHUNK_BYTES + 1]:
        del kept[base]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


# --- word kernel -----------------------------------------------------------------------------

_SPACE = np.ones(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x61:0x7B] = _ALNUM[0x41:0x5B] = True
_ALNUM[0x80:] = True
#: Byte classes of words: ``[^\x20\x09-\x0D]+`` and, after lower-casing, runs of digits, letters and non-ASCII.
NOT_SPACE, WORD = _SPACE, _ALNUM
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BYTE = np.random.default_rng(20_240_229).integers(1, 2**64, 256, dtype=np.uint64)
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse power modulo 2**64, for i < n at least."""
    kept = process_cache("powers")  # not shipped with tasks
    have = kept.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            both.append(np.cumprod(a, dtype=np.uint64))
        have = kept[base] = (both[0], both[1])
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: none) and the offsets of each text in them."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(batch: pa.RecordBatch, column: str):
    """Slices of a batch with at most CHUNK_BYTES of text each, or one row."""
    raw_off = text_bytes(batch.column(column))[1]
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(raw_off, raw_off[at] + CHUNK_BYTES, "right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of all texts of a column: byte starts and ends, 64-bit hashes, and each text's word range."""

    __slots__ = ("ends", "hash", "off", "raw", "span", "starts")

    def __init__(self, arr: pa.Array, keep: np.ndarray, lower: bool, hashed: bool = True):
        raw, self.off = text_bytes(arr)
        self.raw = raw = _LOWER[raw] if lower else raw
        n = len(raw)
        inside = keep[raw]
        first = np.zeros(n + 1, bool)
        first[self.off] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = after[-1] = True
            np.logical_not(inside[:-1], out=before[1:])
            np.logical_not(inside[1:], out=after[:-1])
        self.starts = np.flatnonzero(inside & (before | first[:-1]))
        self.ends = np.flatnonzero(inside & (after | first[1:])) + 1
        self.span = np.searchsorted(self.starts, self.off)
        if hashed:
            up, down = powers(_P, n + 1)
            total = np.empty(n + 1, np.uint64)
            total[0] = 0
            np.cumsum(_BYTE[raw] * up[:n], out=total[1:])
            self.hash = mix64((total[self.ends] - total[self.starts]) * down[self.starts])

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; the last n-1 words start none.  Those that cross a
        text's end are in it too: see :meth:`whole`."""
        return grams(self.hash, n)

    def whole(self, n: int) -> np.ndarray:
        """For each gram, whether it lies in one text."""
        size = len(self.starts) - n + 1
        ok = np.zeros(max(size, 0) + 1, np.int32)
        if size <= 0:
            return ok[:0].astype(bool)
        lo, hi = self.span[:-1], self.span[1:] - n + 1
        some = hi > lo
        np.add.at(ok, lo[some], 1)
        np.add.at(ok, hi[some], -1)
        return np.cumsum(ok[:-1]) > 0


def grams(h: np.ndarray, n: int) -> np.ndarray:
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(_Q, len(h) + 1)
    total = np.empty(len(h) + 1, np.uint64)
    total[0] = 0
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix64((total[n:] - total[:size]) * down[:size])


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start, and the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def binary(parts) -> pa.Array:
    return pa.array(list(parts), pa.binary())


def crc32_sql(text: str) -> str:
    """DuckDB SQL of zlib's CRC-32, unsigned, of an ASCII text."""
    steps = f"flatten([[ascii(x)::bigint, 0, 0, 0, 0, 0, 0, 0] for x in string_split({text}, '')])"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {steps}), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)"

"""Helpers that several operators share: word hashing over whole batches, and written intermediates."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from brinework.sources.store import new_path, shared_dir, written

__all__ = ["new_path", "shared_dir", "written"]

#: Text bytes that are hashed at once; a longer document is one group of its own.
GROUP_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes of `[^\x20\x09-\x0D]+`.
SPACED = ~_SPACE
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower case.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 0x20
_CODE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_P = 0x9E3779B97F4A7C55
_P_INV = pow(_P, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_table(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, GROUP_BYTES + 4096)
        for k, base in enumerate((_P, _P_INV)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            _powers[k] = table
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: bytes, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of data (which starts and ends with a separator), and where each word starts and ends."""
    a = np.frombuffer(data, np.uint8)
    inside = word_bytes[a]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return a, edges[0::2], edges[1::2]


def hash_spans(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words in lower case (A-Z only): a polynomial over random byte codes, then a finaliser."""
    up, down = _power_table(len(a) + 1)
    sums = _CODE[a]
    sums *= up[: len(a)]
    np.cumsum(sums, out=sums)
    h = sums[ends - 1] - sums[starts - 1]
    h *= down[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def hashed_words(texts: list[bytes | None], word_bytes: np.ndarray = SPACED, group_bytes: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, hashes, bounds) for runs texts[first:last]; document i's words are hashes[bounds[i - first]:bounds[i - first + 1]]. Null counts as empty."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or b"") <= group_bytes):
            size += len(texts[last] or b"")
            last += 1
        run = [t or b"" for t in texts[first:last]]
        a, starts, ends = word_spans(b"\n" + b"\n".join(run) + b"\n", word_bytes)
        edges = np.cumsum([0, *(len(t) + 1 for t in run)])
        bounds = np.searchsorted(starts, edges)
        yield first, last, hash_spans(a, starts, ends) if len(starts) else np.zeros(0, np.uint64), bounds
        first = last


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


#: Gives freed memory back to the system, where the C library can.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def trimmed(run: Callable) -> Callable:
    """A mapInArrow function whose worker, which lives on when the task ends, gives back the memory that the task has freed."""

    def to_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _trim()

    return to_the_end


def trimmed_group(run: Callable) -> Callable:
    """The same for a function of applyInPandas, after each group."""

    def of_group(rows):
        out = run(rows)
        _trim()
        return out

    return of_group


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written by checkpoint() to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Helpers that several corpus operators share: inputs, lineage cuts, vectorised words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marketspark.operators.lineage import cut as cut

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte array and n + 1 offsets; null counts as empty."""
    column = column.fill_null("").cast(pa.large_binary())
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(buffers[2], dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with about `size` bytes of text each (one longer text stands alone)."""
    data, at = raw(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        last = min(last, batch.num_rows)
        yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words [^\\x20\\x09-\\x0D]+, A-Z in lower case: 64-bit hashes, row of each, and first word of each row (n + 1)."""
    n = len(at) - 1
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = at[:-1][at[:-1] < len(data)]
    begins[edges] = solid[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    where = np.flatnonzero(solid)
    first = np.searchsorted(where, starts)
    sizes = np.diff(np.append(first, len(where)))
    inside = np.arange(len(where)) - np.repeat(first, sizes)
    powers = np.full(int(sizes.max()), _BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    letters = (_LOWER[data[where]].astype(np.uint64) + np.uint64(1)) * powers[inside]
    row = np.searchsorted(at, starts, "right") - 1
    return mixed(np.add.reduceat(letters, first)), row, np.searchsorted(row, np.arange(n + 1))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h

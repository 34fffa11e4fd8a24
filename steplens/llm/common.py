"""What the text operators share: words of whole texts as numpy arrays, in batches of bounded size."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one step in a Python worker holds; a longer single text is still taken whole.
SLICE_BYTES = 2 << 20

#: The word separators of the contracts: space and U+0009 to U+000D.
SEPARATORS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SEPARATORS)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


#: Settings of Python workers: large arrays come from the system one by one and go back to it at once, so that a worker that waits for
#: its next task, and is not Spark's to count, holds little.
WORKER_ENV = {"MALLOC_MMAP_THRESHOLD_": str(2 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ship(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it, unless they find it otherwise."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each with about ``most`` bytes of ``column``."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(np.diff(_offsets(batch.column(column))))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _offsets(text: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    return np.frombuffer(text.buffers()[1], dtype=kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n + 1 offsets of the texts in them; null counts as empty."""
    if text.null_count:
        text = text.fill_null("")
    if not len(text):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = _offsets(text)
    data = text.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


@dataclass
class Words:
    """Words of a run of texts. ``joined`` has every word followed by one space; word i is joined[start[i]:end[i]] and
    begins at byte begin[i] of ``raw``; text t has the words first[t] to first[t + 1], the bytes offsets[t] to
    offsets[t + 1]."""

    joined: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    raw: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit polynomial hash of each word, mixed; used to choose and to sort, never as proof of equality."""
        return mix(span_hashes(self.joined, self.start, self.end))


def words(text: pa.Array, lower: bool = False) -> Words:
    raw, offsets = text_bytes(text)
    if lower:
        raw = _LOWER[raw]
    inside = _IS_WORD[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    begin, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    lengths = stop - begin
    start = np.zeros(len(begin), np.int64)
    np.cumsum(lengths[:-1] + 1, out=start[1:])
    joined = np.full(int(lengths.sum()) + len(begin), 0x20, np.uint8)
    if len(begin):
        gap = np.ones(len(joined), bool)
        gap[start + lengths] = False
        joined[gap] = raw[inside]
    return Words(joined, start, start + lengths, np.searchsorted(begin, offsets), begin, raw, offsets)


_POWERS = np.ones(1, np.uint64)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of data[start:end], the same wherever the bytes stand."""
    global _POWERS
    if len(_POWERS) <= len(data):
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(data) + 1, _BASE), dtype=np.uint64)])
    total = np.zeros(len(data) + 1, np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= _POWERS[: len(data)]
    np.cumsum(terms, out=total[1:])
    return (total[end] - total[start]) * _inverse_power(start)


def _inverse_power(exponent: np.ndarray) -> np.ndarray:
    """_BASE ** -exponent, from a table of low and of high halves."""
    low = _table(1 << 14, 1)
    high = _table((int(exponent.max(initial=0)) >> 14) + 1, 1 << 14)
    return low[exponent & 0x3FFF] * high[exponent >> 14]


def _table(size: int, step: int) -> np.ndarray:
    base = np.uint64(pow(int(_INVERSE), step, 1 << 64))
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base), dtype=np.uint64)])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))

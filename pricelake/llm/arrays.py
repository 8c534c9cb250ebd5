"""Numpy helpers of the operators that read whole texts inside Spark tasks.

Texts stay bytes: words are ranges of one buffer per chunk, hashed by one
running sum, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text handled at once; a longer text is a chunk of its own.
CHUNK = 1 << 19

#: Rows in a batch that Spark hands to a task; texts are long, so fewer than its default.
BATCH_ROWS = 500

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def with_small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session is told to hand rows to Python in small batches, unless it was told another number."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))
    return df


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit integers over all others."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit integers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0xA0761D6478BD642F) + U64(seed)) | U64(1)


_BYTES = numbers(256, 1)
_powers = [np.empty(0, U64), np.empty(0, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK * 5 // 4)
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, dtype=U64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK):
    """Slices of the batches, each with about ``limit`` bytes of ``column`` at most."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < n:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in one array, and where each text starts (one more entry at the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    values = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(values):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = values.buffers()
    offsets = np.frombuffer(at, np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words(NamedTuple):
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    #: First word of each text, and the number of words at the end.
    of: np.ndarray


def _table(pairs) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    for a, b in pairs:
        table[a] = b
    return table


#: A-Z to a-z, everything else as it is.
LOWER = _table((c, c + 32) for c in range(65, 91))
#: True for bytes of words that white space ends.
NOT_SPACE = np.array([not (c == 0x20 or 0x09 <= c <= 0x0D) for c in range(256)])
#: True for ASCII letters and digits and for all bytes of other characters.
LETTERS = np.array([chr(c).isalnum() if c < 128 else True for c in range(256)])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes, which depends on nothing but the bytes in it."""
    forth, back = _power_tables(len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTES[data] * forth, out=total[1:])
    if not len(starts):
        return np.empty(0, U64)
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(U64))


def words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray = NOT_SPACE) -> Words:
    """Words of texts: the longest runs of bytes that ``in_word`` marks, none over two texts."""
    inside = in_word[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < len(data)]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(span_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, offsets))


def shingles(hashes: np.ndarray, of: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``size`` words of each text.

    A text of fewer words has all of them as its one shingle, one without words none.
    """
    factors = numbers(size, 2)
    n = len(hashes)
    runs = np.zeros(max(0, n - size + 1), U64)
    for j in range(size):
        runs += hashes[j : n - size + 1 + j] * factors[j] if n >= size else 0
    runs = mix(runs)
    out = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            one = (hashes[a:b] * factors[: b - a]).sum(dtype=U64) + U64(b - a)
            out.append(mix(np.array([one], U64)))
        else:
            out.append(np.empty(0, U64))
    return out


def fixed_binary(rows: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """Rows of a two-dimensional array as binary values; null where ``missing``."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.dtype.itemsize
    mask = None
    if missing is not None:
        mask = pa.py_buffer(np.packbits(~missing, bitorder="little").tobytes())
    kind = pa.binary(width)
    found = pa.FixedSizeBinaryArray.from_buffers(kind, len(rows), [mask, pa.py_buffer(rows.tobytes())])
    return found.cast(pa.binary())


def lists(values: np.ndarray, lengths, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal integer ``keys``, from batches sorted by them."""
    kept, last = [], None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n]):
            key = tuple(columns[:, a].tolist())
            if kept and key != last:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(a, b - a))
            last = key
    if kept:
        yield pa.Table.from_batches(kept)

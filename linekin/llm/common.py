"""Shared pieces of the training-data operators: table access, shared-folder tables, Arrow text chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linekin.plans.storage import drop_stored, new_path, shared_dir, stored

__all__ = ["drop_stored", "new_path", "shared_dir", "small", "stored", "table", "text_chunks", "mixed", "word_bounds", "word_hashes"]

#: Bytes of text that one numpy pass works on; a longer document is a pass of its own.
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = 250_000, size: int = 48 << 20) -> DataFrame:
    """The table, to be sent to every task if it has at most so many rows and bytes; else as it is, for a shuffle.

    It is counted first, so it should be a stored one.
    """
    wide = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    more = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in wide]
    width = F.lit(16 * len(df.columns) + 16).cast("long")
    for c in more:
        width = width + c
    found = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if found["n"] <= rows and found["b"] <= size else df


def text_chunks(texts: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Splits an Arrow string column in runs of rows: (first row, utf-8 bytes, offsets of the rows and the end).

    Null texts count as empty. No copy of the text is made.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):  # an empty one stays chunked
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind, n + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(at, at[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_STEP = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_STEP, _BACK)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS[k] = np.cumprod(step, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer (shift, multiply, shift) over an array."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``; a word never goes over the end of a row."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_SPACE[raw]
    edge = np.empty(len(raw), bool)
    edge[0] = True
    np.not_equal(solid[1:], solid[:-1], out=edge[1:])
    inner = at[1:-1]
    edge[inner[inner < len(raw)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(raw))
    keep = solid[starts]
    return starts[keep], ends[keep]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words after lower-casing A-Z: differences of one polynomial prefix sum, then mixed."""
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

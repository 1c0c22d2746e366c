"""Shared helpers: input columns and vectorised word hashing over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, discard, shared_dir

__all__ = ["cut", "discard", "distinct", "hash_words", "input_bytes", "longs", "mix", "ngrams", "packed_row", "powers", "ragged", "shared_dir", "slices", "small", "span_hash", "table", "words_col"]
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, limit_rows: int) -> DataFrame:
    """A broadcast hint if the written table ``df`` has at most ``limit_rows`` rows; else ``df``, which then joins by shuffle."""
    return F.broadcast(df) if df.limit(limit_rows + 1).count() <= limit_rows else df


def packed_row(df: DataFrame, name: str = "__row"):
    """All columns of ``df`` as one struct, whatever characters their names have; ``name.*`` gives them back."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns)).alias(name)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, as the planner knows them; 0 for what comes from elsewhere. No job runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = (leaves.apply(k) for k in range(leaves.size()))
    return sum(int(x.stats().sizeInBytes()) for x in found if x.getClass().getSimpleName() in ("LogicalRelation", "DataSourceV2ScanRelation"))


def words_col(text: str = "text"):
    """Lower-cased text that ends in a separator, as ``hash_words`` expects it; null counts as empty."""
    return F.concat(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("\n"))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about ``most`` bytes; a longer row stands alone."""
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 2**64)
_WORD = np.zeros(256, dtype=np.int8)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INV)):
            p = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each bytes[start:end]: differences of one running polynomial sum modulo 2**64."""
    p, q = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * p[: len(raw)], out=total[1:])
    h = (total[ends] - total[starts]) * q[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of letters, digits and bytes outside ASCII."""
    w = np.zeros(len(raw) + 2, dtype=np.int8)
    w[1:-1] = _WORD[raw]
    d = np.diff(w)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def hash_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, for each document the index of its first word, with the total at the end). Documents end in a separator."""
    s, e = word_spans(raw)
    return span_hash(raw, s, e), np.searchsorted(s, offsets)


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the runs of ``n`` words within a document, index of the document); a shorter document that has a word gives one, of all its words."""
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    if len(h) >= n:
        g = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            g = g * np.uint64(_BASE) + h[k : len(h) - n + 1 + k]
        ok = doc[: len(g)] == doc[n - 1 :]
        g, d = mix(g[ok]), doc[: len(ok)][ok]
    else:
        g, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = []
        for i in short:
            x = 0
            for y in h[first[i] : first[i + 1]].tolist():
                x = (x * _BASE + y + 1) % 2**64
            extra.append(x)
        g, d = np.concatenate([g, mix(np.array(extra, dtype=np.uint64))]), np.concatenate([d, short])
    return g, d


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted and without repeats; sorting beats the hash table that numpy takes for this."""
    v = np.sort(values)
    return v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A binary array whose i-th entry holds the next ``counts[i]`` of ``values``."""
    off = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts * values.itemsize, out=off[1:])
    return pa.Array.from_buffers(kind or pa.binary(), len(counts), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def longs(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64) if h.dtype == np.uint64 else h.astype(np.int64), type=pa.int64())

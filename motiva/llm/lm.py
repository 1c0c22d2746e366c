"""N-gram language-model scores from a log-frequency Bloom filter.

All word n-grams of the corpus up to ``order`` are counted. As every text scored is part of the corpus, an occurrence is
scored by the others: c is the count less one. A c of 1 or more becomes the level 1 + floor(log_base c), and an n-gram of
level q is put into the filter q times, as (n-gram, 1) .. (n-gram, q); n-grams that occur once need no entry. To read c,
membership of (n-gram, 1), (n-gram, 2), .. is probed until one fails; the level gives the middle of its range. False
positives only raise a level, one more step is as unlikely again, and a level is cut to those of the two n-grams of one word
less. Probabilities interpolate the orders with fixed
weights, with half an occurrence for words never seen.

The filter is in segments by hash of the n-gram, as many as the size of the input asks for, each built by one task from the
sorted counts that all tasks send it, and written as a table. A segment has a range of the hashes, so that sorted n-grams lie
as close in it, and take as few bytes, however many segments there are. Up to ``broadcast_bytes`` the filter is broadcast and
probed in one pass. Beyond that, the texts are written once in slices, compressed; the distinct n-grams of each slice go to the
segments by shuffle, sorted, and only their levels come back, in that order, to meet the slice: the same answers for any size.

Defined cases: words are runs of letters and digits in lower case; a text without words, or null, has n_words 0,
log_prob 0.0 and a null perplexity, and null doc_ids are scored too; repeated rows count, and are scored, each; texts are
scored whole; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, hash_words, input_bytes, mix, slices, words_col
from .substrings import free

BITS = 20  # of the filter for each entry
PROBES = 4  # bits set for an entry, all in one word of 64
MOST_LEVELS = 120
SEGMENT_BYTES = 64 << 20  # of input for each segment
KEY_BITS = 48  # of an n-gram's hash: at 30 GB one n-gram in some 30,000 has another one's, far fewer than the filter takes for one
HELD_BYTES = 4 << 20  # of text in a slice that is written


def keys(h: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each word, for n = 1..order; 0 where the document begins too late for one."""
    count = np.diff(first)
    place = np.arange(len(h)) - np.repeat(first[:-1], count)
    out, g = [], np.zeros(len(h), dtype=np.uint64)
    for n in range(1, order + 1):
        g = h.copy()
        for k in range(1, n):
            g[k:] = g[k:] + np.uint64(pow(0x9E3779B97F4A7C15, k, 2**64)) * h[:-k] if len(h) > k else g[k:]
        g = mix(g + np.uint64(n)) >> np.uint64(64 - KEY_BITS)  # sorted, their differences are two bytes shorter
        g[g == 0] = 1
        out.append(np.where(place >= n - 1, g, np.uint64(0)))
    return out


def segment_of(k: np.ndarray, segments: int) -> np.ndarray:
    """The segment of each n-gram; it never falls as they rise."""
    return np.minimum((k >> np.uint64(KEY_BITS - 32)) * np.uint64(segments) >> np.uint64(32), np.uint64(segments - 1)).astype(np.int64)


def _parts(k: np.ndarray, segments: int) -> tuple[list[int], np.ndarray]:
    """(segments that sorted n-grams have, where each segment's begin, with the total at the end)."""
    bound = np.searchsorted(segment_of(k, segments), np.arange(segments + 1))
    return np.flatnonzero(np.diff(bound)).tolist(), bound


def _sorted_counts(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.sort(k)
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[at], np.diff(np.append(at, len(k)))


def _summed(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sums of their counts) of parts (keys of 56 bits, counts): the count goes in the eight bits below its key, so
    that one array is sorted in place; what exceeds them comes in keys of its own."""
    cells, extra = [], []
    for k, c in parts:
        c = c.astype(np.uint64)
        cells.append(k << np.uint64(8) | np.minimum(c, np.uint64(255)))
        if (over := c > 255).any():
            extra.append((k[over], c[over] - np.uint64(255)))
    x = np.concatenate(cells) if cells else np.zeros(0, np.uint64)
    del cells
    x.sort()
    k = x >> np.uint64(8)
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    k = k[at]
    n = np.add.reduceat(x & np.uint64(255), at).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    for own, more in extra:
        np.add.at(n, np.searchsorted(k, own), more.astype(np.int64))
    return k, n


def packed(k: np.ndarray) -> bytes:
    """Sorted numbers as their differences, first all low bytes, then the next ones and so on: the high ones are mostly 0, which a shuffle compresses away."""
    return np.diff(k, prepend=np.zeros(1, k.dtype)).view(np.uint8).reshape(len(k), -1).T.tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel(), dtype=kind)


def _count(order: int, segments: int, flush: int = 3_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(order)]
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for n in range(order):
                k = np.concatenate(held[n]) if held[n] else np.zeros(0, np.uint64)
                held[n] = []
                k, c = _sorted_counts(k)
                rows, bound = _parts(k, segments)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows, pa.int32()), pa.array([n + 1] * len(rows), pa.int32()), pa.array([packed(k[bound[s] : bound[s + 1]]) for s in rows], pa.binary()), pa.array([packed(np.minimum(c[bound[s] : bound[s + 1]], 2**32 - 1).astype(np.uint32)) for s in rows], pa.binary())],
                        names=["segment", "n", "keys", "counts"],
                    )
            size = 0

        for batch in batches:
            for _, _, raw, offsets in slices(batch, "w"):
                for n, k in enumerate(keys(*hash_words(raw, offsets), order)):
                    held[n].append(k[k != 0])
                    size += len(k)
                if size > flush:
                    yield from out()
        yield from out()

    return run


def levels_of(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(base) + 1e-9).astype(np.int64)


def _place(k: np.ndarray, level: np.ndarray | int, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """(word of the segment's filter, bits in it) of (n-gram, level)."""
    x = mix(k + np.asarray(level, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    bits = np.uint64(1) << (x & np.uint64(63))
    for p in range(1, PROBES):
        bits = bits | (np.uint64(1) << ((x >> np.uint64(6 * p)) & np.uint64(63)))
    return (((x >> np.uint64(32)) * np.asarray(words, dtype=np.uint64)) >> np.uint64(32)).astype(np.int64), bits


def build(k: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The filter of the n-grams ``k`` with levels ``q``."""
    words = max(1, -(-int(q.sum()) * BITS // 64))
    out = np.zeros(words, dtype=np.uint64)
    for level in range(1, int(q.max(initial=0)) + 1):
        at, bits = _place(k[q >= level], level, words)
        np.bitwise_or.at(out, at, bits)
    return out


def _merge(base: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(segment: int) -> pa.RecordBatch:
            rows = held.pop(segment)
            k, c, seen, total = [], [], 0, 0
            for n in sorted({r[0] for r in rows}):
                x, y = _summed((unpacked(r[1], np.uint64), unpacked(r[2], np.uint32)) for r in rows if r[0] == n)
                rows = [r for r in rows if r[0] != n]
                if n == 1:
                    seen, total = len(x), int(y.sum())
                k.append(x[y > 1])
                c.append(y[y > 1] - 1)
            data = build(np.concatenate(k), levels_of(np.concatenate(c), base))
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([data.tobytes()], pa.binary()), pa.array([seen], pa.int64()), pa.array([total], pa.int64())], names=["segment", "filter", "seen", "total"])

        for batch in batches:
            for s, n, k, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for other in [x for x in held if x != s]:
                    yield out(other)
                held.setdefault(s, []).append((n, k, c))
        for s in list(held):
            yield out(s)

    return run


class Filter:
    """Segments of a filter, side by side."""

    def __init__(self, parts: Iterable[tuple[int, bytes]], segments: int, size: int) -> None:
        """``size``: bytes of all parts."""
        self.words, self.first = np.zeros(segments, dtype=np.uint64), np.zeros(segments, dtype=np.int64)
        self.data, at = np.zeros(size // 8, dtype=np.uint64), 0
        for s, b in parts:
            n = len(b) // 8
            self.words[s], self.first[s] = n, at
            self.data[at : at + n] = np.frombuffer(b, dtype=np.uint64)
            at += n

    def levels(self, k: np.ndarray) -> np.ndarray:
        """The level of each n-gram: how many memberships in a row hold."""
        q = np.zeros(len(k), dtype=np.uint8)
        segment = segment_of(k, len(self.words))
        live = np.flatnonzero(self.words[segment] > 0)
        words, first, k = self.words[segment], self.first[segment], k
        for level in range(1, MOST_LEVELS + 1):
            if not len(live):
                break
            at, bits = _place(k[live], level, words[live])
            live = live[(self.data[first[live] + at] & bits) == bits]
            q[live] = level
        return q


def middle(q: np.ndarray, base: float) -> np.ndarray:
    """The middle of the counts of a level; 0 of level 0."""
    low = np.ceil(base ** (q.astype(float) - 1) - 1e-9)
    high = np.maximum(low, np.ceil(base ** q.astype(float) - 1e-9) - 1)
    return np.where(q > 0, (low + high) / 2, 0.0)


def log_probs(q: list[np.ndarray], there: list[np.ndarray], base: float, seen: int, total: int, weights: tuple[float, ...]) -> np.ndarray:
    """Natural logarithm of each word's probability. ``q``: levels of the n-grams that end at it, for n = 1.. ; ``there``: whether
    it has one. The last of ``weights`` holds for all orders beyond them."""
    q = list(q)
    for n in range(1, len(q)):
        q[n] = np.minimum(q[n], np.minimum(q[n - 1], np.concatenate([q[n - 1][:1], q[n - 1][:-1]])))
    c = [middle(x, base) for x in q]
    weights = (*weights, *(weights[-1:] or (0.0,)) * len(c))
    p = (c[0] + 0.5) / (total - 1 + 0.5 * (seen + 1))
    for n in range(1, len(c)):
        before = np.concatenate([[0.0], c[n - 1][:-1]])
        ratio = np.minimum(1.0, c[n] / np.maximum(before, np.maximum(c[n], 1.0)))
        p = np.where(there[n] & (before > 0), weights[n - 1] * ratio + (1 - weights[n - 1]) * p, p)
    return np.log(p)


def _results(ids: pa.Array, logs: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    n = np.diff(first)
    lp = np.zeros(len(n))
    if len(logs):
        lp[n > 0] = np.add.reduceat(logs, first[:-1][n > 0])  # each by itself: the same whatever else is in the slice
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        ppl = np.exp(-lp / n)
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(lp), pa.array(ppl, mask=n == 0)], names=["doc_id", "n_words", "log_prob", "perplexity"])


SCORES = "doc_id long, n_words long, log_prob double, perplexity double"


def _score(shared, order: int, base: float, seen: int, total: int, weights: tuple[float, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in slices(batch, "w"):
                h, first = hash_words(raw, offsets)
                q, there = [], []
                for k in keys(h, first, order):
                    u, back = _distinct(k)
                    q.append(shared.value.levels(u)[back])
                    there.append(k != 0)
                    q[-1][~there[-1]] = 0
                yield _results(batch.column(0).slice(i, j - i), log_probs(q, there, base, seen, total, weights), first)

    return run


def _distinct(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(k)
    fresh = np.concatenate([[True], k[order[1:]] != k[order[:-1]]]) if len(k) else np.zeros(0, bool)
    back = np.empty(len(k), dtype=np.int64)
    back[order] = np.cumsum(fresh) - 1
    return k[order[fresh]], back


ASKED = "slice long, segment int, kind int, a binary, b binary, c binary"
_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=["slice", "segment", "kind", "a", "b", "c"])


def _hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each slice of documents a row of kind 0 with its ids, bounds and compressed text."""
    at = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids = batch.column(0)
        for i, j, raw, offsets in slices(batch, "w", HELD_BYTES):
            null = np.array(ids.slice(i, j - i).is_null().to_pylist(), dtype=np.uint8)
            own = np.stack([ids.slice(i, j - i).fill_null(0).to_numpy(zero_copy_only=False), null])
            yield _asked([(at, -1, 0, own.astype(np.int64).tobytes(), offsets.astype(np.int64).tobytes(), pa.compress(raw.tobytes(), codec="zstd", asbytes=True))])
            at += 1


def _words(b: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    """As ``hash_words`` gives them, of a slice with bounds ``b`` and text ``c``."""
    offsets = np.frombuffer(b, np.int64)
    raw = pa.decompress(c, decompressed_size=int(offsets[-1]), codec="zstd", asbytes=True)
    return hash_words(np.frombuffer(raw, np.uint8), offsets)


def _ask(order: int, segments: int):
    """For each slice and segment a row of kind 1 with the distinct n-grams, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at, b, c = (batch.column(n)[k].as_py() for n in range(3))
                u, _ = _distinct(np.concatenate(keys(*_words(b, c), order)))
                rows, bound = _parts(u, segments)
                if rows:
                    yield _asked([(at, s, 1, packed(u[bound[s] : bound[s + 1]]), None, None) for s in rows])

    return run


def _answer(segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part = -1, None
        for batch in batches:
            rows = []
            for at, s, kind, a in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if kind == 0:
                    now, part = s, Filter([(s, a)], segments, len(a))
                else:
                    k = unpacked(a, np.uint64)
                    q = part.levels(k) if now == s else np.zeros(len(k), np.uint8)
                    rows.append((at, s, 1, q.tobytes(), None, None))
            if rows:
                yield _asked(rows)

    return run


def _finish(order: int, base: float, seen: int, total: int, weights: tuple[float, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, levels = None, []

        def out() -> pa.RecordBatch:
            a, b, c = own
            ids, null = np.frombuffer(a, np.int64).reshape(2, -1)
            h, first = _words(b, c)
            k = keys(h, first, order)
            _, back = _distinct(np.concatenate(k))
            q = np.frombuffer(b"".join(levels), np.uint8)[back].reshape(order, -1)
            there = [x != 0 for x in k]
            return _results(pa.array(ids, mask=null.astype(bool)), log_probs([np.where(y, x, np.uint8(0)) for x, y in zip(q, there)], there, base, seen, total, weights), first)

        for batch in batches:
            for k in range(batch.num_rows):
                kind, a, b, c = (batch.column(n)[k].as_py() for n in range(2, 6))
                if kind == 0:
                    if own is not None:
                        yield out()
                    own, levels = (a, b, c), []
                else:
                    levels.append(a)
        if own is not None:
            yield out()

    return run


def lm_scores(docs: DataFrame, order: int = 3, base: float = 1.5, weights: tuple[float, ...] = (0.7, 0.7), broadcast_bytes: int = 256 << 20) -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) of every document under the model of all of them but the occurrence that is
    scored. ``weights[n - 2]``: of order n against the orders below; the last for all orders beyond."""
    if order < 1 or not all(0 <= w <= 1 for w in weights):
        raise ValueError("order is 1 at least, and weights lie between 0 and 1")
    spark = docs.sparkSession
    segments = max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs.select("text")) // SEGMENT_BYTES))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_col().alias("w"))
    counts = lambda: source.select("w").mapInArrow(_count(order, segments), "segment int, n int, keys binary, counts binary")
    parts = cut(counts().repartitionById(segments, "segment").mapInArrow(_merge(base), "segment int, filter binary, seen long, total long"))
    size, seen, total = parts.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0)), F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    if size <= broadcast_bytes:
        shared = spark.sparkContext.broadcast(Filter(_read_parts(parts), segments, size))
        return source.mapInArrow(_score(shared, order, base, seen, total, weights), SCORES)
    free(docs)
    held = cut(source.mapInArrow(_hold, ASKED))
    none = F.lit(None).cast("binary")
    filters = parts.select(F.lit(0).cast("long").alias("slice"), "segment", F.lit(0).alias("kind"), F.col("filter").alias("a"), none.alias("b"), none.alias("c"))
    asked = lambda: held.select("slice", "b", "c").mapInArrow(_ask(order, segments), ASKED).unionByName(filters)
    answers = cut(asked().repartition("segment").sortWithinPartitions("segment", "kind").mapInArrow(_answer(segments), ASKED))
    discard(parts)
    free(docs)
    return held.unionByName(answers).repartition("slice").sortWithinPartitions("slice", "kind", "segment").mapInArrow(_finish(order, base, seen, total, weights), SCORES)


def _read_parts(parts: DataFrame) -> Iterator[tuple[int, bytes]]:
    """The segments of the written table, read past the JVM, a file at a time."""
    for f in parts.inputFiles():
        store, path = fs.FileSystem.from_uri(_uri(f))
        found = pq.read_table(path, filesystem=store, columns=["segment", "filter"])
        yield from zip(found.column(0).to_pylist(), found.column(1).to_pylist())


def _uri(path: str) -> str:
    return "file://" + urlparse(path).path if urlparse(path).scheme in ("", "file") else path

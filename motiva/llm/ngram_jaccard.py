"""N-gram Jaccard join by chosen paths.

Every document is the set of hashes of its word n-grams. Sets are embedded as ``SKETCH`` minhash tokens; in each run a set
descends into the buckets of a few sampled tokens, so that sets that share a sampled token meet. Small buckets are compared
by brute force; a large one is split again on sampled tokens, after those members that are close to the bucket on average
have been compared with all of it. Runs repeat until a pair at the threshold is met with the target probability. Candidates
pass a lenient sketch filter and are then verified on whole sets.

Documents with equal sets are collapsed first and come back as (smallest doc_id, doc_id, 1.0), so a group of m equal
documents costs m - 1 rows.

Defined cases: a null text or doc_id, and a text without any word, takes no part; a text shorter than n words is one n-gram
of all its words; repeated rows (equal doc_id and text) count once, no document is paired with itself,
and of texts that share a doc_id the most similar count; whole texts count, however long; other columns
are ignored; an empty table gives no pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, distinct, hash_words, mix, ngrams, ragged, slices, words_col

SKETCH = 64
BRUTE = 192
_rng = np.random.Generator(np.random.PCG64(8))
_MUL = _rng.integers(0, 2**32, SKETCH, dtype=np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 2**32, SKETCH, dtype=np.uint32)
_COORD = np.arange(SKETCH, dtype=np.uint64)


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, raw, offsets in slices(batch, "w"):
                g, doc = ngrams(*hash_words(raw, offsets), n)
                key = distinct((doc.astype(np.uint64) << np.uint64(32)) | (g >> np.uint64(32)))
                grams, doc = key.astype(np.uint32), (key >> np.uint64(32)).astype(np.int64)
                size = np.bincount(doc, minlength=j - i)
                has = np.flatnonzero(size)
                if not len(has):
                    continue
                starts = np.cumsum(size[has]) - size[has]
                sig = np.empty((len(has), SKETCH), dtype=np.uint32)
                for k in range(SKETCH):
                    sig[:, k] = np.minimum.reduceat((grams ^ _XOR[k]) * _MUL[k], starts)
                wide = grams.astype(np.uint64)
                hi, lo = (np.add.reduceat(mix(wide + np.uint64(c)), starts) for c in (0x51ED270B2F6A1C93, 0xA0761D6478BD642F))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:j][has], pa.int64()), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), ragged(sig.reshape(-1), np.full(len(has), SKETCH)), ragged(grams, size[has])],
                    names=["doc_id", "hi", "lo", "sig", "grams"],
                )

    return run


def _paths(runs: int, threshold: float):
    bar = np.uint64(min(2**64 - 1, int(2**64 / (threshold * SKETCH))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            whole = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(-1, SKETCH)
            for at in range(0, len(ids), 2000):
                sig = whole[at : at + 2000]
                token = (sig.astype(np.uint64) << np.uint64(8)) | _COORD
                sketch = ragged((sig & np.uint32(0xFFFF)).astype(np.uint16).reshape(-1), np.full(len(sig), SKETCH))
                for r in range(runs):
                    path = mix(token + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64))
                    row, coord = np.nonzero(path < bar)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(mix(path[row, coord] ^ np.uint64(r + 1)).view(np.int64)), pa.array(ids[at + row]), sketch.take(pa.array(row))], names=["path", "doc_id", "sketch"])

    return run


def _compare(sk: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    keep_a, keep_b = [], []
    for at in range(0, len(a), 50_000):
        x, y = a[at : at + 50_000], b[at : at + 50_000]
        ok = (sk[x] == sk[y]).sum(axis=1) >= least
        keep_a.append(x[ok])
        keep_b.append(y[ok])
    return (np.concatenate(keep_a), np.concatenate(keep_b)) if keep_a else (a, b)


def within(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions within each group, some groups at a time."""
    total = sizes * (sizes - 1) // 2
    at = 0
    while at < len(sizes):
        to = at + max(1, int(np.searchsorted(np.cumsum(total[at:]), 400_000, "right")))
        s, m = starts[at:to], sizes[at:to]
        left = np.concatenate([np.arange(x, x + k) for x, k in zip(s.tolist(), m.tolist())])
        after = np.concatenate([np.arange(k - 1, -1, -1) for k in m.tolist()])
        a = np.repeat(left, after)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after)
        yield a, b
        at = to


def _split(sk: np.ndarray, rows: np.ndarray, seed: int, threshold: float, least: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of a large bucket."""
    n = len(rows)
    if n <= BRUTE or depth >= 12:
        for at in range(0, n, 256):
            block = np.arange(at, min(n, at + 256))
            for k in range(at, n, 2048):
                a, b = (x.ravel() for x in np.meshgrid(block, np.arange(k, min(n, k + 2048)), indexing="ij"))
                ok = a < b
                x, y = _compare(sk, rows[a[ok]], rows[b[ok]], least)
                yield x, y
        return
    own = sk[rows]
    near = np.zeros(n)
    for k in range(SKETCH):
        _, back, count = np.unique(own[:, k], return_inverse=True, return_counts=True)
        near += (count[back] - 1) / (n - 1)
    hub = near / SKETCH >= 0.8 * threshold
    hubs, rest = np.flatnonzero(hub), np.flatnonzero(~hub)
    for at in range(0, len(hubs), 256):
        block = hubs[at : at + 256]
        for k in range(0, n, 2048):
            a, b = (x.ravel() for x in np.meshgrid(block, np.arange(k, min(n, k + 2048)), indexing="ij"))
            ok = (a < b) | ((a > b) & ~hub[b])
            x, y = _compare(sk, rows[a[ok]], rows[b[ok]], least)
            yield x, y
    if len(rest) < 2:
        return
    if len(rest) <= BRUTE:
        yield from _split(sk, rows[rest], seed, threshold, least, depth + 1)
        return
    left = own[rest]
    path = mix(((left.astype(np.uint64) << np.uint64(8)) | _COORD) + np.uint64((seed * 0x9E3779B97F4A7C15 + depth) % 2**64))
    row, coord = np.nonzero(path < np.uint64(int(2.0 * 2**64 / (threshold * SKETCH))))
    child = path[row, coord]
    order = np.argsort(child, kind="stable")
    child, row = child[order], row[order]
    edges = np.flatnonzero(np.diff(child, prepend=child[:1] ^ np.uint64(1))) if len(child) else np.zeros(0, np.int64)
    for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(child)]):
        if e - s > 1:
            inside = rows[rest[row[s:e]]]
            yield from _split(sk, inside, int(child[s] >> np.uint64(1)), threshold, least, depth + 1 if e - s < n else 12)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first column, regrouped so that no group spans two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if key[-1] == key[0] and (not held or held[-1].column(0)[held[-1].num_rows - 1].as_py() == key[0]):
            held.append(batch)
            continue
        last = int(np.searchsorted(key == key[-1], True))
        held.append(batch.slice(0, last))
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if sum(x.num_rows for x in held) else batch.slice(0, 0)
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _buckets(threshold: float):
    least = max(1, math.ceil(SKETCH * threshold - 3 * math.sqrt(SKETCH * threshold * (1 - threshold))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches):
            if batch.num_rows < 2:
                continue
            path, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
            sizes = np.diff(np.append(starts, len(path)))
            some = sizes > 1
            starts, sizes = starts[some], sizes[some]
            if not len(starts):
                continue
            sk = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint16).reshape(-1, SKETCH)

            def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
                x, y = ids[a], ids[b]
                return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(path[a])], names=["a", "b", "path"])

            few = sizes <= BRUTE
            for a, b in within(starts[few], sizes[few]):
                yield out(*_compare(sk, a, b, least))
            for s, m in zip(starts[~few].tolist(), sizes[~few].tolist()):
                for a, b in _split(sk, np.arange(s, s + m), int(path[s]) & 0x7FFFFFFF, threshold, least, 1):
                    if len(a):
                        yield out(a, b)

    return run


def jaccard(x: np.ndarray, y: np.ndarray, threshold: float) -> float:
    """Of two sorted arrays without repeats; 0 where their sizes alone rule out ``threshold``."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) < threshold * len(y):
        return 0.0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return both / (len(x) + len(y) - both)


def _verify(threshold: float, forest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        sets: dict[int, dict[bytes, None]] = {}
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        for batch in batches:
            found: tuple[list, list, list] = ([], [], [])
            for path, a, b, grams in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), batch.column(4)):
                if path != now:
                    now, sets, root = path, {}, {}
                if b is None:
                    sets.setdefault(a, {})[grams.as_buffer().to_pybytes()] = None
                    continue
                if forest and (ra := find(a)) == (rb := find(b)):
                    continue
                similar = max(jaccard(np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32), threshold) for x in sets[a] for y in sets[b])
                if similar >= threshold:
                    if forest:
                        root[ra] = rb
                    for k, v in zip(found, (a, b, similar)):
                        k.append(v)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["doc_a", "doc_b", "jaccard"])

    return run


def ngram_jaccard_join(docs: DataFrame, n: int = 3, threshold: float = 0.5, recall: float = 0.99, forest: bool = False) -> DataFrame:
    """(doc_a, doc_b, jaccard) with doc_a < doc_b: all pairs of distinct sets with at least ``threshold``, each met with
    probability ``recall``, and each further document of a set with the smallest doc_id of that set.

    ``forest`` leaves out pairs of documents that others verified in their bucket connect already: enough for groups, and in
    proportion to their members. The sets to verify are joined by shuffle at every size.
    """
    source = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), words_col().alias("w"))
    sets = cut(source.mapInArrow(_sets(n), "doc_id long, hi long, lo long, sig binary, grams binary"))
    members = cut(sets.groupBy("hi", "lo", "doc_id").count().groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.collect_list("doc_id").alias("ids")).where(F.size("ids") > 1))
    equal = members.select("rep", F.explode("ids").alias("doc_id"), "hi", "lo").where("doc_id <> rep")
    reps = sets.select("doc_id", "hi", "lo", "sig").join(equal.select("doc_id", "hi", "lo"), ["doc_id", "hi", "lo"], "left_anti")
    runs = math.ceil(math.log(1 - recall) / -1.0)
    paths = reps.select("doc_id", "sig").mapInArrow(_paths(runs, threshold), "path long, doc_id long, sketch binary")
    met = paths.repartition("path").sortWithinPartitions("path").mapInArrow(_buckets(threshold), "a long, b long, path long")
    pairs = cut(met.where("a < b").groupBy("a", "b").agg(F.min("path").alias("path")))
    need = cut(pairs.select("path", F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    whole = sets.select("doc_id", "grams").join(need.hint("shuffle_merge"), "doc_id").select("path", F.lit(0).alias("kind"), F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "grams")
    asked = pairs.select("path", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("grams"))
    near = whole.unionByName(asked).repartition("path").sortWithinPartitions("path", "kind").mapInArrow(_verify(threshold, forest), "doc_a long, doc_b long, jaccard double")
    return near.unionByName(equal.select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard")))


def connected(edges: DataFrame, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """(doc_id, group): each document that has an edge, with the smallest doc_id it is connected with.

    Alternates large-star and small-star steps until nothing changes; each step is a group-by of edges, at most one per
    document after the first, and is written before the next.
    """
    now = cut(edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct())
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.collect_list("v").alias("vs")).select("m", "u", F.explode("vs").alias("x")).where("x > u").select(F.col("x").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.collect_list("v").alias("vs"))
        then = cut(low.select("u", F.col("m").alias("v")).union(low.select(F.explode("vs").alias("u"), F.col("m").alias("v")).where("u <> v")).distinct())
        same = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if same(now) == same(then):
            return then.select(F.col("u").alias("doc_id"), F.col("v").alias("group")).union(then.select(F.col("v").alias("doc_id"), F.col("v").alias("group")).distinct())
        now = then

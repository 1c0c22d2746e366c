"""Approximate nearest neighbours in robust-pruned directed graphs.

Vectors are dealt to shards by hash of their id. Each shard's graph starts random and is built in two rounds: a greedy search
for every vector proposes the vertices it visits as neighbours, and relaxed pruning keeps of these, nearest first, those that
no kept one is nearer to by the factor ``alpha``; edges are put in both ways and pruned again where a vertex has too many.
Every vector is a query, or each whose id ``every`` divides: a beam search goes through each shard's graph, and the nearest of all shards are the answer.

There are as many shards as the cluster has task slots, so that each is built by a task of its own, and more only where a
shard would have over ``shard_rows`` vectors: searches cost about as much in a large graph as in a small one, and their number
grows with vectors times shards.

Equal vectors of a shard share one vertex and come back together. Ties are ordered by id. A vector is no neighbour of its own
id.

Defined cases: null ids, null vectors, vectors with a null, a NaN or an infinity, and vectors that don't have the most common
length (of equally common ones, the greatest) are left out, as vectors and as queries; of rows that share an id one counts,
that with the least vector; with fewer than k others, a vector has that many neighbours; other columns are ignored; an empty
table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

BLOCK = 256
CELLS = 1 << 22  # distances between candidates held at once
LEAST_ROWS = 1024  # of a shard, before there is one for each task slot


def search(v: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int, width: int = 4, log: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, squared distances) of the beams of queries ``q``, nearest first. ``graph``: neighbours of each vertex, then -1.

    Each step expands the ``width`` nearest vertices of each beam that weren't yet. ``log`` gets those expanded.
    """
    n, m = len(v), len(q)
    norm = np.einsum("ij,ij->i", v, v)
    qn = np.einsum("ij,ij->i", q, q)
    ids = np.full((m, beam), n, dtype=np.int64)
    dist = np.full((m, beam), np.inf, dtype=np.float32)
    done = np.ones((m, beam), dtype=bool)
    ids[:, 0], dist[:, 0], done[:, 0] = start, np.maximum(qn + norm[start] - 2 * q @ v[start], 0), False
    seen = np.zeros((m, n + 1), dtype=bool)
    seen[:, start] = seen[:, n] = True
    live = np.arange(m)
    while len(live):
        order = np.argsort(done[live], axis=1, kind="stable")[:, :width]  # beams are sorted, so the nearest open ones come first
        at = live[:, None]
        usable = ~done[at, order]
        picked = np.where(usable, ids[at, order], n)
        done[at, order] = True
        if log is not None:
            log.append((live, picked))
        near = np.where(picked[:, :, None] < n, graph[np.minimum(picked, n - 1)], -1).reshape(len(live), -1)
        near = np.where(near < 0, n, near)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[at, near]] = n
        seen[at, near] = True
        new = near < n
        d = np.full(near.shape, np.inf, dtype=np.float32)
        r, c = np.nonzero(new)
        w = near[r, c]
        d[r, c] = np.maximum(qn[live[r]] + norm[w] - 2 * np.einsum("ij,ij->i", q[live[r]], v[w]), 0)
        every = np.concatenate([dist[live], d], axis=1)
        best = np.argsort(every, axis=1, kind="stable")[:, :beam]
        local = np.arange(len(live))[:, None]
        ids[live] = np.concatenate([ids[live], near], axis=1)[local, best]
        dist[live] = every[local, best]
        done[live] = np.concatenate([done[live], ~new], axis=1)[local, best]
        live = live[~done[live].all(axis=1)]
    return ids, dist


def prune(v: np.ndarray, p: np.ndarray, cand: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """For each vertex of ``p``, at most ``degree`` of its candidates (len(v) for none): the nearest, again and again, and then without those that are nearer to it by ``alpha``."""
    n = len(v)
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = n
    cand[cand == p[:, None]] = n
    cand = np.sort(cand, axis=1)[:, : max(1, int((cand < n).sum(axis=1).max()))]
    out = np.full((len(p), degree), -1, dtype=np.int64)
    each = max(1, CELLS // cand.shape[1] ** 2)
    for at in range(0, len(p), each):
        out[at : at + each] = _pruned(v, p[at : at + each], cand[at : at + each], alpha * alpha, degree)  # distances are squared
    return out


def _pruned(v: np.ndarray, p: np.ndarray, cand: np.ndarray, relaxed: float, degree: int) -> np.ndarray:
    n = len(v)
    x = v[np.minimum(cand, n - 1)] - v[p][:, None, :]  # about the vertex, so that products lose no precision
    d = np.einsum("ijk,ijk->ij", x, x)
    between = x @ x.transpose(0, 2, 1)
    between *= -2
    between += d[:, :, None]
    between += d[:, None, :]
    d[cand == n] = np.inf
    out = np.full((len(p), degree), -1, dtype=np.int64)
    rows = np.arange(len(p))
    left = d.copy()
    for k in range(degree):
        j = left.argmin(axis=1)
        ok = np.isfinite(left[rows, j])
        if not ok.any():
            break
        out[ok, k] = cand[rows, j][ok]
        left[(relaxed * between[rows, j] <= d) & ok[:, None]] = np.inf
        left[rows, j] = np.inf
    return out


def build(v: np.ndarray, degree: int, beam: int, alpha: float, seed: int) -> tuple[np.ndarray, int]:
    """(neighbours of each vertex, then -1; the vertex nearest to the mean, where searches start)."""
    n = len(v)
    rng = np.random.Generator(np.random.PCG64(seed))
    start = int(((v - v.mean(axis=0)) ** 2).sum(axis=1).argmin())
    if n == 1:
        return np.full((1, degree), -1, dtype=np.int64), 0
    graph = rng.integers(0, n, (n, degree))
    graph[graph == np.arange(n)[:, None]] = -1
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for at in range(0, n, BLOCK):
            p = order[at : at + BLOCK]
            log: list = []
            beams, _ = search(v, graph, start, v[p], beam, log=log)
            visited = [np.full((len(p), picked.shape[1]), n) for _, picked in log]
            for store, (live, picked) in zip(visited, log):
                store[live] = picked
            old = np.where(graph[p] < 0, n, graph[p])
            graph[p] = prune(v, p, np.concatenate([beams, old, *visited], axis=1), a, degree)
            # Edges back: to each neighbour, all of this block that point to it.
            src, dst = np.repeat(p, degree), graph[p].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            to, first, count = np.unique(dst, return_index=True, return_counts=True)
            extra = np.full((len(to), int(count.max(initial=0))), n)
            extra[np.repeat(np.arange(len(to)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
            for b in range(0, len(to), BLOCK):
                t = to[b : b + BLOCK]
                graph[t] = prune(v, t, np.concatenate([np.where(graph[t] < 0, n, graph[t]), extra[b : b + BLOCK]], axis=1), a, degree)
    return graph, start


def _graphs(degree: int, beam: int, alpha: float):
    """All rows (id, v, shard) of a task are of one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).flatten().to_numpy().astype(np.float32).reshape(b.num_rows, -1), b.column(2)[0]) for b in batches if b.num_rows]
        if not parts:
            return
        ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        by = np.argsort(ids)
        ids, x = ids[by], x[by]
        v, back = np.unique(x, axis=0, return_inverse=True)
        graph, start = build(v, degree, beam, alpha, 6)
        blobs = [v.tobytes(), graph.astype(np.int32).tobytes(), ids.tobytes(), back.reshape(-1).astype(np.int32).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([parts[0][2].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([start], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], names=["shard", "kind", "start", *"abcd"])

    return run


PARTS = "shard int, kind int, start int, a binary, b binary, c binary, d binary"


def _blocks(rows_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows_each):
                part = batch.slice(at, rows_each)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([part.column(1).flatten().to_numpy().astype(np.float32).tobytes()], pa.binary())], names=["a", "b"])

    return run


def _search(dim: int, degree: int, beam: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, kind, start, a, b, c, d in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if kind == 0:
                    v, graph = np.frombuffer(a, np.float32).reshape(-1, dim), np.frombuffer(b, np.int32).reshape(-1, degree).astype(np.int64)
                    ids, back = np.frombuffer(c, np.int64), np.frombuffer(d, np.int32)
                    by = np.argsort(back, kind="stable")
                    first = np.searchsorted(back[by], np.arange(len(v) + 1))
                    origin = start
                    continue
                own, q = np.frombuffer(a, np.int64), np.frombuffer(b, np.float32).reshape(-1, dim)
                for at in range(0, len(q), BLOCK):
                    found, _ = search(v, graph, origin, q[at : at + BLOCK], beam)
                    near = []
                    for row, me, x in zip(found, own[at : at + BLOCK].tolist(), q[at : at + BLOCK].astype(np.float64)):
                        u = row[row < len(v)]
                        dist = ((v[u].astype(np.float64) - x) ** 2).sum(axis=1)
                        got: list[tuple[float, int]] = []
                        for j in np.argsort(dist, kind="stable").tolist():
                            if len(got) >= k and dist[j] > got[k - 1][0]:
                                break
                            members = ids[by[first[u[j]] : first[u[j] + 1]]][: k + 1].tolist()
                            got += [(float(dist[j]), i) for i in members if i != me]
                        near.append([{"d": x, "i": i} for x, i in sorted(got)[:k]])
                    yield pa.RecordBatch.from_arrays([pa.array(own[at : at + BLOCK]), pa.array(near, pa.list_(pa.struct([("d", pa.float64()), ("i", pa.int64())])))], names=["id", "near"])

    return run


def nearest_neighbours(vectors: DataFrame, k: int = 10, id_column: str = "vec_id", column: str = "embedding", shard_rows: int = 1 << 17, shards: int | None = None, degree: int = 32, beam: int = 64, alpha: float = 1.2, every: int = 1) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): for every vector the ``k`` nearest others by Euclidean distance, as far as the searches
    find them. ``shards``: how many, if not by ``shard_rows``. ``every``: only vectors whose id it divides are queries; all are searched."""
    v = F.transform(F.col(column), lambda x: x.cast("float"))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = float('infinity'))")
    top = rows.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), F.desc("s")).first()
    none = "vec_id long, rank int, neighbor_id long, distance double"
    if top is None or top[0] == 0:
        return vectors.sparkSession.createDataFrame([], none)
    dim = top[0]
    one = cut(rows.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")))
    count = one.count()
    if shards is None:
        shards = max(1, math.ceil(count / shard_rows), min(vectors.sparkSession.sparkContext.defaultParallelism, math.ceil(count / LEAST_ROWS)))
    dealt = one.withColumn("shard", F.expr(f"cast(pmod(xxhash64(id), {shards}) as int)")).repartitionById(shards, "shard")
    graphs = cut(dealt.mapInArrow(_graphs(degree, beam, alpha), PARTS))
    null = F.lit(None).cast("binary")
    queries = one.where(F.col("id") % every == 0).mapInArrow(_blocks(1024), "a binary, b binary").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.lit(0).alias("start"), "a", "b", null.alias("c"), null.alias("d"))
    found = graphs.unionByName(queries).repartitionById(shards, "shard").sortWithinPartitions("kind").mapInArrow(_search(dim, degree, beam, k), "id long, near array<struct<d:double,i:long>>")
    best = found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return best.select(F.col("id").alias("vec_id"), F.posexplode("near").alias("p", "n")).select("vec_id", (F.col("p") + 1).alias("rank"), F.col("n.i").alias("neighbor_id"), F.sqrt("n.d").alias("distance"))

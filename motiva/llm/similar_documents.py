"""Documents with their class of similar ones and number of links, exactly.

Two documents are linked if the Jaccard coefficient of their sets of word n-grams is ``threshold`` or more. Equal sets are one
node of the graph of links. No link is left to chance, and no pair of near copies is written out:

  - Sets are dealt by n-gram to segments, which tell each document how many of its n-grams others have. One with too few for
    any link has none, and goes; what is left are the live sets.
  - Live sets are put in groups by minhash: a set joins the first of a bucket if their signatures agree. Any grouping would do
    for the result; a good one saves work.
  - Within a group, all pairs are compared by products of 0/1 matrices, block by block, in as many tasks as there are pairs of blocks.
  - Between groups, pairs are found by prefixes: of two sets at the threshold, the rarest n-grams of each, as many as
    size - threshold * size + 1, have one in common. Those pairs are compared whole.

Defined cases: a null text or doc_id, and a text without any word, takes no part; a text shorter than n words is one n-gram of
all its words; repeated rows (equal doc_id and text) count once; different texts that share a doc_id are documents of their
own, with a row for each; whole texts count, however long; other columns are ignored; an empty table gives no row. N-grams
are compared by 32 bits of their hashes, and sets by 64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, distinct, hash_words, input_bytes, mix, ngrams, ragged, slices, words_col
from .ngram_jaccard import _MUL, _XOR, SKETCH, connected, groups, jaccard

SIDE = 1024  # sets of a block of a group
WIDE = 2048  # n-grams of a product of matrices
SEGMENT_BYTES = 16 << 20  # of input for each segment
BANDS, ROWS, ROUNDS = 16, 3, 4


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, raw, offsets in slices(batch, "w", 4 << 20):
                g, doc = ngrams(*hash_words(raw, offsets), n)
                key = distinct((doc.astype(np.uint64) << np.uint64(32)) | (g >> np.uint64(32)))
                grams, doc = key.astype(np.uint32), (key >> np.uint64(32)).astype(np.int64)
                size = np.bincount(doc, minlength=j - i)
                every = np.flatnonzero(size)
                first = np.cumsum(size[every]) - size[every]
                if not len(every):
                    continue
                node = np.add.reduceat(mix(grams.astype(np.uint64) + np.uint64(0x51ED270B2F6A1C93)), first).view(np.int64)
                ends = np.append(first, len(grams))
                for at in range(0, len(every), 1 << 16):
                    k = slice(at, at + (1 << 16))
                    m = len(every[k])
                    part = grams[ends[at] : ends[at + m]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), pa.array(np.arange(m, dtype=np.int32)), pa.array(ids[i:j][every[k]], pa.int64()), pa.array(node[k]), pa.array(size[every[k]].astype(np.int32)), ragged(part, size[every[k]])], names=["block", "local", "doc_id", "node", "size", "grams"])
                    block += 1

    return run


def _unpacked(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(all values, how many of each row) of a binary column."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind), np.array([len(x) for x in rows], np.int64) // np.dtype(kind).itemsize


def _deal(segments: int):
    """(segment, block, places of documents in the block, n-grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
            for s, e in zip(edge, [*edge[1:], len(block)]):
                part = batch.slice(int(s), int(e - s))
                grams, size = _unpacked(part.column(2), np.uint32)
                local = np.repeat(part.column(1).to_numpy().astype(np.uint16), size)
                to = ((grams.astype(np.uint64) * np.uint64(segments)) >> np.uint64(32)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                count = np.bincount(to, minlength=segments)
                has = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(np.full(len(has), block[s])), ragged(local[order], count[has]), ragged(grams[order], count[has])], names=["segment", "block", "local", "grams"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block, the place of a document once for each of its n-grams here that another document has too."""
    parts = [(b.column(1).to_numpy(), *_unpacked(b.column(2), np.uint16), _unpacked(b.column(3), np.uint32)[0]) for b in batches if b.num_rows]
    if not parts:
        return
    block, local, size, grams = (np.concatenate(c) for c in zip(*parts))
    parts.clear()
    order = np.argsort(grams, kind="stable")
    g = grams[order]
    same = g[1:] == g[:-1]
    more = np.zeros(len(g), bool)
    more[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] = True
    row = np.repeat(np.arange(len(size)), size)[more]
    count = np.bincount(row, minlength=len(size))
    has = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(block[has]), ragged(local[more], count[has])], names=["block", "local"])


def least_common(size: np.ndarray, threshold: float) -> np.ndarray:
    """N-grams that a set shares with any set it is linked with, at least."""
    return np.ceil(threshold * size - 1e-9).astype(np.int64)


def _live(threshold: float):
    """Of rows (block, kind, local, size, locals): the bits of those documents that have enough n-grams in common with others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches):
            block, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
            for s, e in zip(edge, [*edge[1:], len(block)]):
                own, other = batch.slice(int(s), int(e - s)).filter(pa.array(kind[s:e] == 0)), batch.slice(int(s), int(e - s)).filter(pa.array(kind[s:e] == 1))
                local, size = own.column(2).to_numpy(), own.column(3).to_numpy()
                common = np.bincount(_unpacked(other.column(4), np.uint16)[0], minlength=int(local.max()) + 1) if other.num_rows else np.zeros(int(local.max()) + 1, np.int64)
                bits = np.zeros(len(common), bool)
                bits[local] = common[local] >= least_common(size, threshold)
                if bits.any():
                    yield pa.RecordBatch.from_arrays([pa.array([block[s]], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["block", "bits"])

    return run


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, size, sig, grams) of the live rows (block, bits, local, node, size, grams)."""
    for batch in batches:
        bits = batch.column(1).to_pylist()
        ok = np.array([b[i >> 3] >> (7 - (i & 7)) & 1 for b, i in zip(bits, batch.column(2).to_pylist())], bool)
        batch = batch.filter(pa.array(ok, pa.bool_()))
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            grams, size = _unpacked(part.column(5), np.uint32)
            first = np.cumsum(size) - size
            sig = np.empty((len(size), SKETCH), np.uint32)
            for k in range(SKETCH):
                sig[:, k] = np.minimum.reduceat((grams ^ _XOR[k]) * _MUL[k], first)
            yield pa.RecordBatch.from_arrays([part.column(3), part.column(4), ragged(sig.reshape(-1), np.full(len(size), SKETCH)), part.column(5)], names=["node", "size", "sig", "grams"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = _unpacked(batch.column(1), np.uint32)[0].reshape(-1, SKETCH)
        short = ragged((sig & np.uint32(0xFFFF)).astype(np.uint16).reshape(-1), np.full(len(sig), SKETCH))
        for k in range(BANDS):
            h = np.full(len(sig), k, np.uint64)
            for c in range(ROWS):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, k * ROWS + c])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0), short], names=["band", "node", "sketch"])


def _gather(least: int):
    """Edges from the sets of a bucket to the first that agrees; after ROUNDS firsts, the others stay alone: pairs between groups are found anyway."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches):
            if batch.num_rows < 2:
                continue
            band, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sketch = _unpacked(batch.column(2), np.uint16)[0].reshape(-1, SKETCH)
            left = np.arange(len(band))
            for _ in range(ROUNDS):
                fresh = np.concatenate([[True], band[left][1:] != band[left][:-1]])
                to = left[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
                near = np.concatenate([(sketch[left[k : k + 50_000]] == sketch[to[k : k + 50_000]]).sum(axis=1) >= least for k in range(0, len(left), 50_000)])
                edge = near & ~fresh
                if edge.any():
                    yield pa.RecordBatch.from_arrays([pa.array(node[left[edge]]), pa.array(node[to[edge]])], names=["a", "b"])
                left = left[~near]
                if len(left) < 2:
                    break

    return run


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many values each of ``xs`` and each of ``ys`` have in common."""
    x, y = np.concatenate(xs), np.concatenate(ys)
    both = np.intersect1d(distinct(x), distinct(y), assume_unique=True)
    out = np.zeros((len(xs), len(ys)), np.float32)
    if not len(both):
        return out

    def columns(v: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(both, v)
        at[at == len(both)] = 0
        ok = both[at] == v
        row, col = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[ok], at[ok]
        by = np.argsort(col, kind="stable")
        return row[by], col[by]

    (rx, cx), (ry, cy) = columns(x, xs), columns(y, ys)
    for at in range(0, len(both), WIDE):
        width = min(WIDE, len(both) - at)
        a, b = np.zeros((len(xs), width), np.float32), np.zeros((len(ys), width), np.float32)
        for m, r, c in ((a, rx, cx), (b, ry, cy)):
            s, e = np.searchsorted(c, (at, at + width))
            m[r[s:e], c[s:e] - at] = 1
        out += a @ b.T
    return out


LINKS = "a long, b long, links long"


def _links(a, b, links) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], names=["a", "b", "links"])


def _square(threshold: float):
    """Rows (tile, i, j, part, node, weight, grams) of pairs of blocks of a group: how many documents each set is linked with in the other
    block, and an edge to the least set that it is connected with there."""

    def of_tile(rows: pa.Table) -> pa.RecordBatch | None:
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        part, node, weight = (rows[c].to_numpy() for c in ("part", "node", "weight"))
        grams = [np.frombuffer(x, np.uint32) for x in rows["grams"].to_pylist()]
        p, q = np.flatnonzero(part == i), np.flatnonzero(part == j)
        if not len(p) or not len(q):
            return None
        sizes = np.array([len(g) for g in grams], np.float64)
        common = overlaps([grams[k] for k in p], [grams[k] for k in q]).astype(np.float64)
        linked = common / (sizes[p][:, None] + sizes[q][None, :] - common) >= threshold
        if i == j:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(node), np.int64)
        links[p] += linked @ weight[q]
        if i != j:
            links[q] += linked.T @ weight[p]
        label, none = np.arange(len(node)), len(node)
        while True:
            old = label.copy()
            label[p] = np.minimum(label[p], np.where(linked, label[q][None, :], none).min(axis=1))
            label[q] = np.minimum(label[q], np.where(linked, label[p][:, None], none).min(axis=0))
            if (old == label).all():
                break
        some = np.flatnonzero(links)
        return _links(node[some], node[label[some]], links[some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                found = of_tile(pa.Table.from_batches(held))
                held.clear()
                if found is not None:
                    yield found

        for batch in batches:
            tile = batch.column(0).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(tile) else []
            for s, e in zip(edge, [*edge[1:], len(tile)]):
                if held and held[-1].column(0)[0].as_py() != tile[s]:
                    yield from out()
                held.append(batch.slice(int(s), int(e - s)))
        yield from out()

    return run


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, part, grams) as (gram, node, part)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            grams, size = _unpacked(part.column(2), np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int32)), pa.array(np.repeat(part.column(0).to_numpy(), size)), pa.array(np.repeat(part.column(1).to_numpy(), size))], names=["gram", "node", "size"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (gram, node, size) sorted by gram: those whose n-gram two sets or more have, with how many do."""
    for batch in groups(batches):
        gram = batch.column(0).to_numpy()
        if len(gram):
            start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            size = np.diff(np.append(start, len(gram)))
            count = np.repeat(size, size)
            part = batch.append_column("count", pa.array(count.astype(np.int32))).filter(pa.array(count > 1)).select(["node", "count", "gram", "size"])
            for at in range(0, part.num_rows, 100_000):
                yield part.slice(at, 100_000)


def _prefix(threshold: float):
    """Of rows (node, count, gram, size) sorted by these, the prefix of each set, less those of its n-grams that no other set has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches):
            node, size = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            if len(node):
                start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
                count = np.diff(np.append(start, len(node)))
                most = count - least_common(size[start], threshold) + 1
                ok = np.arange(len(node)) - np.repeat(start, count) < np.repeat(most, count)
                yield batch.filter(pa.array(ok)).select(["gram", "node", "size"])

    return run


def _between(threshold: float):
    """Pairs (a, b) of different groups of rows (gram, group, node, size) sorted by the first two, whose sizes allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches):
            gram, group, node, size = (batch.column(k).to_numpy() for k in range(4))
            if not len(gram):
                continue
            start = np.concatenate([[True], gram[1:] != gram[:-1]])
            turn = start | np.concatenate([[True], group[1:] != group[:-1]])
            end = np.append(np.flatnonzero(start)[1:], len(gram))[np.cumsum(start) - 1]
            after = np.append(np.flatnonzero(turn)[1:], len(gram))[np.cumsum(turn) - 1]
            most, at = np.cumsum(end - after), 0
            while at < len(gram):
                to = max(at + 1, int(np.searchsorted(most, (most[at - 1] if at else 0) + 1_000_000, "right")))
                count = (end - after)[at:to]
                a = np.repeat(np.arange(at, to), count)
                b = np.repeat(after[at:to], count) + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
                ok = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
                if ok.any():
                    x, y = node[a[ok]], node[b[ok]]
                    pair = np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)
                    pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
                    pair = pair[np.concatenate([[True], (pair[1:] != pair[:-1]).any(axis=1)])]
                    yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])
                at = to

    return run


def _compared(threshold: float):
    """Rows (a, b, weights and n-grams of both) as LINKS, both ways."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for a, b, wa, wb, x, y in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if jaccard(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), threshold) >= threshold:
                    out += [(a, b, wb), (b, a, wa)]
            if out:
                yield _links(*zip(*out))

    return run


def similar_documents(docs: DataFrame, n: int = 3, threshold: float = 0.5, grouped: bool = True) -> DataFrame:
    """(doc_id, class_id, links): for each document the smallest doc_id that links connect it with, and the number of documents it is
    linked with, copies included. ``grouped=False`` puts no sets in groups, which changes nothing but the work."""
    spark = docs.sparkSession
    source = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), words_col().alias("w"))
    sets = cut(source.mapInArrow(_sets(n), "block long, local int, doc_id long, node long, size int, grams binary"))
    segments = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(input_bytes(docs) / SEGMENT_BYTES))
    dealt = sets.select("block", "local", "grams").mapInArrow(_deal(segments), "segment int, block long, local binary, grams binary").repartitionById(segments, "segment")
    shared = cut(dealt.mapInArrow(_repeated, "block long, local binary"))
    null = lambda kind: F.lit(None).cast(kind)
    asked = sets.select("block", F.lit(0).alias("kind"), "local", "size", null("binary").alias("locals")).unionByName(shared.select("block", F.lit(1).alias("kind"), null("int").alias("local"), null("int").alias("size"), F.col("local").alias("locals")))
    bits = cut(asked.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_live(threshold), "block long, bits binary"))
    names = cut(sets.select("node", "doc_id").distinct())
    nodes = cut(names.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight")))
    signed = sets.join(F.broadcast(bits), "block").select("block", "bits", "local", "node", "size", "grams").mapInArrow(_signed, "node long, size int, sig binary, grams binary")
    live = cut(signed.groupBy("node").agg(F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("grams").alias("grams")).join(nodes.select("node", "weight"), "node"))
    discard(sets, shared, bits)
    least = math.ceil(SKETCH * threshold)
    near = live.where(F.lit(grouped)).select("node", "sig").mapInArrow(_bands, "band long, node long, sketch binary").repartition("band").sortWithinPartitions("band", "node").mapInArrow(_gather(least), "a long, b long")
    group = cut(connected(cut(near.distinct()), "a", "b").select(F.col("doc_id").alias("node"), "group"))
    # Within groups.
    sides = group.groupBy("group").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("sides"))
    member = live.select("node", "weight", "grams").join(group, "node").join(sides, "group").withColumn("part", F.expr("cast(pmod(xxhash64(node), sides) as int)"))
    tiles = member.withColumn("other", F.explode(F.expr("sequence(0, sides - 1)"))).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    tiles = tiles.select(F.xxhash64("group", "i", "j").alias("tile"), "i", "j", "part", "node", "weight", "grams")
    within = tiles.repartition("tile").sortWithinPartitions("tile", "node").mapInArrow(_square(threshold), LINKS)
    # Between groups.
    grams = live.select("node", "size", "grams").mapInArrow(_grams, "gram int, node long, size int")
    counted = grams.repartition("gram").sortWithinPartitions("gram").mapInArrow(_counted, "node long, count int, gram int, size int")
    prefix = counted.repartition("node").sortWithinPartitions("node", "count", "gram").mapInArrow(_prefix(threshold), "gram int, node long, size int")
    prefix = prefix.join(group, "node", "left").select("gram", F.coalesce("group", "node").alias("group"), "node", "size")
    pairs = cut(prefix.repartition("gram").sortWithinPartitions("gram", "group").mapInArrow(_between(threshold), "a long, b long").distinct())
    side = lambda c, k: live.select(F.col("node").alias(c), F.col("weight").alias(f"w{k}"), F.col("grams").alias(f"g{k}"))
    between = pairs.join(side("a", 1), "a").join(side("b", 2), "b").select("a", "b", "w1", "w2", "g1", "g2").mapInArrow(_compared(threshold), LINKS)
    links = cut(within.unionByName(between))
    top = connected(links.where("a <> b"), "a", "b").select(F.col("doc_id").alias("node"), "group")
    named = nodes.join(top, "node", "left").withColumn("group", F.coalesce("group", "node"))
    classes = named.groupBy("group").agg(F.min("rep").alias("class_id"))
    counts = links.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    every = named.join(classes, "group").join(counts, "node", "left").select("node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    return names.join(every, "node").select("doc_id", "class_id", "links")

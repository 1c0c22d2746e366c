"""Bounded-space online packing of documents into windows of a fixed number of tokens.

Each partition keeps at most ``open_windows`` windows. A document goes to the open window it fits best (the least room that
suffices, then the oldest). Where none suffices, a new one is opened; if that is one too many, the fullest (then the oldest)
is emitted first. What is open at the end of each partition is merged at last: leftovers, largest first, are placed best-fit
in groups of at most ``merge_rows``, with a window for whatever fits none.

A document longer than a window is cut into full windows and a rest, which is placed like a document. Every token of every
document is in exactly one window, in order; pieces of a document, joined, give its text back.

Defined cases: tokens are runs of characters other than white space; a text that is null or has no token is in no window; a
null doc_id stays null in the list; of repeated rows each is packed; other columns are ignored; an empty table gives no
window.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .mixing import tokens

TOKEN = re.compile(r"[^ \t\n\r\f]+")
SCHEMA = "window_id long, n_tokens int, doc_ids array<long>, starts array<int>, lengths array<int>, texts array<string>"
KINDS = [("window_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("texts", pa.list_(pa.string()))]
Piece = tuple[int | None, int, int, str]


def pieces(doc_id: int | None, text: str, n: int, size: int) -> list[Piece]:
    """(doc_id, first token, tokens, text) of a document of ``n`` tokens, in order."""
    if n <= size:
        return [(doc_id, 0, n, text)] if n else []
    at = [m.start() for m in TOKEN.finditer(text)][::size]
    at[0] = 0
    return [(doc_id, k * size, min(size, n - k * size), text[a:b]) for k, (a, b) in enumerate(zip(at, [*at[1:], len(text)]))]


class Packer:
    """Open windows as [tokens, pieces], oldest first."""

    def __init__(self, size: int, most: float) -> None:
        self.size, self.most, self.open = size, most, []

    def put(self, n: int, items: list[Piece]) -> list | None:
        """Places ``items`` of ``n`` tokens together; returns the window that had to be emitted."""
        if n >= self.size:
            return [n, items]
        best = None
        for w in self.open:
            if w[0] + n <= self.size and (best is None or w[0] > best[0]):
                best = w
        if best is not None:
            best[0] += n
            best[1] += items
            if best[0] == self.size:
                self.open.remove(best)
                return best
            return None
        out = None
        if len(self.open) >= self.most:
            out = max(self.open, key=lambda w: w[0])
            self.open.remove(out)
        self.open.append([n, list(items)])
        return out


class _Out:
    def __init__(self, first: int, left: bool) -> None:
        self.next, self.left, self.rows, self.chars = first, left, [], 0

    def add(self, window: list, left: bool = False) -> None:
        n, items = window
        self.rows.append((self.next, n, *map(list, zip(*items)), left))
        self.next += 1
        self.chars += sum(len(p[3]) for p in items)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows))
        self.rows, self.chars = [], 0
        kinds = [*KINDS, ("left", pa.bool_())] if self.left else KINDS
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds])


def _pack(size: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, out = Packer(size, most), _Out(TaskContext.get().partitionId() << 32, True)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for doc_id, text, n in zip(*(batch.slice(at, 500).column(k).to_pylist() for k in range(3))):
                    for piece in pieces(doc_id, text, n, size):
                        if (full := packer.put(piece[2], [piece])) is not None:
                            out.add(full)
                            if out.chars > 1 << 21:
                                yield out.batch()
        for w in packer.open:
            out.add(w, True)
        if out.rows:
            yield out.batch()

    return run


def _merge(size: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        packer, out = Packer(size, math.inf), _Out((1 << 62) + (key[0].as_py() << 32), False)
        rows = rows.sort_by([("n_tokens", "descending"), ("window_id", "ascending")])
        for row in rows.to_pylist():
            items = list(zip(row["doc_ids"], row["starts"], row["lengths"], row["texts"]))
            if (full := packer.put(row["n_tokens"], items)) is not None:
                out.add(full)
        for w in packer.open:
            out.add(w)
        return pa.Table.from_batches([out.batch()])

    return run


def pack(docs: DataFrame, size: int = 2048, open_windows: int = 16, merge_rows: int = 4096) -> DataFrame:
    """Windows as (window_id, n_tokens, doc_ids, starts, lengths, texts); the lists have an entry for each piece."""
    source = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", tokens().cast("int").alias("n")).where("n > 0")
    packed = cut(source.mapInArrow(_pack(size, open_windows), SCHEMA + ", left boolean"))
    left = packed.where("left")
    parts = max(1, math.ceil(left.count() / merge_rows))
    merged = left.withColumn("__group", F.expr(f"cast(pmod(xxhash64(window_id), {parts}) as int)")).groupBy("__group").applyInArrow(_merge(size), SCHEMA)
    return packed.where("not left").drop("left").unionByName(merged)

"""Token-id output as length-delimited binary records.

A record frames one document's serialized sequence as

    length (8 bytes, little-endian) | masked CRC-32C of those 8 bytes (4) | payload | masked CRC-32C of the payload (4)

with the payload doc_id (8 bytes), number of token ids (4), bytes an id (4), ids. Each task writes its own shard files,
named after the task attempt, and the offset index, a table with a row for each record, is written apart from them: it
names only shards of attempts that succeeded, so that what a lost executor leaves behind is never read. ``read_records``
reads in any order, for instance shuffled, by seeking to offsets, and checks both checksums.

Text is encoded with a public byte-level BPE vocabulary, whose path is a parameter. Encoding a text is encoding its pieces:
a single space between two other characters always starts a pre-token, so texts are cut there and each distinct piece of a
slice is encoded once. An id takes two bytes if the vocabulary and the end-of-text id allow it, else four.

Defined cases: a null text has no record; an empty one has a record whose only id is the end-of-text id; a null doc_id is
written as -2**63 and read back as null; repeated rows have a record each; a text of any length is one record; other columns
are ignored; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, shared_dir, slices, span_hash

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
NO_ID = -(2**63)
INDEX = "shard string, offset long, length long, doc_id long, n_tokens int"
HEAD = struct.Struct("<qII")
BLOCK = 256


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(eight tables for eight bytes at once, four for skipping BLOCK zero bytes)."""
    t = np.zeros((8, 256), dtype=np.uint32)
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        t[0, i] = c
    for k in range(1, 8):
        t[k] = (t[k - 1] >> np.uint32(8)) ^ t[0, t[k - 1] & np.uint32(255)]
    skip = np.zeros((4, 256), dtype=np.uint32)
    for k in range(4):
        c = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(BLOCK):
            c = (c >> np.uint32(8)) ^ t[0, c & np.uint32(255)]
        skip[k] = c
    return t, skip


_T, _SKIP = _tables()


def crc32c(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32C (Castagnoli) of each raw[start:end].

    The register's start value is the same as flipping the first four bytes, and zeros before a message change nothing
    then; so every message is cut into blocks counted from its end, all blocks are run through the tables side by side, and
    the blocks of a message are folded together, those of all messages at once.
    """
    n = ends - starts
    out = np.zeros(len(n), dtype=np.uint32)
    for k in np.flatnonzero(n < 4).tolist():
        c = 0xFFFFFFFF
        for b in raw[starts[k] : ends[k]].tolist():
            c = (c >> 8) ^ int(_T[0, (c ^ b) & 255])
        out[k] = c ^ 0xFFFFFFFF
    long = np.flatnonzero(n >= 4)
    if not len(long):
        return out
    s, e = starts[long], ends[long]
    blocks = -(-(e - s) // BLOCK)
    pad = np.zeros(int(blocks.sum()) * BLOCK, dtype=np.uint8)
    last = np.cumsum(blocks) * BLOCK
    to = np.repeat(last - e, e - s) + _ranges(s, e)
    pad[to] = raw[_ranges(s, e)]
    first = last - (e - s)
    for k in range(4):
        pad[first + k] ^= 255
    words = pad.reshape(-1, BLOCK // 4, 4).view("<u4")[:, :, 0]
    state = np.zeros(len(words), dtype=np.uint32)
    for k in range(0, BLOCK // 4, 2):
        x, y = state ^ words[:, k], words[:, k + 1]
        state = _T[7, x & 255] ^ _T[6, (x >> 8) & 255] ^ _T[5, (x >> 16) & 255] ^ _T[4, x >> 24] ^ _T[3, y & 255] ^ _T[2, (y >> 8) & 255] ^ _T[1, (y >> 16) & 255] ^ _T[0, y >> 24]
    at, total = np.cumsum(blocks) - blocks, np.zeros(len(long), dtype=np.uint32)
    order = np.argsort(-blocks, kind="stable")
    for k in range(int(blocks.max())):
        live = order[: int(np.searchsorted(-blocks[order], -k, "left"))]
        c = total[live]
        total[live] = _SKIP[0, c & 255] ^ _SKIP[1, (c >> 8) & 255] ^ _SKIP[2, (c >> 16) & 255] ^ _SKIP[3, c >> 24] ^ state[at[live] + k]
    out[long] = total ^ np.uint32(0xFFFFFFFF)
    return out


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All the integers of start..end-1 of each pair, in turn."""
    n = ends - starts
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


_encodings: dict = {}


def encoding(path: str):
    if path not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        widths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        widths[list(ranks.values())] = [len(t) for t in ranks]
        _encodings[path] = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), widths
    return _encodings[path]


def id_type(widths: np.ndarray, end: int) -> np.dtype:
    """Of the ids of a vocabulary of ``widths``, and of ``end``."""
    return np.dtype("<u2") if max(len(widths) - 1, end) < 2**16 else np.dtype("<u4")


def _cuts(raw: np.ndarray) -> np.ndarray:
    """Where a single space stands between two characters that surely aren't white space."""
    at = np.flatnonzero(raw == 32)
    at = at[(at > 2) & (at + 1 < len(raw))]
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
    wide = np.zeros(256, dtype=bool)
    wide[[0xC2, 0xE1, 0xE2, 0xE3]] = True
    before, after = raw[at - 1], raw[at + 1]
    return at[~(space[before] | space[after] | wide[after] | wide[raw[at - 2]] | wide[raw[at - 3]])]


def encode(raw: np.ndarray, offsets: np.ndarray, enc, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all documents, number of ids of each). ``widths``: bytes of each id."""
    cuts = _cuts(raw)
    starts = distinct(np.concatenate([offsets[:-1][np.diff(offsets) > 0], cuts]))
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
    ends = np.append(starts[1:], len(raw))
    h = span_hash(raw, starts, ends)
    order = np.argsort(h)
    fresh = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
    back = np.empty(len(h), dtype=np.int64)
    back[order] = np.cumsum(fresh) - 1
    a, b = starts[order[fresh]], ends[order[fresh]]
    # Pieces that start with a cut's space and end before another's may stand side by side in one call.
    at_cut = np.zeros(len(raw) + 1, dtype=bool)
    at_cut[np.setdiff1d(cuts, offsets, assume_unique=True)] = True
    plain = at_cut[a] & at_cut[b]
    one, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
    size = np.zeros(len(a), dtype=np.int64)
    flat = enc.encode_to_numpy(raw[_ranges(a[one], b[one])].tobytes().decode("utf-8")).astype(np.uint32)
    size[one] = np.diff(np.searchsorted(np.cumsum(widths[flat]), np.cumsum(b[one] - a[one])) + 1, prepend=0)
    others = enc.encode_ordinary_batch([raw[x:y].tobytes().decode("utf-8") for x, y in zip(a[rest].tolist(), b[rest].tolist())], num_threads=1)
    size[rest] = [len(x) for x in others]
    flat = np.concatenate([flat, np.fromiter((t for x in others for t in x), dtype=np.uint32)])
    at = np.empty(len(a), dtype=np.int64)
    at[np.concatenate([one, rest])] = np.cumsum(size[np.concatenate([one, rest])]) - size[np.concatenate([one, rest])]
    count = size[back]
    out = flat[_ranges(at[back], at[back] + count)]
    total = np.append(0, np.cumsum(count))
    return out, np.diff(total[np.searchsorted(starts, offsets)])


def frames(ids: np.ndarray, tokens: np.ndarray, counts: np.ndarray, end: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the records, length of each payload): documents ``ids`` with ``counts`` of ``tokens`` each, and ``end`` after them, as numbers of type ``kind``."""
    width = kind.itemsize
    payload = HEAD.size + width * (counts + 1)
    size = payload + 16
    at = np.cumsum(size) - size
    raw = np.zeros(int(size.sum()), dtype=np.uint8)

    def put(where: np.ndarray, values: np.ndarray) -> None:
        raw[(where[:, None] + np.arange(values.itemsize)).ravel()] = values.view(np.uint8).ravel()

    put(at, payload.astype("<u8"))
    put(at + 8, masked(crc32c(raw, at, at + 8)).astype("<u4"))
    put(at + 12, ids.astype("<i8"))
    put(at + 20, (counts + 1).astype("<u4"))
    put(at + 24, np.full(len(ids), width, dtype="<u4"))
    start = at + 28
    put(np.repeat(start - width * (np.cumsum(counts) - counts), counts) + width * np.arange(int(counts.sum())), tokens.astype(kind))
    put(start + width * counts, np.full(len(ids), end, dtype=kind))
    put(at + 12 + payload, masked(crc32c(raw, at + 12, at + 12 + payload)).astype("<u4"))
    return raw, payload


def _write(folder: str, vocabulary: str, end: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (enc, widths), task = encoding(vocabulary), TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        kind = id_type(widths, end)
        name, file, written, shard = "", None, 0, 0
        try:
            for batch in batches:
                ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                for i, j, raw, offsets in slices(batch, "text", min(3 << 20, shard_bytes)):
                    tokens, counts = encode(raw, offsets, enc, widths)
                    data, payload = frames(ids[i:j], tokens, counts, end, kind)
                    if file is None or written >= shard_bytes:
                        if file is not None:
                            file.close()
                        name, written, shard = f"{task.partitionId():05d}-{shard:03d}-{task.taskAttemptId()}.rec", 0, shard + 1
                        file = store.open_output_stream(f"{root}/{name}")
                    file.write(pa.py_buffer(data))
                    at = written + np.cumsum(payload + 16) - (payload + 16)
                    written += len(data)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * (j - i)), pa.array(at, pa.int64()), pa.array(payload, pa.int64()), batch.column(0).slice(i, j - i), pa.array(counts + 1, pa.int32())],
                        names=["shard", "offset", "length", "doc_id", "n_tokens"],
                    )
        finally:
            if file is not None:
                file.close()

    return run


def write_records(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY, end: int = END, shard_bytes: int = 1 << 28) -> DataFrame:
    """Writes the records and returns the offset index: (shard, offset, length, doc_id, n_tokens), with the length of the payload.

    ``folder`` is a URI that all executors reach; without one, a new folder in the shared folder of the session. The index
    is the table ``index`` in it.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    folder = "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    source = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    source.mapInArrow(_write(folder, vocabulary, end, shard_bytes), INDEX).select(F.concat(F.lit(folder + "/"), "shard").alias("shard"), "offset", "length", "doc_id", "n_tokens").write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    """(doc_id, token ids) of one record; both checksums must hold."""
    raw = np.frombuffer(data, dtype=np.uint8)
    (length,) = struct.unpack_from("<Q", data)
    if len(data) != length + 16:
        raise ValueError("a record's length differs from the index")
    found = masked(crc32c(raw, np.array([0, 12]), np.array([8, 12 + length])))
    if (struct.unpack_from("<I", data, 8)[0], struct.unpack_from("<I", data, 12 + length)[0]) != tuple(found.tolist()):
        raise ValueError("a record's checksum is wrong")
    doc_id, n, width = HEAD.unpack_from(data, 12)
    ids = np.frombuffer(data, dtype=f"<u{width}", count=n, offset=12 + HEAD.size)
    return (None if doc_id == NO_ID else doc_id), ids


OPEN_FILES = 64


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: OrderedDict[str, pa.NativeFile] = OrderedDict()  # the files last read, so that a shuffled order doesn't open one again for each record
    try:
        for batch in batches:
            rows = []
            for shard, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if shard in held:
                    held.move_to_end(shard)
                else:
                    if len(held) >= OPEN_FILES:
                        held.popitem(last=False)[1].close()
                    store, path = fs.FileSystem.from_uri(shard)
                    held[shard] = store.open_input_file(path)
                doc_id, ids = parse(held[shard].read_at(length + 16, offset))
                rows.append((doc_id, ids.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], names=["doc_id", "ids"])
    finally:
        for file in held.values():
            file.close()


def read_records(index: DataFrame, seed: int | None = None) -> DataFrame:
    """(doc_id, ids) of the records of an offset index; with a ``seed``, dealt to tasks and ordered within them by a hash of it."""
    if seed is not None:
        order = F.xxhash64(F.lit(seed), "shard", "offset")
        index = index.repartition(order).sortWithinPartitions(order)
    return index.select("shard", "offset", "length").mapInArrow(_read, "doc_id long, ids array<int>")

"""What op3 puts on disk where its filter isn't broadcast, and how it grows with the number of segments."""

import zlib
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from motiva.llm import lm
from motiva.session import shared_dir, sweep


def test_tables_written_for_the_shuffle_are_smaller_than_the_text(spark, docs):
    size = lambda: sum(p.stat().st_size for p in Path(urlparse(shared_dir(spark)).path).rglob("*.parquet"))
    text = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    sweep(spark)
    before = size()
    got = lm.lm_scores(docs, broadcast_bytes=-1)
    rows = got.collect()
    assert size() - before < text
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())


def test_keys_take_as_many_bytes_for_many_segments():
    rng = np.random.default_rng(4)
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{x}" for x in rng.integers(0, 50_000, 1000)) + "\n" for _ in range(200)])], names=["w"])

    def size(segments):
        return len(zlib.compress(b"".join(b for out in lm._count(3, segments)(iter([batch])) for b in out.column("keys").to_pylist()), 1))

    assert size(1200) < 1.2 * size(8)

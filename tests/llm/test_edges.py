"""Every operator and stage on odd rows and on no rows."""

from collections import Counter

import corpus_pipeline as cp
from motiva.llm.lm import lm_scores
from motiva.llm.media import media_sequences
from motiva.llm.mixing import mix_documents, mix_sources
from motiva.llm.ngram_jaccard import connected, ngram_jaccard_join
from motiva.llm.packing import pack
from motiva.llm.quality import good_documents, keep_good
from motiva.llm.records import read_records, write_records
from motiva.llm.secrets import find_secrets, redact_secrets
from motiva.llm.substrings import shared_passages
from motiva.llm.vectors import nearest_neighbours


def test_jaccard(odd, none):
    got = {(r[0], r[1]): r[2] for r in ngram_jaccard_join(odd).collect()}
    assert got[1, 2] == 1.0 and got[7, 8] > 0.99 and set(got) == {(1, 2), (7, 8)}
    assert ngram_jaccard_join(none).count() == 0
    assert connected(ngram_jaccard_join(none)).count() == 0
    assert {tuple(r) for r in connected(ngram_jaccard_join(odd)).collect()} == {(1, 1), (2, 1), (7, 7), (8, 7)}


def test_packing(odd, none):
    rows = pack(odd, size=64, open_windows=2).collect()
    assert all(0 < r.n_tokens <= 64 and r.n_tokens == sum(r.lengths) for r in rows)
    want = sum(len(r.text.split()) if r.text and r.doc_id not in (5, 11) else 0 for r in odd.collect())
    got = sum(n for r in rows for d, n in zip(r.doc_ids, r.lengths) if d != 11)
    assert got == want and any(d is None for r in rows for d in r.doc_ids)
    assert pack(none).count() == 0


def test_mixing(odd, none):
    every = mix_sources(odd, {"a": 2.0}, other=1.0).collect()
    assert len(every) == odd.count() and {r.source for r in every} == {"", "a", "b", "c", "d"}
    kept = mix_documents(odd, {"a": 2.0}, budget_share=1.0)
    assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    assert mix_sources(none, {}).count() == 0 and mix_documents(none, {}).columns == odd.columns and mix_documents(none, {}).count() == 0


def test_secrets(odd, none):
    assert find_secrets(odd).count() == 0 and find_secrets(none).count() == 0
    assert sorted(map(str, redact_secrets(odd).collect())) == sorted(map(str, odd.collect()))


def test_scores(odd, none):
    rows = lm_scores(odd).collect()
    assert len(rows) == odd.count() and all((r.n_words == 0) == (r.perplexity is None) for r in rows)
    assert lm_scores(none).count() == 0 and lm_scores(none, broadcast_bytes=-1).count() == 0
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_words, round(r.log_prob, 6))
    assert sorted(map(key, rows), key=str) == sorted(map(key, lm_scores(odd, broadcast_bytes=-1).collect()), key=str)


def test_quality(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (9, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    kept = keep_good(odd, labels)
    assert kept.columns == odd.columns and all(r.text and r.doc_id not in (4, 5, 11) for r in kept.collect())
    assert keep_good(odd, labels.where("false")).count() == 10  # those with a word
    assert keep_good(none, labels).count() == 0 and good_documents(none, labels.where("false")).count() == 0


def test_records(odd, none):
    rows = read_records(write_records(odd), seed=1).collect()
    assert len(rows) == odd.where("text is not null").count() and sum(r.doc_id is None for r in rows) == 1
    assert read_records(write_records(none)).count() == 0


def test_substrings(odd, none):
    got = {(r.doc_a, r.doc_b) for r in shared_passages(odd).collect()}
    assert {(1, 2), (7, 8)} <= got and all(a < b for a, b in got)
    assert shared_passages(none).count() == 0


def test_media(spark, none):
    pages = spark.createDataFrame([(1, None, None), (None, "http://x/", "<img src=a>"), (None, "http://x/", "<img src=a>"), (2, "bad:[url", "<p>a<img src='//[x'>"), (3, "u", "x" * 500_000)], "page_id long, url string, html string")
    rows = media_sequences(pages).collect()
    assert len(rows) == 5 and sorted(r.n_media for r in rows) == [0, 0, 1, 1, 1]
    assert media_sequences(pages.where("false")).count() == 0


def test_vectors(spark):
    nan = float("nan")
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, None), (None, [1.0, 1.0]), (4, [1.0]), (5, [nan, 1.0]), (6, [0.0, 1.0]), (7, [None, 1.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r)[:3] for r in nearest_neighbours(df, k=5).collect())
    assert got == [(1, 1, 2), (1, 2, 6), (2, 1, 6), (2, 2, 1), (6, 1, 2), (6, 2, 1)]
    clash = df.selectExpr("*", "'x' as id", "'x' as v", "'x' as shard", "'x' as kind", "'x' as a", "'x' as near", "'x' as `d.e`")
    assert got == sorted(tuple(r)[:3] for r in nearest_neighbours(clash, k=5, shards=2).collect())
    assert nearest_neighbours(df.where("false")).count() == 0 and nearest_neighbours(df.where("vec_id = 3")).count() == 0


def test_stages(spark, odd, none, sf):
    for docs in (odd, none):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, sf)
            rows = out.collect()
            assert bool(rows) == (docs is odd), name
            if name != cp.STAGES[-1][0]:
                assert out.columns == docs.columns
                assert not Counter(map(str, rows)) - Counter(map(str, docs.collect())), name
    ids = lambda stage: sorted((r.doc_id for r in stage(spark, odd, sf).collect()), key=str)
    assert ids(cp.near_duplicates) == sorted([1, 3, None, None, 4, 5, 6, 7, 9, 9, 10, 11], key=str)
    assert ids(cp.secrets) == sorted((r.doc_id for r in odd.collect()), key=str)
    assert not {3, 4, 5, 11} & set(ids(cp.quality))
    words = sum(len(r.text.split(None)) for r in cp.mixing(spark, odd, sf).where("text is not null and doc_id <> 11").collect())
    assert words <= 0.9 * sum(len(r.text.split()) for r in odd.collect() if r.text) + 10

import pytest

SF = "/root/testdata/sf0.001"
CLASH = ["__doc", "__source", "__tokens", "__key", "__bucket", "__finish", "__row", "__t", "__words", "__good", "w", "words", "hi", "lo", "sig", "grams", "path", "kind", "seed", "place", "rep", "left", "n", "count", "group", "quality", "id", "v", "shard", "segment", "a.b", "c`d e", "slice", "path_hash", "c0", "p", "__id", "__n"]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, texts that share a doc_id, and clashing columns."""
    long = " ".join(f"word{i % 9973}x{i % 7}" for i in range(150_000))
    same = "the quick brown fox jumps over the lazy dog and then runs far away from here " * 6
    rows = [
        (1, same, "en", "a", 10), (1, same, "en", "a", 10), (2, same, "en", None, None), (3, None, None, "a", 5), (None, same + "end", "en", "b", 3), (None, None, None, None, None),
        (4, "", "en", "a", 0), (5, " \n\t ", "en", "b", 4), (6, "one", "de", "b", 3), (7, long, "en", "c", len(long)), (8, long + " tail", "en", "c", 1), (9, "shared id first text " * 30, "en", "a", 1), (9, "shared id other words " * 30, "en", "a", 1),
        (10, "éàü ñandú ßtraße 東京 " * 40, "xx", "d", 9), (11, "　\xa0!!! ... ###", "xx", "d", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASH))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")

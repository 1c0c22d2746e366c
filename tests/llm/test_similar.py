"""Links and classes of similar documents against all pairs."""

import random

import pytest

from motiva.llm import similar_documents as similar

from .test_operators import grams


def brute(rows, least=0.5):
    """{(doc_id, class_id, links)} of distinct (doc_id, set), all pairs compared."""
    sets = {}
    for d, t in rows:
        if grams(t):
            sets.setdefault(grams(t), set()).add(d)
    nodes, root, links = list(sets), list(range(len(sets))), [0] * len(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(nodes):
        for j, y in enumerate(nodes[:i]):
            if min(len(x), len(y)) >= least * max(len(x), len(y)) and (both := len(x & y)) and both / (len(x) + len(y) - both) >= least:
                links[i] += len(sets[y])
                links[j] += len(sets[x])
                root[find(i)] = find(j)
    first = {}
    for i, x in enumerate(nodes):
        first[find(i)] = min(first.get(find(i), 10**18), *sets[x], min(sets[x]))
    return sorted((d, first[find(i)], links[i] + len(sets[x]) - 1) for i, x in enumerate(nodes) for d in sets[x])


def cases(docs):
    rng = random.Random(1)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    word = lambda: f"w{rng.randrange(10**6)}"
    for k in range(150):  # near copies, more than a block
        w = rows[3][1].split()[:120]
        for _ in range(k % 9):
            w[rng.randrange(len(w))] = word()
        rows.append((10_000 + k, " ".join(w)))
    for k in range(400):  # just at the threshold, where minhash buckets miss some: 4 of 8 n-grams in common
        own = [word() for _ in range(8)]
        rows += [(20_000 + 2 * k, " ".join(own)), (20_001 + 2 * k, " ".join([*own[:6], word(), word()]))]
    for k in range(0, 800, 2):  # 20 of 40 n-grams
        own, a, b = ([word() for _ in range(n)] for n in (22, 10, 10))
        rows += [(30_000 + k, " ".join(own + a)), (30_001 + k, " ".join(own + b))]
    return rows + rows[-5:] + [(40_000, rows[-1][1]), (40_000, rows[-3][1]), (5, "one"), (6, "one"), (7, " ")]


@pytest.mark.parametrize("grouped", [True, False])
def test_no_link_is_lost(spark, docs, monkeypatch, grouped):
    monkeypatch.setattr(similar, "SIDE", 40)
    rows = cases(docs)
    got = similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), grouped=grouped).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_odd_rows(odd, none):
    got = sorted(tuple(r) for r in similar.similar_documents(odd).collect())
    assert {r[:1] + r[2:] for r in got if r[0] in (1, 2, 7, 8)} == {(1, 1), (2, 1), (7, 1), (8, 1)} and {r[1] for r in got if r[0] in (7, 8)} == {7}
    assert [r[0] for r in got] == [1, 2, 6, 7, 8, 9, 9, 10, 11]
    assert similar.similar_documents(none).count() == 0


def test_overlaps():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, n)).astype(np.uint32) for n in (1, 5, 4000, 6000, 7000)]
    assert similar.overlaps(sets, sets[1:]).tolist() == [[len(np.intersect1d(x, y)) for y in sets[1:]] for x in sets]

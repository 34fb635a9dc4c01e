"""Near-duplicate vectors against all pairs: recall, links, components; awkward vectors, hot buckets, dimensions."""

import numpy as np
import pytest

from spanweave.llm import vector_links
from spanweave.llm.vector_links import fit_quantiser, unit_vectors


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def brute(rows, similarity=0.98):
    n = len(rows)
    unit = {i: unit_vectors(np.array([rows[i][1]], float))[0] for i in range(n) if rows[i][2] is not None and usable(rows[i][1])}
    links = [[] for _ in range(n)]
    for i in unit:
        for j in unit:
            if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= similarity:
                links[i].append(j)
                links[j].append(i)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in links[i]:
            root[find(i)] = find(j)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    return sorted([(rows[i][0], len(links[i]), least[find(i)], rows[i][0] == least[find(i)]) for i in range(n)], key=str)


def family(rng, n, dim, spread):
    middle = rng.normal(size=dim)
    return [(middle + rng.normal(size=dim) * spread * np.linalg.norm(middle) / dim ** 0.5).tolist() for _ in range(n)]


def awkward(rng):
    vectors = [(v, int(rng.integers(0, 3))) for v in rng.normal(size=(150, 16)).tolist()]
    for n, spread in ((40, 0.05), (25, 0.12), (2, 0.01), (30, 0.16)):
        vectors += [(v, 1) for v in family(rng, n, 16, spread)]
    v = vectors[0][0]
    vectors += [(v, vectors[0][1])] * 5 + [(v, None), (v, 7), ([x * 1e200 for x in v], vectors[0][1]), ([x * 1e-200 for x in v], vectors[0][1])]
    vectors += [(None, 1), ([], 1), ([0.0] * 16, 1), ([None] + v[1:], 1), ([float("nan")] + v[1:], 1), ([float("inf")] * 16, 1), ([1.0], 1), ([3.0], 1), ([-1.0], 1), ([1.0, 0.1], 1), ([1.0, 0.11], 1)]
    rows = [(i, v, label) for i, (v, label) in enumerate(vectors)]
    return rows + [(None, v, 7), (4, rows[4][1], rows[4][2]), (4, rows[160][1], 1), (None, rows[160][1], 1)]


@pytest.mark.parametrize("block", [2048, 7])
def test_links_by_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vector_links, "BLOCK", block)
    rows = awkward(np.random.default_rng(1))
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "vector_id bigint, vector array<double>, label int, n string, h int, component_id int").repartition(3)
    found = vector_links.link_vectors(df)
    assert found.columns == ["vector_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_no_vectors_and_none_that_can_link(spark):
    shape = "vector_id bigint, vector array<float>, label string"
    assert vector_links.link_vectors(spark.createDataFrame([], shape)).count() == 0
    found = vector_links.link_vectors(spark.createDataFrame([(1, None, "a"), (2, [1.0], None)], shape))
    assert sorted(map(tuple, found.collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_recall_at_the_threshold_and_balance():
    """Pairs exactly at the threshold among many others: nine of ten must meet, and bits split the sample evenly."""
    rng = np.random.default_rng(3)
    a = unit_vectors(rng.normal(size=(4000, 64)) * np.linspace(2, 0.2, 64))
    u = rng.normal(size=a.shape)
    u -= (u * a).sum(axis=1)[:, None] * a
    b = 0.98 * a + (1 - 0.98 ** 2) ** 0.5 * unit_vectors(u)
    quantiser = fit_quantiser([0] * len(a), a, 200_000, 0.98)
    x, y = quantiser.codes([0] * len(a), a), quantiser.codes([0] * len(b), b)
    assert (x == y).any(axis=1).mean() > 0.97
    share = ((a - a.mean(axis=0)) @ quantiser.rotations[0] > 0).mean(axis=0)
    assert abs(share - 0.5).max() < 0.1
    for t in range(x.shape[1]):  # a bucket holds a small part of the vectors
        assert np.bincount(np.unique(x[:, t], return_inverse=True)[1]).max() < 200

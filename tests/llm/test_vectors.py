import numpy as np
import pytest

from bytesieve.llm.cap_filters import Code, near_vectors


def plain(rows, least):
    ok = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, []).append(np.array(v, float) / np.linalg.norm(v))
    ids = [i for i, vs in ok.items() for _ in vs]
    x = np.array([v for vs in ok.values() for v in vs])
    near = x @ x.T >= least
    top = {i: i for i, _ in rows}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for a, b in zip(*np.nonzero(near), strict=True):
        a, b = find(ids[a]), find(ids[b])
        top[max(a, b)] = min(a, b)
    links = {i: 0 for i, _ in rows}
    for k, i in enumerate(ids):
        links[i] = int(near[k].sum()) - 1
    return {i: (links[i], find(i)) for i in links}


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(200)]
    centre = rng.standard_normal(16)
    rows += [(300 + i, (centre + 0.03 * rng.standard_normal(16)).tolist()) for i in range(400)]  # more than one block
    rows += [(1000 + i, rows[5][1]) for i in range(30)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15),
             (2004, [None] + [1.0] * 15), (2005, [float("inf")] + [1.0] * 15)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows],
                                  "vec_id long, embedding array<double>, `filter` string, w int")
    out = near_vectors(table, 0.95)
    got = {r.id: (r.links, r.component) for r in out.collect()}
    want = plain(rows, 0.95)
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in got)
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert all(got[i] == want[i] for i in want if i >= 1000 or i == 5)


def test_near_vectors_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert near_vectors(spark.createDataFrame([], schema)).count() == 0
    out = near_vectors(spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (None, [1.0, 0.0], 1), (3, [1.0], 0)], schema))
    assert {(r.id, r.links, r.component, r.kept) for r in out.collect()} == {
        (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (None, 0, None, True)}


def pairs(d, cosine, m, seed):
    rng = np.random.default_rng(seed)
    x, z = rng.standard_normal((2, m, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    return x, cosine * x + (1 - cosine ** 2) ** 0.5 * z / np.linalg.norm(z, axis=1, keepdims=True)


@pytest.mark.parametrize("d, n", [(64, 10_000), (64, 1_000_000), (64, 10_000_000), (4, 100_000), (2, 1000)])
def test_recall_for_every_number_of_vectors(d, n):
    code = Code(d, n)
    x, y = pairs(d, 0.951, 1000, 9)
    a, b = code.filters(x), code.filters(y)
    assert max(len(f) for f in a + b) <= 28
    assert d < 64 or min(len(f) for f in a + b) == 28
    assert all(np.array_equal(f, np.unique(f)) for f in a)
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b, strict=True)]) >= 0.995


def test_filters_are_the_nearest():
    code = Code(6, 1000)
    x, _ = pairs(6, 0.9, 20, 1)
    turned = x @ code.turn
    score = (turned[:, :3] @ code.books[0].T)[:, :, None] + (turned[:, 3:] @ code.books[1].T)[:, None, :]
    want = np.sort(np.argsort(-score.reshape(20, -1), axis=1)[:, :28], axis=1)
    assert np.array_equal(np.array(code.filters(x)), want)

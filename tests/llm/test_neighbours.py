import numpy as np
import pytest

from strandsift.llm.neighbours import Block, Codes, nearest

SCHEMA = "vec_id long, embedding array<float>, rank string"


def truth(ids, x, query, k):
    """(id, distance) of the nearest, without the query's own id."""
    away = np.sqrt(((x.astype(np.float64) - x[query].astype(np.float64)) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, away)) if ids[i] != ids[query]]
    return [(int(ids[i]), float(away[i])) for i in order[:k]]


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for own in out.values():
        assert [x[0] for x in own] == list(range(1, len(own) + 1))
    return {q: [(i, s) for _, i, s in own] for q, own in out.items()}


def clusters(n, d, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, d))
    return (centres[rng.integers(40, size=n)] + 0.15 * rng.normal(size=(n, d))).astype(np.float32)


@pytest.mark.parametrize(("make", "d"), [(clusters, 32), (lambda n, d: np.random.default_rng(1).normal(size=(n, d)).astype(np.float32), 64), (clusters, 5)])
def test_recall(spark, make, d):
    x = make(3000, d)
    ids = np.arange(3000)
    found = results(nearest(spark.createDataFrame([(int(i), v.tolist(), "r") for i, v in zip(ids, x, strict=True)], SCHEMA)))
    assert sorted(found) == list(range(0, 3000, 100))
    hits = 0
    for q, own in found.items():
        best = truth(ids, x, q, 10)
        assert len(own) == 10
        assert [s for _, s in own] == sorted(s for _, s in own)
        hits += len({i for i, _ in own} & {i for i, _ in best})
        for i, s in own:
            assert s == pytest.approx(np.sqrt(((x[i].astype(np.float64) - x[q].astype(np.float64)) ** 2).sum()), abs=1e-12)
    assert hits / (10 * len(found)) >= 0.9


@pytest.mark.parametrize("radius", [0, 2, 5, 9, 14, 40])
def test_probing_finds_all_within_the_radius(radius):
    x = clusters(4000, 48)
    model = Codes(x[:1000])
    block = Block(np.arange(4000), x, model)
    for q in range(0, 4000, 400):
        code = block.codes[q]
        assert np.array_equal(np.sort(block.within(code, radius)), np.flatnonzero(np.bitwise_count(block.codes ^ code) <= radius))


def test_without_a_radius_it_is_exact(spark):
    x = clusters(500, 16, 3)
    df = spark.createDataFrame([(int(i), v.tolist(), "r") for i, v in enumerate(x)], SCHEMA)
    found = results(nearest(df, radius=16, block_rows=100))
    for q, own in found.items():
        assert [i for i, _ in own] == [i for i, _ in truth(np.arange(500), x, q, 10)]
    narrow = results(nearest(df, radius=0))  # too few are within it: searched again
    assert all(len(own) == 10 for own in narrow.values())


@pytest.mark.parametrize("radius", [16, None, 0])
def test_an_id_with_many_vectors(spark, radius):
    """Its own rows don't take up its neighbours' places, whatever the radius; nor do another id's many rows."""
    rng = np.random.default_rng(5)
    x = np.concatenate([clusters(400, 16, 3), np.float32([2.0] * 16) + 0.001 * rng.normal(size=(60, 16)).astype(np.float32), np.float32([-2.0] * 16) + 0.001 * rng.normal(size=(30, 16)).astype(np.float32)])
    ids = np.r_[np.arange(1000, 1400), np.full(60, 100), np.full(30, 7)]
    found = nearest(spark.createDataFrame([(int(i), v.tolist(), "r") for i, v in zip(ids, x, strict=True)], SCHEMA), radius=radius, block_rows=100).collect()
    assert not any(r.query_id == r.vec_id for r in found)
    expected = [(int(ids[q]), r + 1, i, pytest.approx(s, abs=1e-9)) for q in range(len(ids)) if ids[q] % 100 == 0 for r, (i, s) in enumerate(truth(ids, x, q, 10))]
    assert len(found) == len(expected)
    if radius == 16:
        key = lambda x: (x[0], x[1], x[3] if isinstance(x[3], float) else x[3].expected)
        assert [tuple(r) for r in sorted(found, key=lambda r: (r[0], r[1], r[3]))] == sorted(expected, key=key)


def test_many_equal_vectors(spark):
    x = np.concatenate([np.tile(np.float32([1, 2, 3, 4]), (1500, 1)), clusters(300, 4)])
    ids = np.random.default_rng(0).permutation(1800)
    found = results(nearest(spark.createDataFrame([(int(i), v.tolist(), "r") for i, v in zip(ids, x, strict=True)], SCHEMA)))
    assert sorted(found) == list(range(0, 1800, 100))
    equal = sorted(int(i) for i in ids[:1500])
    for q in (int(i) for i in ids[:1500] if i % 100 == 0):
        assert found[q] == [(i, 0.0) for i in equal if i != q][:10]


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (100, [nan, 1.0]), (200, [inf, 1.0]), (300, [None, 1.0]), (400, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (5, [0.0, 1.0]), (5, [0.0, 1.0]), (0, [0.5, 0.0]), (600, [-0.0, 2.0])]
    found = results(nearest(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).where("query_id = 600"))
    assert [i for i, _ in found[600]] == [5, 0, 1, 0]


def test_few_rows(spark):
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert nearest(spark.createDataFrame([(0, [0.0], "x"), (100, None, "x")], SCHEMA)).count() == 0
    assert nearest(spark.createDataFrame([(0, [1.0], "x")], SCHEMA)).count() == 0
    assert results(nearest(spark.createDataFrame([(0, [1.0], "x"), (7, [3.0], "x")], SCHEMA))) == {0: [(7, 2.0)]}


def test_lengths_are_searched_apart(spark):
    rng = np.random.default_rng(7)
    own = {n: [(int(i), rng.normal(size=n).astype(np.float32)) for i in range(at, at + 150)] for n, at in ((3, 0), (8, 1000))}
    found = results(nearest(spark.createDataFrame([(i, v.tolist(), "r") for rows in own.values() for i, v in rows], SCHEMA), radius=8))
    assert sorted(found) == [0, 100, 1000, 1100]
    for rows in own.values():
        ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
        for q in np.flatnonzero(ids % 100 == 0).tolist():
            assert [i for i, _ in found[ids[q]]] == [i for i, _ in truth(ids, x, q, 10)]


def test_probing_meets_few_rows_of_clustered_vectors():
    """By tables at every radius; how many rows they meet depends on the vectors."""
    x = clusters(20_000, 48)
    block = Block(np.arange(20_000), x, Codes(x[:5000]))
    for q in range(0, 20_000, 1000):
        block.within(block.codes[q], block.model.radius)
    assert block.touched / 20 < 0.3 * 20_000

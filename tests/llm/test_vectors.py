import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenfold.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, v string, id string, cell int"


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i) if i is not None else None, None if r is None else [None if t is None else float(t) for t in r], 0, "x", "y", 1) for i, r in zip(ids, x)], SCHEMA)


def groups(rng, n, d, near):
    """Random directions, some of them in groups of close ones."""
    x = rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(0, n // 3, 5):
        x[k : k + 5] = x[k] + near * rng.standard_normal((5, d)) / np.sqrt(d)
    return x.astype(np.float32).astype(float)


def exact_neighbours(ids, x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:k]
    return [(int(ids[j]), d[j]) for j in order]


@pytest.mark.parametrize("candidates,block", [(16_384, 1024), (150, 3)])
def test_search_against_brute_force(spark, candidates, block):
    rng = np.random.default_rng(0)
    x, ids = groups(rng, 500, 24, 0.4), np.arange(500)
    f = frame(spark, ids, x)
    got = {}
    for r in vectors.nearest(f, f.where(F.col("vec_id") % 100 == 0), candidates=candidates, block=block).collect():
        got.setdefault(r["query_id"], []).append(r)
    hits = 0
    for q in range(0, 500, 100):
        rows = sorted(got[q], key=lambda r: r["rank"])
        want = exact_neighbours(ids, x, q)
        assert [r["rank"] for r in rows] == list(range(1, 11))
        at = {i: d for i, d in exact_neighbours(ids, x, q, 500)}
        assert all(abs(r["score"] - at[r["vec_id"]]) < 1e-12 for r in rows)
        hits += len({i for i, _ in want} & {r["vec_id"] for r in rows})
    assert hits / 50 >= 0.9


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((800, 32)), rng.standard_normal((20, 32))
    turn, centre = vectors.rotation(128, 0), x.mean(0)
    estimate, error = vectors.squared_bounds(q, *vectors.encode(x, centre, turn), centre, turn, 3.0)
    true = ((q[:, None] - x[None]) ** 2).sum(2)
    assert (np.abs(estimate - true) <= error).mean() > 0.98 and np.corrcoef(estimate.ravel(), true.ravel())[0, 1] > 0.9


def test_search_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (1, [1, 0]), (2, [1, 0]), (3, None), (4, [0, 0]), (5, [nan, 1]), (6, [inf, 1]), (7, [None, 1]), (8, []), (9, [1, 2, 3]), (None, [5, 5]), (100, [0, 1])]
    f = frame(spark, *zip(*rows))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in vectors.neighbours_query(f).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, 1.414214), (100, 1, 0, 1.414214), (100, 2, 1, 1.414214), (100, 3, 2, 1.414214)]
    assert vectors.neighbours_query(f.limit(0)).count() == 0


def brute_links(x, threshold=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        before = label.copy()
        i, j = np.nonzero(near)
        np.minimum.at(label, i, label[j])
        label = label[label]
        if (label == before).all():
            return near.sum(1), label


@pytest.mark.parametrize("cell_rows,block", [(500, 2048), (40, 7)])
def test_near_vectors_against_brute_force(spark, cell_rows, block):
    rng = np.random.default_rng(2)
    x = groups(rng, 300, 24, 0.25)
    x[200:230] = x[200]  # copies
    x[230:240] = 3 * x[200]  # the same direction at another length
    ids = np.arange(300) * 2 + 5
    links, label = brute_links(x)
    got = {r["vec_id"]: r for r in vectors.near_vectors(frame(spark, ids, x), cell_rows=cell_rows, block=block).collect()}
    found = np.array([got[i]["n_links"] for i in ids])
    assert (found <= links).all() and found.sum() >= 0.98 * links.sum()
    same = np.array([got[i]["component_id"] for i in ids]) == ids[label]
    assert same.mean() > 0.98 and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


@pytest.mark.parametrize("rank", [3, 6])
def test_near_vectors_of_low_rank_lose_no_link(spark, rank):
    rng = np.random.default_rng(rank)
    x = rng.standard_normal((800, rank)) @ rng.standard_normal((rank, 64))
    ids = np.arange(800)
    f = frame(spark, ids, x.astype(np.float32))
    links, label = brute_links(x.astype(np.float32).astype(float))
    got = {r["vec_id"]: r for r in vectors.near_vectors(f, cell_rows=50, block=100).collect()}
    assert links.sum() > 0
    assert [got[i]["n_links"] for i in ids] == links.tolist()
    assert [got[i]["component_id"] for i in ids] == label.tolist()


def test_near_vectors_odd_rows(spark):
    rows = [(1, [1, 0]), (1, [1, 0]), (2, [0, 1]), (3, None), (4, [0, 0]), (5, [float("nan"), 1]), (None, [1, 0]), (6, [1, 2, 3])]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in vectors.near_vectors_query(frame(spark, *zip(*rows))).collect())
    assert got == [(0, 0, 0, False), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True)]
    assert vectors.near_vectors_query(frame(spark, [1], [[1, 0]]).limit(0)).count() == 0


def test_lengths_are_searched_and_linked_by_themselves(spark):
    rng = np.random.default_rng(4)
    x, y = groups(rng, 60, 8, 0.2), groups(rng, 40, 5, 0.2)
    ids = np.arange(100)
    f = frame(spark, ids, [*x, *y])
    got = vectors.nearest(f, f.where(F.col("vec_id") % 10 == 0), candidates=7, block=2).collect()
    for q in range(0, 100, 10):
        own, first = (x, 0) if q < 60 else (y, 60)
        want = [(i + first, round(d, 9)) for i, d in exact_neighbours(np.arange(len(own)), own, q - first)]
        assert [(r["vec_id"], round(r["score"], 9)) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
    found = {r["vec_id"]: r for r in vectors.near_vectors(f, cell_rows=10, block=4).collect()}
    for own, first in ((x, 0), (y, 60)):
        links, label = brute_links(own)
        assert [found[i + first]["n_links"] for i in range(len(own))] == links.tolist()
        assert [found[i + first]["component_id"] for i in range(len(own))] == (label + first).tolist()


def test_one_id_with_several_vectors_and_heavy_groups(spark):
    rng = np.random.default_rng(5)
    x = groups(rng, 90, 16, 0.2)
    x[30:75] = x[30]  # half of all rows are copies of one vector
    ids = np.arange(90) // 2
    links, label = brute_links(x)
    f = frame(spark, ids, x)
    got = vectors.near_vectors(f, cell_rows=20, block=9, heavy_rows=5).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted(zip(ids.tolist(), links.tolist(), ids[label].tolist()))
    rows = vectors.nearest(f, f.where(F.col("vec_id") == 3)).collect()  # two vectors: two queries
    assert sorted(r["rank"] for r in rows) == sorted([*range(1, 11)] * 2) and 3 not in {r["vec_id"] for r in rows}


def test_cells_are_fitted_to_the_rows():
    rng = np.random.default_rng(6)
    loose = vectors.unit_rows(rng.standard_normal((4000, 64)))
    centres = rng.standard_normal((200, 64))
    tight = vectors.unit_rows(np.repeat(centres, 20, 0) + 0.05 * rng.standard_normal((4000, 64)))
    far = vectors.reach(0.95)
    costs = [vectors.cost_of(x, vectors.fitted_cells(x, 10**7, 8192, far), 10**7, 8192, far) for x in (loose, tight)]
    assert costs[1] < costs[0] / 2 and len(vectors.spherical_kmeans(tight, 300)) >= 280

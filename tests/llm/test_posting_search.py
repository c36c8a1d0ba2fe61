"""Nearest neighbours by posting lists, against brute force."""

import numpy as np
import pytest

from sparkward.llm import posting_search

SCHEMA = "vec_id long, embedding array<float>, label string, rid string, k1 int"


def searched(spark, rows):
    frame = spark.createDataFrame([(i, v, "x", "y", 1) for i, v in rows], SCHEMA).repartition(3)
    found = {}
    for r in posting_search.search_nearest(frame).collect():
        found.setdefault(r.query_id, []).append(r)
    return {q: sorted(rs, key=lambda r: r["rank"]) for q, rs in found.items()}


def brute(rows, query, top=20):
    vec = dict(rows)[query]
    scored = [(-sum(float(a) * float(b) for a, b in zip(vec, v)), i) for i, v in rows if i != query]
    return [(i, -s) for s, i in sorted(scored)[:top]]


def points(seed, n, dim=16, tight=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[:tight] = x[0] + 0.01 * rng.normal(size=(tight, dim))
    return x.astype(np.float32)


@pytest.mark.parametrize(("n", "tight", "stretched"), [(1500, 0, False), (1500, 600, False), (900, 0, True)])
def test_recall_and_scores(spark, n, tight, stretched):
    x = points(n + tight, n, tight=tight)
    x = x * np.linspace(0.2, 5, n)[:, None].astype(np.float32) if stretched else x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    found = searched(spark, rows)
    assert sorted(found) == list(range(0, n, 20))
    hits = 0
    for q, got in found.items():
        scores = x.astype(float) @ x[q].astype(float)
        assert [r["rank"] for r in got] == list(range(1, 21)) and q not in {r.vec_id for r in got}
        assert np.allclose([r.score for r in got], [scores[r.vec_id] for r in got], rtol=0, atol=1e-9)
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        hits += len({r.vec_id for r in got} & {i for i, _ in brute(rows, q)})
    assert hits >= 0.9 * 20 * len(found)


def test_copies_are_found_in_order_of_ids(spark):
    x = points(3, 60)
    rows = [(i, [float(c) for c in (x[0] if i % 3 == 0 else x[i])]) for i in range(60)] + [(1000 + i, [float(c) for c in x[0]]) for i in range(300)]
    found = searched(spark, rows)
    for q in (0, 1000, 1020, 1280):
        ids = [i for i in range(0, 60, 3) if i != q] + [i for i in range(1000, 1300) if i != q]
        if q == 0 or q >= 1000:
            assert [r.vec_id for r in found[q]] == ids[:20]
    assert [r.vec_id for r in found[20]][:20] == [i for i, _ in brute(rows, 20)]


def test_few_rows_give_all_candidates(spark):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(points(4, 7))]
    assert [(r.vec_id, pytest.approx(r.score)) for r in searched(spark, rows)[0]] == brute(rows, 0)
    assert searched(spark, rows[:1]) == {} and searched(spark, []) == {}


def test_odd_rows(spark):
    good = [(i, [float(c) for c in v]) for i, v in enumerate(points(5, 25, 4))]
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (120, []), (140, [0.0] * 4), (160, [1.0, None, 1.0, 1.0]), (180, [nan, 1.0, 1.0, 1.0]), (200, [inf, 1.0, 1.0, 1.0]), (220, [1.0] * 3)]
    found = searched(spark, good + bad)
    assert sorted(found) == [0, 20]
    for q in found:
        assert [(r.vec_id, pytest.approx(r.score)) for r in found[q]] == brute(good, q)


def test_repeated_and_null_ids(spark):
    x = [[float(c) for c in v] for v in points(6, 6, 4)]
    found = searched(spark, [(0, x[0]), (0, x[1]), (3, x[2]), (None, x[3]), (None, x[3])])
    assert len(found[0]) == 8 and sorted(r["rank"] for r in found[0]) == [1, 1, 2, 2, 3, 3, 4, 4]
    assert sum(r.vec_id is None for r in found[0]) == 4


def test_walks_reach_what_is_near():
    x = points(7, 4000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = posting_search.fitted(x, 200, 1.0, 20)
    asked = posting_search.directions(x[:100])
    away = posting_search.distances(asked, index.centres)
    reached = posting_search.walked(asked, index, 1.2)
    wanted = away <= 1.2 * away.min(1, keepdims=True) - 1e-3
    assert np.isfinite(reached[wanted]).mean() > 0.97
    own, _ = posting_search.homes(posting_search.lifted(x, 1.0), index)
    sizes = np.bincount(own[:, 0], minlength=200)
    assert sizes.max() < 4 * sizes.mean()

"""The network's slopes, sums over tasks, saved states, and what it finds that a linear projection misses."""

import numpy as np
import pytest

from sparkward.operators import models, network


def curve(n, outliers, seed=1):
    """Points along a curve in four dimensions, and outliers off it but within its range on each axis."""
    rng = np.random.default_rng(seed)
    t = rng.uniform(-1.5, 1.5, n)
    good = np.stack([t, t**2, np.sin(2 * t), t**3 / 3], 1) + 0.03 * rng.normal(size=(n, 4))
    bad = np.stack([rng.uniform(-1.5, 1.5, outliers), rng.uniform(0, 2.2, outliers), rng.uniform(-1, 1, outliers), rng.uniform(-1, 1, outliers)], 1)
    return np.concatenate([good, bad])


def frame(spark, points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, a double, b double, c double, d double").repartition(4)


def better(errors, n):
    """The share of pairs of an outlier (ids from n on) and a good row in which the outlier's error is larger."""
    good, bad = np.array([e for i, e in errors.items() if i < n]), np.array([e for i, e in errors.items() if i >= n])
    return float((bad[:, None] > good).mean())


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_slopes_are_finite_differences(n):
    rng = np.random.default_rng(n)
    x, values = rng.normal(size=(7, n)), network.flat(*network.started(n, n)) + 0.1
    _, slopes = network.gradient(x, *network.shaped(values, n))
    for k in range(len(values)):
        up, down = values.copy(), values.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        numeric = (network.gradient(x, *network.shaped(up, n))[0] - network.gradient(x, *network.shaped(down, n))[0]) / 2e-6
        assert slopes[k] == pytest.approx(numeric, abs=1e-5)


def test_widths():
    assert network.widths(8) == [8, 6, 4, 2, 4, 6, 8] and network.widths(2) == [2, 1, 1, 1, 1, 1, 2]


def test_tasks_sum_to_one_pass(spark):
    x = np.random.default_rng(3).normal(size=(500, 4))
    rows = spark.createDataFrame([(list(map(float, r)),) for r in x], "x array<double>").repartition(7)
    values = network.flat(*network.started(4))
    size, loss, slopes = network.summed_gradient(rows, values, 4)
    expected = network.gradient(x, *network.shaped(values, 4))
    assert size == 500 and loss == pytest.approx(expected[0]) and np.allclose(slopes, expected[1])


def test_curved_outliers(spark):
    df, names = frame(spark, curve(2000, 40)), ["a", "b", "c", "d"]
    fitted = network.fit_network(df.filter("id < 2000"), names, steps=150)
    found = {r.key: r.error for r in network.network_errors(df, "id", fitted).collect()}
    linear = {r.key: r.error for r in models.reconstruction_errors(df, "id", names).collect()}
    assert better(found, 2000) > better(linear, 2000) + 0.1 and better(found, 2000) > 0.9


def test_a_fit_goes_on_from_what_is_saved(spark, tmp_path):
    df, names, folder = frame(spark, curve(300, 0)), ["a", "b", "c", "d"], str(tmp_path / "state")
    whole = network.fit_network(df, names, steps=12, batch=100)
    network.fit_network(df, names, steps=8, batch=100, folder=folder, saved=4)
    assert network.last_saved(spark, folder)[0] == 8
    further = network.fit_network(df, names, steps=12, batch=100, folder=folder, saved=4)
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(whole.weights, further.weights, strict=True))


def test_no_rows_and_constant_columns(spark):
    df = frame(spark, curve(20, 0)).selectExpr("id", "a", "1.0D AS k", "CAST(NULL AS double) AS z")
    fitted = network.fit_network(df.limit(0), ["a", "k"], steps=2)
    assert network.network_errors(df.limit(0), "id", fitted).count() == 0
    fitted = network.fit_network(df, ["a", "k", "z"], steps=2)
    assert all(np.isfinite(r.error) for r in network.network_errors(df, "id", fitted).collect())

"""The maps: memberships, the graph and the layout."""

from __future__ import annotations

import numpy as np
import pytest

from lodestar.plans import map2d


def items(spark, vectors):
    return spark.createDataFrame([(7 * k + 3, v) for k, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")


def test_components_equal_a_decomposition(spark):
    v = np.random.default_rng(5).normal(size=(70, 6)) * np.array([5, 3, 1, 1, 0.5, 0.1])
    at = {r["vec_id"]: (r["x"], r["y"]) for r in map2d.map_2d(items(spark, v).repartition(3)).collect()}
    centred = v - v.mean(axis=0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2]
    axes = axes * np.sign(axes[range(2), np.abs(axes).argmax(axis=1)])[:, None]
    assert np.allclose([at[7 * k + 3] for k in range(70)], centred @ axes.T)


def test_memberships_add_up():
    rng = np.random.default_rng(1)
    d = np.sort(rng.random((50, 15)) + 0.2, axis=1)
    w = map2d.memberships(d, 15)
    assert np.allclose(w.sum(axis=1), np.log2(15), atol=1e-6)
    assert (w[:, 0] == 1).all() and (np.diff(w, axis=1) <= 0).all()
    copies = map2d.memberships(np.zeros((2, 4)), 4)
    assert (copies == 1).all()


def test_curve_is_the_published_one():
    a, b = map2d.curve(0.1)
    assert (a, b) == (pytest.approx(1.577, abs=0.01), pytest.approx(0.895, abs=0.005))


def test_graph_joins_both_directions(spark):
    rng = np.random.default_rng(2)
    near = {q: [(g, float(d)) for g, d in zip(rng.permutation([x for x in range(9) if x != q])[:4], np.sort(rng.random(4)), strict=True)] for q in range(9)}
    rows = spark.createDataFrame([(q, int(g), d) for q, own in near.items() for g, d in own], "q long, g long, d double")
    w = np.zeros((9, 9))
    for q, own in near.items():
        w[q, [g for g, _ in own]] = map2d.memberships(np.array([[d for _, d in own]]), 4)[0]
    w = w + w.T - w * w.T
    got = {(r["a"], r["b"]): r["weight"] for r in map2d.fuzzy_graph(rows, 4).collect()}
    assert set(got) == set(zip(*(x.tolist() for x in np.nonzero(w)), strict=True))
    assert all(x == pytest.approx(w[k]) for k, x in got.items())


def test_layout_keeps_neighbours_together(spark):
    """Classes on circles that no plane shows apart: neighbours in the map are of one class, and more so than by components."""
    rng = np.random.default_rng(3)
    labels = np.arange(160) % 4
    angle = rng.uniform(0, 2 * np.pi, 160)
    vectors = 0.05 * rng.normal(size=(160, 8))
    vectors[np.arange(160), 2 * labels] += np.cos(angle)
    vectors[np.arange(160), 2 * labels + 1] += np.sin(angle)
    rows = items(spark, vectors)
    same = {}
    for name, points in (("components", map2d.map_2d(rows)), ("layout", map2d.neighbour_map(rows, epochs=12))):
        at = {r["vec_id"]: (r["x"], r["y"]) for r in points.collect()}
        xy = np.array([at[7 * k + 3] for k in range(160)])
        d = ((xy[:, None] - xy) ** 2).sum(axis=2)
        np.fill_diagonal(d, np.inf)
        same[name] = np.mean(labels[np.argsort(d, axis=1)[:, :5]] == labels[:, None])
        assert np.isfinite(xy).all()
    assert same["layout"] > 0.9 and same["layout"] > same["components"] + 0.1, same


def test_layout_repeats_and_takes_few_points(spark):
    rows = items(spark, np.random.default_rng(4).normal(size=(20, 3)))
    a, b = (sorted(map(tuple, map2d.neighbour_map(rows, 4, epochs=2).collect())) for _ in range(2))
    assert np.allclose(a, b) and len(a) == 20
    assert map2d.neighbour_map(rows.limit(2)).count() == 2
    assert map2d.neighbour_map(rows.limit(0)).count() == 0

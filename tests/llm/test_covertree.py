"""The cover tree: pruning that loses nothing, and how much it prunes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import covertree


def unit(points):
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def clustered(seed, groups, each, width=16, noise=0.02):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(groups, width))
    return unit(np.repeat(unit(centres), each, axis=0) + noise * draw.normal(size=(groups * each, width)))


def brute(points, threshold):
    product = points @ points.T >= threshold
    np.fill_diagonal(product, False)
    counts, root = product.sum(1), np.arange(len(points))
    while True:
        low = np.array([min(root[k], root[np.flatnonzero(product[k])].min(initial=root[k])) for k in range(len(points))])
        if (low == root).all():
            return counts, root
        root = low


SHAPES = {
    "clusters": lambda: clustered(1, 30, 12),
    "loose": lambda: clustered(2, 12, 25, noise=0.12),
    "unclustered": lambda: unit(np.random.default_rng(3).normal(size=(300, 16))),
    "one ball": lambda: clustered(4, 1, 400, noise=0.05),
    "on the edge": lambda: unit(np.concatenate([clustered(5, 40, 1), clustered(5, 40, 1) + 0.0809 * np.random.default_rng(6).normal(size=(40, 16))])),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("once", [50, 4_000_000])
def test_links_within_and_between_blocks(monkeypatch, shape, once):
    monkeypatch.setattr(covertree, "AT_ONCE", once)
    monkeypatch.setattr(covertree, "ASIDE", 37)
    points = SHAPES[shape]()
    half = len(points) // 3
    for a, b, same in ((points, points, True), (points[:half], points[half:], False)):
        nets = covertree.Nets(a, 0.08)
        found = list(covertree.linked(nets, nets if same else covertree.Nets(b, 0.08), 0.95, same))
        got = [(min(i, j), max(i, j)) if same else (i, j) for x, y in found for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        want = np.argwhere(a @ b.T >= 0.95).tolist()
        want = [(i, j) for i, j in want if not same or i < j]
        assert sorted(got) == want  # each pair once


def test_nets_cover():
    points = clustered(7, 20, 30)
    nets = covertree.Nets(points, 0.08)
    assert len(nets.at) >= 1
    members = [[k] for k in range(len(points))]
    for at, radii, below in zip(nets.at, nets.radii, nets.below, strict=True):
        members = [[p for k in group.tolist() for p in members[k]] for group in below]
        assert sorted(p for m in members for p in m) == list(range(len(points)))
        for centre, radius, own in zip(at, radii, members, strict=True):
            assert np.linalg.norm(points[own] - points[centre], axis=1).max() <= radius + 1e-12


@pytest.mark.parametrize("shape", SHAPES)
def test_same_as_brute_force(spark, shape):
    points = SHAPES[shape]().astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(points)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"block": F.lit(1), "key": F.lit("x"), "n": F.lit(2)})
    exact = unit(points.astype(np.float64))
    counts, root = brute(exact, 0.95)
    got = sorted(tuple(r) for r in covertree.near_duplicates(table, block=40, sample=100).select("vec_id", "n_links", "component_id").collect())
    assert got == [(i, int(counts[i]), int(root[i])) for i in range(len(points))]


def test_most_leaf_pairs_are_pruned_on_clustered_data():
    """Leaves by two hundred clusters: under a tenth of the pairs survive, and none that could hold a link is lost."""
    points = clustered(8, 200, 40)
    tree = covertree.Upper(points[::5])
    path, away = tree.place(points)
    nodes = {x for level in path for x in level.tolist()}
    inside = {x: np.unique(np.flatnonzero((path == x).any(0))) for x in nodes}
    radius = {x: float(np.linalg.norm(points[inside[x]] - tree.centres[x], axis=1).max()) for x in nodes}
    blocks = covertree.Blocks(tree, {x: len(inside[x]) for x in nodes}, radius, 60)
    leaves = [x for x in nodes if blocks.leaf[x] and all(not blocks.leaf[y] for y in ancestors(tree, x))]
    survived = {tuple(x) for x in blocks.leaf_pairs(0.316).tolist()}
    assert len(leaves) > 100 and len(survived) < 0.1 * len(leaves) ** 2 / 2
    own = {int(p): x for x in leaves for p in inside[x]}
    assert len(own) == len(points)
    for i, j in np.argwhere(points @ points.T >= 0.95).tolist():
        assert (min(own[i], own[j]), max(own[i], own[j])) in survived
    where, pairs = blocks.tables(0.316)
    assert where.num_rows == len({x for x in path[-1].tolist()}) and max(where["parts"].to_pylist()) == 1 and pairs.num_rows >= len(set(where["block"].to_pylist()))


def ancestors(tree, node):
    while node:
        node = tree.parent[node]
        yield node

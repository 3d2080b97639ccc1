"""Hard negatives against a plain computation with Python's integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, is_anchor, positives=5, wanted=3, window=(50, 95)):
    best = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x * 256) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        best[i] = min(best.get(i, (label, q)), (label, q))
    width = max((len(q) for _, q in best.values()), default=0)
    best = {i: (label, q + [0] * (width - len(q))) for i, (label, q) in best.items()}
    found = []
    for a, (label, q) in best.items():
        if not is_anchor(a):
            continue
        score = {b: sum(x * y for x, y in zip(q, r, strict=True)) for b, (_, r) in best.items() if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if best[b][0] == label][:positives]:
            fits = [b for b in order if best[b][0] != label and window[0] * score[p] <= 100 * score[b] <= window[1] * score[p]]
            found += [(a, p, k + 1, b, score[p], score[b]) for k, b in enumerate(fits[:wanted])]
    return sorted(found)


def clustered(seed, n, width=8, hot=0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, width))
    rows = [(i, (centres[i % 6] + 0.2 * draw.normal(size=width)).tolist(), int(draw.integers(4))) for i in range(n)]
    return rows + [(n + i, rows[0][1], i % 3) for i in range(hot)]


@pytest.mark.parametrize("words", [1, 3, None])
def test_same_as_plain(spark, monkeypatch, words):
    monkeypatch.setattr(negatives, "ROWS", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    rows = clustered(1, 400, hot=150)  # one vector holds a quarter of all rows
    df = spark.createDataFrame(rows, SCHEMA)
    found = negatives.mine(df, F.col("vec_id") % 5 == 0, words=words)
    got = sorted(tuple(r) for r in found.collect())
    assert got == plain(rows, lambda i: i % 5 == 0) and len(got) > 300


def test_odd_rows(spark):
    rows = clustered(2, 60, width=4)
    rows += [
        (100, None, 1), (101, [1.0, None, 0.0, 0.0], 1), (102, [float("nan")] * 4, 1), (103, [float("inf"), 0.0], 1),
        (104, [0.5], 2), (105, [], 0), (106, [0.0] * 4, 0), (None, [1.0] * 4, 1), (107, [1.0] * 4, None),
        (108, [0.5, 0.5, 0.5, 0.5], 3), (108, [0.5, 0.5, 0.5, 0.5], 3), (108, [0.1, 0.1, 0.1, 0.1], 1), (-10, [2.0] * 6, 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"cell": F.lit("x"), "split": F.lit(1), "score": F.lit(2.0)})
    got = sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 2 == 0).collect())
    assert got == plain(rows, lambda i: i % 2 == 0)
    assert negatives.mine(df.limit(0), F.col("vec_id") % 2 == 0).count() == 0
    assert negatives.mine(df.limit(0), F.col("vec_id") % 2 == 0).columns == negatives.mine(df, F.lit(True)).columns
    assert negatives.mine(df.filter("vec_id < 0"), F.lit(True)).count() == 0


def test_large_components_are_exact(spark):
    draw = random.Random(4)
    rows = [(i, [float(draw.randrange(1, 1 << 20)) for _ in range(4)], i % 2) for i in range(30)]
    got = sorted(tuple(r) for r in negatives.mine(spark.createDataFrame(rows, SCHEMA), F.lit(True)).collect())
    assert got == plain(rows, lambda i: True) and got


def test_walk_goes_down_and_bounds_hold():
    draw = np.random.default_rng(5)
    points = np.floor(256 * draw.normal(size=(500, 6)))
    index = negatives.Index(negatives.codebook(points[:, :3], 5), negatives.codebook(points[:, 3:], 5))
    cell, away1, away2 = index.place(points)
    index.measure([(c, (cell == c).sum(), away1[cell == c].max(), away2[cell == c].max()) for c in set(cell.tolist())])
    for anchor in points[:20]:
        seen = list(index.walk(anchor))
        assert [b for b, _, _ in seen] == sorted((b for b, _, _ in seen), reverse=True)
        assert sorted(c for _, _, c in seen) == sorted(set(cell.tolist()))
        for bound, least, c in seen:
            scores = points[cell == c] @ anchor
            assert least <= scores.min() and scores.max() <= bound


def test_far_cells_are_not_visited():
    points = np.concatenate([np.floor(256 * (5 * np.eye(8)[k] + 0.01 * np.random.default_rng(k).normal(size=(50, 8)))) for k in range(8)])
    index = negatives.Index(negatives.codebook(points[:, :4], 5), negatives.codebook(points[:, 4:], 5))
    cell, away1, away2 = index.place(points)
    index.measure([(c, (cell == c).sum(), away1[cell == c].max(), away2[cell == c].max()) for c in set(cell.tolist())])
    own = int((points @ points[0]).max())
    visited = list(negatives.needed(index, points[0], [own], [own // 2], None))
    assert len(visited) == 1 and len(set(cell.tolist())) == 8
    assert list(negatives.needed(index, points[0], [own], [own // 2], [own // 2])) == []


def test_bundles_cover_cells():
    sizes = np.array([0, 3, 4, 50, 1, 0, 9, 10, 200, 2])
    base, splits = negatives.bundles(sizes, 10)
    held = {}
    for c, n in enumerate(sizes.tolist()):
        for b in range(base[c], base[c] + splits[c]):
            held[b] = held.get(b, 0) + n / splits[c]
    assert max(held.values()) <= 10 and splits[8] == 20

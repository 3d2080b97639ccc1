"""Embedding near-dedup: exact cosine links by a dual traversal of a cover tree.

Unit vectors with cosine c lie sqrt(2 - 2c) apart, so a threshold on cosine is a radius on the sphere.
The upper levels are nested nets of pivots whose radii halve from level to level, fitted on a bounded
sample; every vector goes down to its nearest pivot level by level, and each node's covering radius is
measured over all its vectors. Node pairs are followed downwards from (root, root), level by level: a
pair is pruned if its centres are further apart than both covering radii and the threshold radius, and
nodes of at most a block of vectors are leaves. Larger leaves are cut into blocks.

A pair of blocks that survives meets in one task, where the levels go on: each block gets nested nets
from a fraction of the threshold radius upwards, net points are compared from the coarsest level down with
the same bound, and only members of net points that cannot be pruned are verified in double precision.

A task returns the number of links of each vector and a spanning forest of the links it found, so
groups of many near copies do not give all their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import components, land, ship

#: Vectors that the upper levels are fitted on, pivots below a node, upper levels, and vectors of a block.
SAMPLE, PIVOTS, LEVELS, BLOCK = 4096, 16, 3, 8192
#: Radius of the first upper level.
TOP = 1.0
#: Added to every bound against rounding.
SLACK = 1e-9
#: Pairs of points handled at once, and those whose vectors are laid side by side.
AT_ONCE, ASIDE = 4_000_000, 100_000


def net(points: np.ndarray, radius: float, limit: int) -> np.ndarray:
    """Positions of a net: farthest-first, until all points are within the radius or the limit is met."""
    chosen = [0]
    away = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(limit, len(points)) and away.max() > radius:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return np.array(chosen)


class Upper:
    """The upper levels over a bounded sample: centre, parent and children of each node; node 0 is the root."""

    def __init__(self, points: np.ndarray, pivots: int = PIVOTS, levels: int = LEVELS, radius: float = TOP):
        self.centres, self.parent, self.children, self.levels = [points[0]], [0], [[]], levels
        todo = [(0, points, 0)]
        while todo:
            node, members, level = todo.pop()
            if level == levels or len(members) < 2:
                continue
            below = members[net(members, radius / 2**level, pivots)]
            own = _nearest(members, below)[0]
            for k, centre in enumerate(below):
                self.children[node].append(len(self.centres))
                todo.append((len(self.centres), members[own == k], level + 1))
                self.centres.append(centre)
                self.parent.append(node)
                self.children.append([])
        self.centres = np.array(self.centres)

    def place(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, distances to their centres), a row for the root and each level; a node without children stays."""
        path = [np.zeros(len(points), np.int64)]
        for _ in range(self.levels):
            at = path[-1].copy()
            for node in np.unique(at):
                if self.children[node]:
                    here = path[-1] == node
                    below = np.array(self.children[node])
                    at[here] = below[_nearest(points[here], self.centres[below])[0]]
            path.append(at)
        return np.array(path), np.array([np.linalg.norm(points - self.centres[x], axis=1) for x in path])


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best = (points @ centres.T).argmax(axis=1)
    return best, np.linalg.norm(points - centres[best], axis=1)


def unit(rows: list) -> np.ndarray:
    """Rows scaled to length 1 in double precision; a common power-free scaling first avoids overflow."""
    points = np.array(rows, np.float64)
    points /= np.abs(points).max(axis=1, keepdims=True)
    return points / np.sqrt((points * points).sum(axis=1, keepdims=True))


def _local(points: np.ndarray, spread: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(the net point of each point, by position; how far its members' own members reach) of a greedy net.

    Each point joins the first net point within the radius; `spread` is how far each point's own members
    lie around it.
    """
    own = np.full(len(points), -1, np.int64)
    least, rough = 1 - radius * radius / 2, points.astype(np.float32)
    for at in range(0, len(points), 512):
        rows = at + np.flatnonzero(own[at:at + 512] < 0)
        if not len(rows):
            continue
        near = rough[rows] @ rough.T >= least
        near[np.arange(len(rows)), rows] = True
        lonely = np.count_nonzero(near, axis=1) == 1
        own[rows[lonely]] = rows[lonely]
        for k in np.flatnonzero(~lonely):
            if own[rows[k]] < 0:
                own[near[k] & (own < 0)] = rows[k]
    reach = np.where(own == np.arange(len(points)), 0.0, np.linalg.norm(points - points[own], axis=1)) + spread
    radii = np.zeros(len(points))
    np.maximum.at(radii, own, reach)
    return own, radii


class Nets:
    """Nested nets of a block of points: at each level the positions of its net points, their covering radii, and
    the positions of the level below (in the end, of the points) that each of them holds."""

    def __init__(self, points: np.ndarray, finest: float, coarsest: float = TOP):
        self.points, self.rough = points, points.astype(np.float32)
        self.at, self.radii, self.below = [], [], []
        here, spread, radius = np.arange(len(points)), np.zeros(len(points)), finest
        while radius <= coarsest and len(here) > 1:
            # A level that would hardly thin the points out costs more, in bounds for each pair, than it saves.
            probe = self.rough[here[:: max(1, len(here) // 256)]] @ self.rough[here].T >= 1 - radius * radius / 2
            if (np.count_nonzero(probe, axis=1) > 1).mean() >= (0.5 if self.at else 0.25):
                own, radii = _local(points[here], spread, radius)
                kept = np.unique(own)
                order = np.argsort(own, kind="stable")
                self.below.append(np.split(order, np.flatnonzero(np.diff(own[order])) + 1))
                self.at.append(here[kept])
                self.radii.append(radii[kept])
                here, spread = here[kept], radii[kept]
            radius *= 2

    def level(self, high: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(points, covering radii) of positions in a level; level 0 are the points themselves."""
        return (self.at[high - 1][x], self.radii[high - 1][x]) if high else (x, np.zeros(len(x)))


def _expand(groups: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the chosen, position below) for all members of the chosen net points."""
    sizes = np.fromiter((len(groups[x]) for x in chosen.tolist()), np.int64, len(chosen))
    return np.repeat(np.arange(len(chosen)), sizes), np.concatenate([groups[x] for x in chosen.tolist()] or [np.zeros(0, np.int64)])


def _products(a: Nets, b: Nets, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    found = np.empty(len(i))
    for at in range(0, len(i), ASIDE):
        part = slice(at, at + ASIDE)
        found[part] = np.einsum("ij,ij->i", a.points[i[part]], b.points[j[part]])
    return found


def _grid(a: Nets, b: Nets, i: np.ndarray, j: np.ndarray, least: np.ndarray | float, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (p in i, q in j) whose product reaches `least`; if not `exact`, perhaps some that miss it by little.

    Single precision sorts out; what it leaves is looked at again, as a whole where that is much.
    """
    rough = np.float32(2e-7 * a.points.shape[1] + 1e-5)
    p, q = np.nonzero(a.rough[i] @ b.rough[j].T >= np.asarray(least, np.float32) - rough)
    if not exact:
        return p, q
    if 20 * len(p) > len(i) * len(j):
        return np.nonzero(a.points[i] @ b.points[j].T >= least)
    sure = _products(a, b, i[p], j[q]) >= least
    return p[sure], q[sure]


def linked(a: Nets, b: Nets, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i in a, j in b) of all pairs with cosine >= threshold, in portions.

    If both are the same block, each pair of different points comes once, in either order.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    everything = [np.arange(len(x.at[-1]) if x.at else len(x.points)) for x in (a, b)]
    todo = list(_portions(len(a.at), len(b.at), *everything, same))
    while todo:
        high_a, high_b, x, y, form = todo.pop()
        (at_a, radius_a), (at_b, radius_b) = a.level(high_a, x), b.level(high_b, y)
        last = not high_a and not high_b
        if form == "pairs":
            bound = np.minimum(radius_a + radius_b + reach + SLACK, 2.0)
            least = threshold if last else 1 - bound * bound / 2 - SLACK
            good = _products(a, b, at_a, at_b) >= least
            x, y = x[good], y[good]
        else:
            bound = np.minimum(radius_a[:, None] + radius_b[None, :] + reach + SLACK, 2.0) if not last else 0.0
            p, q = _grid(a, b, at_a, at_b, threshold if last else 1 - bound * bound / 2 - SLACK, last)
            x, y = x[p], y[q]
            if form == "triangle":
                x, y = x[x <= y], y[x <= y]
        if last:
            yield (x[x != y], y[x != y]) if same else (x, y)
            continue
        down_a, down_b = high_a >= high_b, high_b >= high_a
        below = [a.below[high_a - 1] if down_a else None, b.below[high_b - 1] if down_b else None]
        sizes = np.ones(len(x), np.int64)
        for groups, z in zip(below, (x, y), strict=True):
            if groups is not None:
                sizes *= np.fromiter((len(groups[k]) for k in z.tolist()), np.int64, len(x))
        large = sizes > AT_ONCE // 4
        for k in np.flatnonzero(large).tolist():  # two large groups are a grid of their own
            u, v = (np.array([z]) if groups is None else groups[z] for groups, z in zip(below, (x[k], y[k]), strict=True))
            todo += _portions(high_a - down_a, high_b - down_b, u, v, same and x[k] == y[k])
        x, y, sizes = x[~large], y[~large], sizes[~large]
        for rows in np.split(np.arange(len(x)), np.flatnonzero(np.diff(np.cumsum(sizes) // (AT_ONCE // 4))) + 1):
            u, v, own = x[rows], y[rows], x[rows] == y[rows]
            if below[0] is not None:
                which, u = _expand(below[0], u)
                v, own = v[which], own[which]
            if below[1] is not None:
                which, v = _expand(below[1], v)
                u, own = u[which], own[which]
            if same:  # the pairs of a group with itself, once
                once = ~own | (u <= v)
                u, v = u[once], v[once]
            if len(u):
                todo.append((high_a - down_a, high_b - down_b, u, v, "pairs"))


def _portions(high_a: int, high_b: int, x: np.ndarray, y: np.ndarray, same: bool):
    step = max(1, AT_ONCE // max(1, len(y)))
    return ((high_a, high_b, x[at:at + step], y, "triangle" if same else "grid") for at in range(0, len(x), step))


def forest(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """The smallest position that each of `size` positions is connected to."""
    root = np.arange(size)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def _points(table: pa.Table) -> np.ndarray:
    raw = table.column("vector").to_pylist()
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def _meet(threshold: float):
    finest = math.sqrt(max(0.0, 2 - 2 * threshold)) / 4

    def run(table: pa.Table) -> pa.Table:
        side, key, weight = (table.column(x).to_numpy() for x in ("side", "key", "n"))
        order = np.lexsort((key, side))
        side, key, weight = side[order], key[order], weight[order]
        points = _points(table.take(pa.array(order)))
        second = np.flatnonzero(side == 1)
        first = np.flatnonzero(side != 1)
        counts, root = np.zeros(len(key)), np.arange(len(key))
        if len(first) and (len(second) or side[0] == 2):
            left = Nets(points[first], finest)
            same = not len(second)
            for i, j in linked(left, left if same else Nets(points[second], finest), threshold, same):
                i, j = first[i], (first if same else second)[j]
                counts += np.bincount(i, weights=weight[j], minlength=len(key)) + np.bincount(j, weights=weight[i], minlength=len(key))
                root = forest(np.append(i, np.arange(len(key))), np.append(j, root), len(key))
        some = np.flatnonzero(counts > 0)
        return pa.table({
            "key": pa.array(key[some], pa.int64()), "links": pa.array(counts[some].astype(np.int64)),
            "other": pa.array(key[root[some]], pa.int64()),
        })
    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept) from (vec_id, embedding).

    Vectors that are null, empty, all zero, or hold a null or non-finite number link with nothing:
    n_links 0 and their own id as component. Vectors of different lengths never link. Equal vectors
    are one class, compared once and counted in full. component_id is the smallest vec_id reachable,
    a null vec_id being larger than all; kept is whether it is the row's own. Repeated rows count as
    vectors of their own. Other columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    plain = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.coalesce(
        (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0), F.lit(False),
    )
    plain = plain.withColumn("embedding", F.when(sound, F.col("embedding")))
    classes = land(
        plain.filter("embedding is not null").groupBy("embedding")
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumn("key", F.monotonically_increasing_id()),
        "classes",
    )
    counted, edges = None, None
    for width in sorted(r[0] for r in classes.select(F.size("embedding")).distinct().collect()):
        met = _traverse(classes.filter(F.size("embedding") == width), threshold, block, sample, width)
        counted = met if counted is None else counted.unionAll(met)
    schema = "key long, links long, other long"
    counted = land(counted if counted is not None else spark.createDataFrame([], schema), "links")
    links = counted.groupBy("key").agg(F.sum("links").alias("links"))
    edges = counted.filter("key <> other").select(F.col("key").alias("a"), F.col("other").alias("b"))
    roots = components(edges).withColumnsRenamed({"node": "key"})
    rooted = classes.select("key", "first", "n").join(links, "key", "left").join(roots, "key", "left").select(
        "key", "first", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("key", "n_links", "component_id").join(classes.select("key", "embedding"), "key")
    alone = plain.filter("embedding is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    found = plain.filter("embedding is not null").join(named, "embedding").select("vec_id", "n_links", "component_id")
    return found.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _traverse(classes: DataFrame, threshold: float, block: int, sample: int, width: int) -> DataFrame:
    """(key, links, other) of all classes of one vector length."""
    spark = classes.sparkSession
    total = classes.count()
    share = min(1.0, 1.5 * sample / total)
    drawn = classes.filter(F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    rows = [r[0] for r in drawn.select("embedding").limit(sample).collect()]
    if not rows:
        rows = [r[0] for r in classes.select("embedding").limit(1).collect()]
    upper = spark.sparkContext.broadcast(Upper(unit(rows)))  # bounded by SAMPLE

    def descend(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            points = unit(batch.column(2).to_pylist())
            path, away = upper.value.place(points)
            vectors = [row.tobytes() for row in points.astype("<f8")]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(vectors, pa.binary()), pa.array(path[-1]),
                 pa.array(list(path.T), pa.list_(pa.int64())), pa.array(list(away.T), pa.list_(pa.float64()))],
                ["key", "n", "vector", "deepest", "path", "away"],
            )

    placed = land(
        classes.select("key", "n", "embedding").mapInArrow(
            descend, "key long, n long, vector binary, deepest long, path array<long>, away array<double>"
        ), "placed",
    )
    # Every node of every level with its size and measured covering radius; as many as the sample allows.
    steps = F.filter(F.arrays_zip("path", "away"), lambda x, i: (i == 0) | (x["path"] != F.get("path", i - 1)))
    nodes = placed.select(F.inline(steps)).groupBy(F.col("path").alias("node")).agg(
        F.count(F.lit(1)).alias("size"), F.max("away").alias("radius")
    ).collect()
    blocks = Blocks(upper.value, {r["node"]: r["size"] for r in nodes}, {r["node"]: r["radius"] for r in nodes}, block)
    where, pairs = blocks.tables(math.sqrt(max(0.0, 2 - 2 * threshold)))
    dealt = placed.select("key", "n", "vector", "deepest").join(F.broadcast(spark.createDataFrame(where)), "deepest").select(
        "key", "n", "vector", "block", F.pmod(F.xxhash64("key"), F.col("parts")).alias("part")
    )
    # The parts of a block meet those of the blocks that it was not pruned from, itself included.
    numbered = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    met = spark.createDataFrame(pairs).withColumn("a", F.explode(numbered("parts_a"))).withColumn("b", F.explode(numbered("parts_b")))
    met = land(met.filter("block_a < block_b or a <= b").select("block_a", "a", "block_b", "b"), "pairs").withColumn(
        "pair", F.monotonically_increasing_id()
    )
    alone = (F.col("block_a") == F.col("block_b")) & (F.col("a") == F.col("b"))
    left = dealt.join(met, (F.col("block") == F.col("block_a")) & (F.col("part") == F.col("a"))).select(
        "pair", F.when(alone, F.lit(2)).otherwise(F.lit(0)).alias("side"), "key", "n", "vector"
    )
    right = dealt.join(met.filter(~alone), (F.col("block") == F.col("block_b")) & (F.col("part") == F.col("b"))).select(
        "pair", F.lit(1).alias("side"), "key", "n", "vector"
    )
    return left.unionAll(right).groupBy("pair").applyInArrow(_meet(threshold), "key long, links long, other long")


class Blocks:
    """The leaves of the upper levels, as blocks of at most `block` vectors, and which of them can hold links.

    A node is a leaf if it has at most `block` vectors or nothing below it; a leaf with more is cut into parts.
    Small leaves below one node that are not pruned from each other share a block.
    """

    def __init__(self, tree: Upper, size: dict[int, int], radius: dict[int, float], block: int):
        self.tree, self.size, self.block = tree, size, block
        self.radius = np.zeros(len(tree.centres))
        for node, r in radius.items():
            self.radius[node] = r
        self.below = {x: [k for k in tree.children[x] if k in size] for x in size}
        self.leaf = {x: size[x] <= block or not self.below[x] for x in size}

    def leaf_pairs(self, reach: float) -> np.ndarray:
        """Pairs of leaves (x <= y) that no level prunes, from (root, root) downwards.

        A pair of nodes is pruned if its centres are further apart than both covering radii and `reach`.
        """
        found, level = [np.zeros((0, 2), np.int64)], np.zeros((min(1, len(self.size)), 2), np.int64)
        leaf, centres = np.array([self.leaf.get(x, True) for x in range(len(self.radius))]), self.tree.centres
        down = {x: np.array([x] if self.leaf[x] else self.below[x], np.int64) for x in self.size}
        while len(level):
            done = leaf[level].all(axis=1)
            found.append(level[done])
            level = level[~done]
            grids = [np.stack(np.meshgrid(down[x], down[y], indexing="ij"), -1).reshape(-1, 2) for x, y in level.tolist()]
            both = np.unique(np.sort(np.concatenate([np.zeros((0, 2), np.int64), *grids]), axis=1), axis=0)
            gap = np.linalg.norm(centres[both[:, 0]] - centres[both[:, 1]], axis=1)
            level = both[gap <= self.radius[both].sum(axis=1) + reach + SLACK]
        return np.concatenate(found)

    def tables(self, reach: float) -> tuple[pa.Table, pa.Table]:
        """(deepest, block, parts): the block of each lowest node; (block_a, parts_a, block_b, parts_b): what can hold links."""
        pairs = self.leaf_pairs(reach)
        leaves = sorted({x for x in self.size if self.leaf[x]} & set(pairs.ravel().tolist()), key=lambda x: (self.tree.parent[x], x))
        place = {x: i for i, x in enumerate(leaves)}
        index = np.zeros(len(self.radius), np.int64)
        index[leaves] = np.arange(len(leaves))
        meets = np.zeros((len(leaves), len(leaves)), bool)
        meets[index[pairs[:, 0]], index[pairs[:, 1]]] = meets[index[pairs[:, 1]], index[pairs[:, 0]]] = True
        block, held, parts = np.zeros(len(leaves), np.int64), [], []
        for i, x in enumerate(leaves):
            total = sum(self.size[leaves[k]] for k in held) + self.size[x]
            if held and (total > self.block or self.tree.parent[leaves[held[0]]] != self.tree.parent[x] or not meets[i, held].all()):
                held = []
            if not held:
                parts.append(0)
            held.append(i)
            block[i] = len(parts) - 1
            parts[-1] = -(-sum(self.size[leaves[k]] for k in held) // self.block)

        def own(node: int) -> int:
            line = [node]
            while line[-1]:
                line.append(self.tree.parent[line[-1]])
            return int(block[place[next(x for x in reversed(line) if self.leaf[x])]])

        lowest = [x for x in self.size if not self.tree.children[x]]
        parts = np.array(parts, np.int64)
        where = np.array([own(x) for x in lowest], np.int64)
        both = np.unique(np.sort(block[index[pairs]], axis=1), axis=0)
        return (
            pa.table({"deepest": np.array(lowest, np.int64), "block": where, "parts": parts[where]}),
            pa.table({"block_a": both[:, 0], "parts_a": parts[both[:, 0]], "block_b": both[:, 1], "parts_b": parts[both[:, 1]]}),
        )

"""Hard negatives by an inverted multi-index.

Vectors are cut into two halves, each half has a codebook, and a cell is a pair of codewords. The
score of an anchor a and a row x of cell (i, j) is at most
<a1, c1_i> + |a1| r1_i + <a2, c2_j> + |a2| r2_j, where r are the largest measured distances of members
from their codeword. For each anchor a heap walks the two sorted lists of half bounds and yields cells
by descending sum, so the search stops at the first cell whose bound is below what has already been found.

Distributed, the walk is two visits. The first takes the cells with the best bounds; what it finds
certifies a least score, and the second takes every other cell whose bound reaches that score. Small
cells that follow each other are bundled and large ones split, for rows and for anchors, so that a
task holds one bundle of each, whatever a cell holds.

Codebooks are fitted on a bounded sample of rows; every row is indexed, radii are measured over all
rows, and results are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import land, ship

#: About so many rows and anchors meet in one task, and so many anchors are scored at once.
ROWS = 4096
ANCHORS = 1024
SLICE = 128
#: Rows the codebooks are fitted on.
SAMPLE = 20_000
#: Share of all rows that the cells of the first visit hold at least.
FIRST_VISIT = 0.02

MOST = (1 << 63) - 1
ROW = "vec_id long, label long, vector binary, cell int, away1 double, away2 double"


def prepared(rows: DataFrame, scale: int) -> DataFrame:
    """Rows that take part: vec_id, label, vector (floor(scale * x) as doubles), one row for each vec_id."""
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda v: v * float(scale))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    plain = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled.alias("embedding")
    ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound)

    def run(batches):
        for batch in batches:
            stops = 8 * np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
            raw = np.floor(pc.list_flatten(batch.column(2)).to_numpy(zero_copy_only=False)).astype("<f8").tobytes()
            vectors = [raw[a:b] for a, b in zip([0, *stops.tolist()], stops.tolist())]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(vectors, pa.binary())], ["vec_id", "label", "vector"])

    packed = plain.mapInArrow(run, "vec_id long, label long, vector binary")
    return packed.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.*")


def matrix(vectors: list[bytes], width: int) -> np.ndarray:
    found = np.zeros((len(vectors), width))
    for row, raw in zip(found, vectors, strict=True):
        values = np.frombuffer(raw, "<f8")
        row[:len(values)] = values
    return found


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of integers held as doubles; beyond 64 bits, the nearest long."""
    top = max(np.abs(left).max(initial=0), 1) * max(np.abs(right).max(initial=0), 1) * max(left.shape[1], 1)
    if top < 2.0 ** 53:
        return (left @ right.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(left) @ whole(right).T
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def codebook(points: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """Centres of k-means that starts from points spread over their order by norm; repeats fall together."""
    points = np.unique(points, axis=0)
    if len(points) <= size:
        return points
    order = np.argsort((points ** 2).sum(1), kind="stable")
    centres = points[order[np.linspace(0, len(order) - 1, size).astype(int)]]
    for _ in range(rounds):
        nearest = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        number = np.bincount(nearest, minlength=size)
        centres = np.where(number[:, None] > 0, sums / np.maximum(number, 1)[:, None], centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(1) - 2 * points @ centres.T, axis=1)


class Index:
    """Codebooks, the radii of their words and of each cell, and the rows of each cell."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.books = (first, second)
        self.half = first.shape[1]
        self.width = self.half + second.shape[1]
        self.cells = len(first) * len(second)

    def measure(self, cells: list) -> None:
        self.size = np.zeros(self.cells, np.int64)
        self.away = np.zeros((2, self.cells))
        for cell, n, away1, away2 in cells:
            self.size[cell] = n
            self.away[:, cell] = away1, away2
        grid = self.away.reshape(2, len(self.books[0]), len(self.books[1]))
        self.radii = grid[0].max(1), grid[1].max(0)

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors[:, :self.half], vectors[:, self.half:]

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell of each vector and the distances of its halves from their codewords."""
        near, away = [], []
        for points, centres in zip(self.halves(vectors), self.books, strict=True):
            at = _nearest(points, centres)
            near.append(at)
            away.append(np.sqrt(((points - centres[at]) ** 2).sum(1)))
        return near[0] * len(self.books[1]) + near[1], *away

    def walk(self, anchor: np.ndarray) -> Iterator[tuple[float, float, int]]:
        """Cells with rows by descending sum of half bounds: (that sum, least score in the cell, cell)."""
        sums, own = [], []
        for part, centres, radii in zip(self.halves(anchor[None]), self.books, self.radii, strict=True):
            norm, dots = np.sqrt((part[0] ** 2).sum()), centres @ part[0]
            # What rounding of these doubles can take away is far below this share of the magnitudes.
            slack = 1e-9 * (norm * (radii + np.sqrt((centres ** 2).sum(1))) + 1)
            sums.append(dots + norm * radii + slack)
            own.append((dots, norm, slack))
        order = [np.argsort(-x, kind="stable") for x in sums]
        heap, seen = [(-(sums[0][order[0][0]] + sums[1][order[1][0]]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            a, b = int(order[0][i]), int(order[1][j])
            cell = a * len(self.books[1]) + b
            if self.size[cell]:
                spread = own[0][1] * self.away[0, cell] + own[1][1] * self.away[1, cell]
                least = own[0][0][a] + own[1][0][b] - spread - own[0][2][a] - own[1][2][b]
                yield -bound, least, cell
            for i, j in ((i + 1, j), (i, j + 1)):
                if i < len(order[0]) and j < len(order[1]) and (i, j) not in seen:
                    seen.add((i, j))
                    heapq.heappush(heap, (-(sums[0][order[0][i]] + sums[1][order[1][j]]), i, j))


def bundles(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first bundle and its number of bundles; small neighbours share one."""
    base, splits, at, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for cell, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            at, held = at + 1, 0
        base[cell], splits[cell] = at, max(1, -(-n // limit))
        held += n
        if n > limit:
            at, held = at + int(splits[cell]), 0
    return base, splits


def build(rows: DataFrame, words: int | None, sample: int) -> tuple[DataFrame, Index]:
    """Rows with their cell, landed, and the index; what the driver sees of it is bounded by the codebooks."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("vector")).alias("bytes")).first()
    words = words or int(min(256, max(4, round(size["n"] ** 0.25))))
    drawn = rows.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    width = max(2, (size["bytes"] or 0) // 8)
    points = matrix([bytes(r["vector"]) for r in drawn], width) if drawn else np.zeros((1, width))
    index = Index(codebook(points[:, :width // 2], words), codebook(points[:, width // 2:], words))

    def run(batches):
        for batch in batches:
            cell, away1, away2 = index.place(matrix(batch.column(2).to_pylist(), index.width))
            yield pa.record_batch(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(away1), pa.array(away2)],
                ["vec_id", "label", "vector", "cell", "away1", "away2"],
            )

    placed = land(rows.select("vec_id", "label", "vector").mapInArrow(run, ROW), "placed")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)), F.max("away1"), F.max("away2")).collect()
    index.measure([tuple(r) for r in cells])
    return placed, index


def dealt(placed: DataFrame, sizes: np.ndarray, limit: int, name: str) -> DataFrame:
    """Each row with its bundle; the table of cells is bounded by the codebooks."""
    base, splits = bundles(sizes, limit)
    cells = placed.sparkSession.createDataFrame(
        [(c, int(base[c]), int(splits[c])) for c in np.flatnonzero(sizes).tolist()], "cell int, base int, splits int"
    )
    number = F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("splits")).cast("int")
    return placed.join(F.broadcast(cells), "cell").withColumn(name, number).drop("base", "splits", "away1", "away2")


def needed(index: Index, anchor: np.ndarray, tops: list[int], lows: list[int], floors: list[int] | None) -> Iterator[int]:
    """Cells of the first visit, or, once `floors` are certified, those of the second.

    A cell matters to a window if its bound reaches the window's least score and its least score does
    not pass the window's top.
    """
    taken, enough = 0, FIRST_VISIT * index.size.sum()
    wanted = lows if floors is None else floors
    for bound, least, cell in index.walk(anchor):
        if taken < enough:
            if bound < min(lows):
                return
            if any(bound >= low and least <= top for top, low in zip(tops, lows, strict=True)):
                taken += index.size[cell]
                if floors is None:
                    yield cell
        elif floors is None or bound < min(wanted):
            return
        elif any(bound >= low and least <= top for top, low in zip(tops, wanted, strict=True)):
            yield cell


VISIT = (
    "vec_id long, label long, vector binary, block int, tops array<long>, lows array<long>,"
    " visits array<struct<bundle: int, cells: binary>>"
)


def _visits(index: Broadcast, base: np.ndarray, splits: np.ndarray):
    def run(batches):
        known = index.value
        for batch in batches:
            rows = batch.to_pylist()
            anchors = matrix([r["vector"] for r in rows], known.width)
            for row, anchor in zip(rows, anchors, strict=True):
                found: dict[int, list[int]] = {}
                for cell in needed(known, anchor, row["tops"], row["lows"], row.pop("floors")):
                    for bundle in range(base[cell], base[cell] + splits[cell]):
                        found.setdefault(bundle, []).append(cell)
                row["visits"] = [{"bundle": b, "cells": np.array(c, "<i4").tobytes()} for b, c in found.items()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("vec_id", pa.int64()), ("label", pa.int64()), ("vector", pa.binary()), ("block", pa.int32()),
                ("tops", pa.list_(pa.int64())), ("lows", pa.list_(pa.int64())),
                ("visits", pa.list_(pa.struct([("bundle", pa.int32()), ("cells", pa.binary())]))),
            ]))
    return run


FOUND = "anchor_id long, number int, other_id long, score long"


def _score(width: int, same: bool, wanted: int):
    """The best `wanted` rows of a bundle in each window of each anchor that visits it."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            left = left.sort_by("vec_id")
            ids, labels, cells = (left.column(x).to_numpy() for x in ("vec_id", "label", "cell"))
            rows = matrix(left.column("vector").to_pylist(), width)
            for lo in range(0, right.num_rows, SLICE):
                asked = right.slice(lo, SLICE)
                _slice(asked, ids, labels, cells, rows, out)
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                        names=["anchor_id", "number", "other_id", "score"])

    def _slice(asked, ids, labels, cells, rows, out):
        own = asked.column("vec_id").to_numpy()
        visits = [np.frombuffer(x, "<i4") for x in asked.column("cells").to_pylist()]
        mine = np.flatnonzero(np.isin(cells, np.concatenate(visits)))
        ids, labels, cells = ids[mine], labels[mine], cells[mine]
        scores = products(matrix(asked.column("vector").to_pylist(), width), rows[mine])
        fits = (labels == asked.column("label").to_numpy()[:, None]) == same
        fits &= ids != own[:, None]
        fits &= np.stack([np.isin(cells, x) for x in visits])
        keys = np.where(fits, -scores, MOST)
        order = np.argsort(keys, axis=1, kind="stable")  # ties stay in the order of vec_id
        keys = np.take_along_axis(keys, order, 1)
        tops, lows = asked.column("tops").to_pylist(), asked.column("lows").to_pylist()
        for i, anchor in enumerate(own.tolist()):
            for number, (top, low) in enumerate(zip(tops[i], lows[i], strict=True)):
                begin = np.searchsorted(keys[i], -top, "left")
                end = min(begin + wanted, np.searchsorted(keys[i], -low, "right"), fits[i].sum())
                for at in range(begin, end):
                    for column, value in zip(out, (anchor, number, int(ids[order[i, at]]), -int(keys[i, at])), strict=True):
                        column.append(value)
    return run


def search(rows: DataFrame, anchors: DataFrame, index: Index, same: bool, wanted: int) -> DataFrame:
    """anchor_id, number, rank, other_id, score: the best `wanted` rows in each window of each anchor.

    `rows` have their bundle; `anchors` have vec_id, label, vector, block and the windows as arrays
    `tops` and `lows`, both ends included. `same` asks for rows of the anchor's label, else of others.
    """
    spark = rows.sparkSession
    base, splits = bundles(index.size, ROWS)
    shared = spark.sparkContext.broadcast(index)
    names = ["vec_id", "label", "vector", "block", "tops", "lows"]

    def visit(asked: DataFrame, label: str) -> DataFrame:
        visits = land(asked.mapInArrow(_visits(shared, base, splits), VISIT), "visits").select(*names, F.inline("visits"))
        pairs = visits.select("bundle", F.col("block").alias("asker")).distinct()
        sent = rows.select("vec_id", "label", "vector", "cell", "bundle").join(pairs, "bundle")
        found = sent.groupBy("bundle", "asker").cogroup(visits.groupBy("bundle", "block")).applyInArrow(
            _score(index.width, same, wanted), FOUND
        )
        return land(_first(found, wanted), label)

    first = visit(anchors.select(*names, F.lit(None).cast("array<long>").alias("floors")), "first")
    # A window with all it wants is certified from its last score on; the others reach down to their end.
    certified = first.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.when(
        F.col("rank") == wanted, F.struct("number", "score")
    ))).alias("least")).withColumnRenamed("anchor_id", "vec_id")
    floors = F.transform("lows", lambda low, i: F.coalesce(F.try_element_at("least", i), low))
    second = visit(anchors.join(certified, "vec_id", "left").select(*names, floors.alias("floors")), "second")
    return _first(first.drop("rank").unionAll(second.drop("rank")), wanted)


def _first(found: DataFrame, wanted: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "number").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= wanted)


def mine(
    rows: DataFrame, anchors: Column, positives: int = 5, wanted: int = 3, scale: int = 256,
    window: tuple[int, int] = (50, 95), words: int | None = None, sample: int = SAMPLE,
) -> DataFrame:
    """Hard negatives of the rows that `anchors` marks: anchor_id, positive_id, rank, negative_id, scores.

    `rows` have vec_id, label and embedding. A score is the inner product of floor(scale * x); a
    positive is one of the anchor's first `positives` other rows of its label, its negatives are the first
    `wanted` rows of other labels whose score is from window[0] to window[1] percent of the positive's.
    Ties go to the smaller vec_id.

    Rows with a null vec_id, label or vector, or with a null component or one that is not finite once
    scaled, take no part. Rows that share a vec_id count once (smallest label, then vector). Shorter vectors end in
    zeros. Scores beyond 64 bits become the nearest long. Anchors without positives, positives
    without negatives and an empty table give no rows. Other columns are not read.

    `words` is the size of each codebook (by default the fourth root of the number of rows, 4 to 256),
    `sample` bounds the rows it is fitted on. Neither changes a result.
    """
    ship(rows.sparkSession)
    placed, index = build(prepared(rows, scale), words, sample)
    if not index.size.sum():
        return rows.sparkSession.createDataFrame([], NEGATIVE)
    by_bundle = dealt(placed, index.size, ROWS, "bundle")
    marked = placed.filter(anchors)
    sizes = np.zeros(index.cells, np.int64)
    for cell, n in marked.groupBy("cell").count().collect():  # bounded by the codebooks
        sizes[cell] = n
    asked = land(dealt(marked, sizes, ANCHORS, "block").select("vec_id", "label", "vector", "block"), "anchors")

    everything = asked.withColumns({"tops": F.array(F.lit(MOST - 1)), "lows": F.array(F.lit(-MOST))})
    own = search(by_bundle, everything, index, True, positives).select(
        "anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    exact = F.col("positive_score").cast("decimal(19,0)")
    windows = own.withColumns({
        "low": F.ceil(exact * F.lit(window[0]) / F.lit(100)).cast("long"),
        "top": F.floor(exact * F.lit(window[1]) / F.lit(100)).cast("long"),
    }).filter("low <= top")
    windows = land(windows.withColumn("number", F.row_number().over(
        Window.partitionBy("anchor_id").orderBy("positive_id")
    ) - 1), "windows")
    listed = windows.groupBy("anchor_id").agg(
        F.array_sort(F.collect_list(F.struct("number", "top", "low"))).alias("w")
    ).select(F.col("anchor_id").alias("vec_id"), F.col("w.top").alias("tops"), F.col("w.low").alias("lows"))
    others = search(by_bundle, asked.join(listed, "vec_id"), index, False, wanted)
    return others.join(windows, ["anchor_id", "number"]).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


NEGATIVE = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"

"""Packing documents into sequences of a fixed window by non-negative least squares.

Documents are cut into whole windows and a rest. The histogram of the rests' lengths, at most one
number for each length below the window, is all the driver sees. It lists shallow combinations of
lengths that fill a window exactly, finds by non-negative least squares how often to repeat each so
that together they use up the histogram, rounds down, and packs what is left greedily: first best
fits that fill a window exactly, then the remaining rests in a row, cut at window ends. The end of
that row becomes sequences whose lengths are powers of two, so that nothing is padded.

Spark ranks the rests of each length (partition by partition, without a group in one task) and the
ranks say which document takes which place.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import land, ship
from quarrylight.llm.tokens import encoder
from quarrylight.session import small_side

#: Lengths that are combined in threes, the most frequent ones.
TRIPLE_LENGTHS = 64
SWEEPS = 40


def combinations(counts: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Twos and threes of present lengths that sum up to the window; counts[l] rests have length l."""
    present = counts > 0
    found = [(a, window - a) for a in range(1, window // 2 + 1) if present[a] and present[window - a]]
    often = sorted(np.argsort(-counts, kind="stable")[:TRIPLE_LENGTHS].tolist())
    often = [x for x in often if present[x]]
    for i, a in enumerate(often):
        for b in often[i:]:
            c = window - a - b
            if c >= b and present[c]:
                found.append((a, b, c))
    return found


def repeat_counts(counts: np.ndarray, columns: list[tuple[int, ...]], sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative x with the least squared difference of sum(x * column) and counts, by coordinate descent."""
    rest = counts.astype(np.float64)
    x = np.zeros(len(columns))
    parts = [(np.array(list(Counter(c))), np.array(list(Counter(c).values()), np.float64)) for c in columns]
    norms = [float(weight @ weight) for _, weight in parts]
    for _ in range(sweeps):
        moved = 0.0
        for j, (at, weight) in enumerate(parts):
            step = max(-x[j], float(weight @ rest[at]) / norms[j])
            if step:
                x[j] += step
                rest[at] -= step * weight
                moved = max(moved, abs(step))
        if moved < 0.01:
            break
    return x


def greedy_fits(counts: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fits, longest first, that fill a window exactly, with their repeats; takes them from counts."""
    found = []
    left = counts.copy()
    for longest in range(window - 1, 0, -1):
        while left[longest]:
            pattern, gap, used = [longest], window - longest, Counter([longest])
            while gap:
                fits = np.flatnonzero(left[1:gap + 1]) + 1
                fits = [x for x in fits[::-1][:4].tolist() if left[x] > used[x]]
                if not fits or len(pattern) > 16:
                    break
                pattern.append(fits[0])
                used[fits[0]] += 1
                gap -= fits[0]
            if gap:
                left[longest] = 0  # stays in counts, for the row that is cut
                break
            times = min(int(left[x]) // n for x, n in used.items())
            for x, n in used.items():
                left[x] -= times * n
                counts[x] -= times * n
            found.append((tuple(pattern), times))
    return found


class Plan:
    """Where the rest of rank k among those of its length goes; sizes depend on the window alone."""

    def __init__(self, histogram: dict[int, int], window: int):
        counts = np.zeros(window, np.int64)
        for length, n in histogram.items():
            counts[length] = n
        counts[0] = 0
        columns = combinations(counts, window)
        patterns = []
        for column, times in zip(columns, np.floor(repeat_counts(counts, columns) + 1e-9).astype(np.int64), strict=True):
            used = Counter(column)
            times = min(int(times), *(int(counts[x]) // n for x, n in used.items()))
            if times:
                for x, n in used.items():
                    counts[x] -= times * n
                patterns.append((column, times))
        patterns += greedy_fits(counts, window)

        rank, rows, sequence = Counter(), [], 0
        for pattern, times in patterns:
            offset = 0
            for length in pattern:
                rows.append((length, rank[length], sequence, offset, 0))
                rank[length] += times
                offset += length
            sequence += times
        self.window, self.tail_sequence, at = window, sequence, 0
        for length in np.flatnonzero(counts).tolist():
            rows.append((length, rank[length], 0, at, 1))
            at += length * int(counts[length])
        self.tail_tokens = at
        self.sequences = sequence + -(-at // window) + bin(at % window).count("1") - (at % window > 0)
        rows.sort()
        self.rows = np.array(rows, np.int64).reshape(-1, 5)
        self.keys = self.rows[:, 0] * (1 << 48) + self.rows[:, 1]

    def places(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the rest, length, sequence, offset) of each piece."""
        if not length:
            return []
        _, first, sequence, offset, cut = self.rows[
            np.searchsorted(self.keys, length * (1 << 48) + rank, "right") - 1
        ].tolist()
        if not cut:
            return [(0, length, sequence + rank - first, offset)]
        found, at, done = [], offset + (rank - first) * length, 0
        while done < length:
            where, inside, room = self._tail(at)
            n = min(room, length - done)
            found.append((done, n, where, inside))
            done += n
            at += n
        return found

    def _tail(self, at: int) -> tuple[int, int, int]:
        whole, inside = divmod(at, self.window)
        last, short = divmod(self.tail_tokens, self.window)
        if whole < last:
            return self.tail_sequence + whole, inside, self.window - inside
        sequence, begin = self.tail_sequence + last, 0
        for bit in reversed(range(short.bit_length())):  # 1300 = 1024 + 256 + 16 + 4
            size = 1 << bit
            if short & size:
                if inside < begin + size:
                    return sequence, inside - begin, begin + size - inside
                sequence, begin = sequence + 1, begin + size
        raise ValueError("beyond the last token")


def _tokenize(path: str, end: int, window: int):
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        part, wholes, ranks = TaskContext.get().partitionId(), 0, Counter()
        known = encoder(path)
        for batch in batches:
            texts = ("" if t is None else t for t in batch.column(1).to_pylist())
            coded, at = known.encode(texts), 0
            while ids := [x + tail for x in islice(coded, 1000)]:
                sizes = [len(x) // 4 for x in ids]
                before, rank = [], []
                for n in sizes:
                    whole, rest = divmod(n, window)
                    before.append(wholes)
                    rank.append(ranks[rest])
                    wholes += whole
                    ranks[rest] += 1
                yield pa.record_batch(
                    [batch.column(0).slice(at, len(ids)), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()),
                     pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64()), pa.array(rank, pa.int64())],
                    ["doc_id", "ids", "n", "part", "wholes", "rank"],
                )
                at += len(ids)
    return run


PIECE = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _cut(plan: Plan, starts: dict[int, int]):
    window, base = plan.window, plan.sequences

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            columns = {name: batch.column(i) for i, name in enumerate(names)}
            n, part, wholes, rank, before = (columns[x].to_pylist() for x in ("n", "part", "wholes", "rank", "before"))
            ids = columns["ids"]
            out, size = [[] for _ in range(7)], 0

            def block(out):
                return pa.record_batch(
                    [columns["doc_id"].take(pa.array(out[0], pa.int64())), *(
                        pa.array(x, pa.binary() if i == 2 else pa.int64()) for i, x in enumerate(out[1:])
                    )],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

            for i, total in enumerate(n):
                raw = ids[i].as_buffer()
                whole, rest = divmod(total, window)
                first = base + starts[part[i]] + wholes[i]
                pieces = [(k * window, window, first + k, 0) for k in range(whole)]
                pieces += [(whole * window + a, m, s, o) for a, m, s, o in plan.places(rest, rank[i] + before[i])]
                for start, length, sequence, offset in pieces:
                    row = (i, start, length, raw[4 * start:4 * (start + length)].to_pybytes(), total, sequence, offset)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    size += length
                if size > 2_000_000:
                    yield block(out)
                    out, size = [[] for _ in range(7)], 0
            yield block(out)
    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of documents with their places: doc_id, start, length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset.

    A document is its token ids and end_id; null and empty texts are end_id alone. Every id is in
    exactly one piece; within a sequence the pieces lie without gaps from offset 0. All sequences
    hold `window` ids but at most a handful at the end, whose lengths are powers of two. Repeated
    rows and repeated or null ids are packed each on its own. Sequence ids are 0, 1, 2, ... without
    gaps. Other columns are not read. An empty table gives no pieces.
    """
    spark = docs.sparkSession
    ship(spark)
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    coded = land(
        plain.mapInArrow(
            _tokenize(tokenizer, end_id, window),
            f"doc_id {kind}, ids binary, n long, part int, wholes long, rank long",
        ).withColumn("rest", (F.col("n") % window).cast("int")),
        "tokens", "zstd",
    )
    by_part = coded.groupBy("part", "rest").agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.floor(F.col("n") / window)).alias("whole")
    )
    by_part = land(by_part, "lengths")
    histogram = {r["rest"]: r["n"] for r in by_part.groupBy("rest").agg(F.sum("count").alias("n")).collect()}
    parts = sorted((r["part"], r["n"]) for r in by_part.groupBy("part").agg(F.sum("whole").alias("n")).collect())
    starts, at = {}, 0
    for part, n in parts:  # one number for each partition
        starts[part] = at
        at += n
    earlier = by_part.selectExpr(
        "part", "rest",
        "sum(count) over (partition by rest order by part rows between unbounded preceding and current row) - count as before",
    )
    placed = coded.join(small_side(land(earlier, "earlier"), materialized=True), ["part", "rest"]).select(
        "doc_id", "ids", "n", "part", "wholes", "rank", "before"
    )
    return placed.mapInArrow(_cut(Plan(histogram, window), starts), f"doc_id {kind}, {PIECE}")

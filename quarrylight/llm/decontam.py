"""Benchmark decontamination by the q-gram lemma.

An item of m bytes that occurs in a document with at most k edits (bytes inserted, deleted or
replaced) keeps at least m + 1 - q (k + 1) of its q-grams, and their diagonals (position in the
document less position in the item) lie within k + 1 neighbouring ones. So the q-grams a document
shares with an item are counted in bands of 2 (k + 1) diagonals that overlap by half; a band below
that bound cannot hold the item. Bands that reach it are verified by alignment over the diagonals of
the band and the budget on both sides of it.

A long item also leaks by a long part: its halves and the half in the middle are looked for in the same
way, each with its own budget. A q-gram that an item repeats, as a row of dashes does, is counted
by how many of its places fall into each band, not place by place.

Texts are compared in lower case with each run of white space as one space, as UTF-8. The benchmark
is the query set: it is taken in blocks of bounded size, and each block meets every document where
that document lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarrylight.llm.common import give_back, ship

Q = 8
RATE = 0.08
#: Bytes of benchmark text in a block, and of documents looked at together.
ITEMS, BLOCK = 4_000_000, 1_000_000
SIEVE = 22
#: Halves of items are looked for from so many bytes on.
PART = 100
#: Places of a q-gram in one item from which on they are counted by band, and entries handled at once.
HEAVY, AT_ONCE = 16, 4_000_000
#: Pairs of texts and documents up to which shared q-grams are first counted as a whole.
PAIRS = 20_000_000


def normalise(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode("utf-8", "replace")


def budget(size: int, rate: float = RATE, q: int = Q) -> int:
    """Edits allowed for an item of `size` bytes; at least one q-gram must then remain."""
    return max(0, min(int(size * rate), size // q - 1))


def grams(raw: bytes) -> np.ndarray:
    """The 8-grams of a byte string as unsigned numbers."""
    count = max(0, len(raw) - Q + 1)
    found = np.empty(count, "<u8")
    for shift in range(min(Q, count)):
        part = np.frombuffer(raw, "<u8", (len(raw) - shift) // Q, shift)
        found[shift::Q] = part[: len(found[shift::Q])]
    return found


def _slot(values: np.ndarray) -> np.ndarray:
    return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SIEVE)


@dataclass
class Postings:
    """For each q-gram (by number) a run of entries."""

    first: np.ndarray
    owner: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, gram: np.ndarray, owner: np.ndarray, place: np.ndarray, grams: int) -> Postings:
        order = np.argsort(gram, kind="stable")
        return cls(np.searchsorted(gram[order], np.arange(grams + 1)), owner[order], place[order])

    def sizes(self, gram: np.ndarray) -> np.ndarray:
        return self.first[gram + 1] - self.first[gram]

    def entries(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the given q-grams, which entry), for all entries of all of them."""
        sizes = self.sizes(gram)
        stops = np.cumsum(sizes)
        return np.repeat(np.arange(len(gram)), sizes), np.repeat(self.first[gram] - stops + sizes, sizes) + np.arange(int(sizes.sum()))


@dataclass
class Items:
    """A block of benchmark texts (items and parts of them) and the postings of their q-grams.

    `light` lists places. In `heavy`, an entry is a q-gram that its text repeats; `table[base + b]` with the
    remainder b of a document's diagonal says into which bands those places fall: a run of (band, count).
    """

    names: list
    part: np.ndarray
    texts: list[bytes]
    edits: np.ndarray
    least: np.ndarray
    sieve: np.ndarray
    values: np.ndarray
    light: Postings
    heavy: Postings
    table: np.ndarray
    bands: np.ndarray
    counts: np.ndarray


def parts(text: bytes) -> list[bytes]:
    """The halves of a long text and the half in its middle."""
    half = len(text) // 2
    return [text[at:at + half] for at in (0, half // 2, len(text) - half)] if half >= PART else []


def compile_items(names: list, texts: list[bytes], rate: float = RATE) -> Items:
    whole = [(i, False, t) for i, t in enumerate(texts)] + [(i, True, p) for i, t in enumerate(texts) for p in parts(t)]
    texts = [t for _, _, t in whole]
    edits = np.array([budget(len(t), rate) for t in texts], np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    all_grams = [grams(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(g) for g in all_grams])
    place = np.concatenate([np.arange(len(g)) for g in all_grams] or [np.zeros(0, np.int64)])
    values, gram = np.unique(np.concatenate(all_grams or [np.zeros(0, "<u8")]), return_inverse=True)
    sieve = np.zeros(1 << SIEVE, bool)
    sieve[_slot(values)] = True

    _, group, number = np.unique(gram * np.int64(len(texts)) + owner, return_inverse=True, return_counts=True)
    often = number[group] > HEAVY
    light = Postings.of(gram[~often], owner[~often], place[~often], len(values))
    runs, bands, counts, heads, bases, at = [], [], [], [], [], 0
    order = np.flatnonzero(often)[np.argsort(group[often], kind="stable")]
    for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
        width = int(edits[owner[rows[0]]]) + 1
        bases.append(len(runs))
        heads.append(rows[0])
        for remainder in range(width):
            band, n = np.unique((remainder - place[rows]) // width, return_counts=True)
            runs.append(at)
            bands.append(band)
            counts.append(n)
            at += len(band)
    heads = np.array(heads, np.int64)
    heavy = Postings.of(gram[heads], owner[heads], np.array(bases, np.int64), len(values))
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return Items(
        [names[i] for i, _, _ in whole], np.array([p for _, p, _ in whole], bool), texts, edits, sizes + 1 - Q * (edits + 1),
        sieve, values, light, heavy, np.array([*runs, at], np.int64), joined(bands), joined(counts),
    )


def align(item: bytes, region: bytes, edits: int, diagonals: int | None = None) -> tuple[int, int, int] | None:
    """(edits, begin, end) of the best occurrence of item in region within the budget, else None.

    It may begin at any of the first `diagonals` bytes of the region (by default all) and stays on those
    diagonals; only they are computed, row by row along the item. Unit costs; `begin` follows the cheapest
    path; of equal ends the first counts.
    """
    at = region.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    if not edits or not item:
        return None
    band = len(region) + 1 if diagonals is None else max(1, diagonals)
    text = np.full(len(item) + band, -1, np.int64)
    held = np.frombuffer(region, np.uint8)[:len(text)]
    text[:len(held)] = held
    places = np.arange(band)
    cost, origin = np.zeros(band, np.int64), places.copy()
    for row, byte in enumerate(item):
        best = cost + (text[row:row + band] != byte)
        start = origin.copy()
        skip = cost[1:] + 1 < best[:-1]  # the byte of the item is missing in the text
        best[:-1][skip] = cost[1:][skip] + 1
        start[:-1][skip] = origin[1:][skip]
        # more bytes of the text along the row: a running minimum of cost less place
        level = best - places
        low = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == low, places, 0))
        cost, origin = low + places, start[source]
        if cost.min() > edits:
            return None
    end = int(cost.argmin())
    if cost[end] > edits:
        return None
    return int(cost[end]), min(int(origin[end]), len(region)), min(len(item) + end, len(region))


def _hits(items: Items, at: np.ndarray, slot: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(owner, place in the block, band, n): the shared q-grams of some places, in portions."""
    longest = max(map(len, items.texts))
    work = np.cumsum(items.light.sizes(slot) + items.heavy.sizes(slot) * (2 + int(1 / RATE)))
    for rows in np.split(np.arange(len(at)), np.flatnonzero(np.diff(work // AT_ONCE)) + 1):
        which, entry = items.light.entries(slot[rows])
        owner, place = items.light.owner[entry], at[rows][which]
        yield owner, place, (place + longest - items.light.place[entry]) // (items.edits[owner] + 1), None
        which, entry = items.heavy.entries(slot[rows])
        if len(entry):
            owner, place = items.heavy.owner[entry], at[rows][which]
            width = items.edits[owner] + 1
            run = items.heavy.place[entry] + (place + longest) % width
            sizes = items.table[run + 1] - items.table[run]
            flat = np.repeat(items.table[run] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
            again = np.repeat(np.arange(len(owner)), sizes)
            yield owner[again], place[again], ((place + longest) // width)[again] + items.bands[flat], items.counts[flat]


def _shared(items: Items, raw: bytes, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """(owner, document, band, n): q-grams that a document shares with a text in each stripe of diagonals.

    Documents that share fewer than a text needs, whatever the diagonals, are left out before stripes are counted.
    """
    found = grams(raw)
    at = np.flatnonzero(items.sieve[_slot(found)])
    slot = np.minimum(np.searchsorted(items.values, found[at]), len(items.values) - 1)
    known = items.values[slot] == found[at]
    at, slot = at[known], slot[known]
    document = np.searchsorted(begins, at, "right") - 1
    owners, documents = len(items.texts), len(begins)
    enough = None
    if owners * documents <= PAIRS and int((items.light.sizes(slot) + items.heavy.sizes(slot)).sum()) <= AT_ONCE:
        which, entry = items.light.entries(slot)
        total = np.bincount(items.light.owner[entry] * documents + document[which], minlength=owners * documents)
        which, entry = items.heavy.entries(slot)
        total[items.heavy.owner[entry] * documents + document[which]] += len(raw)  # repeated q-grams: always looked at
        enough = total >= np.maximum(items.least, 1).repeat(documents)
    stripes = [np.zeros((4, 0), np.int64)]
    for owner, place, band, n in _hits(items, at, slot):
        inside = np.searchsorted(begins, place, "right") - 1
        if enough is not None:
            good = enough[owner * documents + inside]
            owner, inside, band, n = owner[good], inside[good], band[good], None if n is None else n[good]
        stripes.append(_merged(owner, inside, band, np.ones(len(owner), np.int64) if n is None else n))
    owner, inside, band, n = np.concatenate(stripes, axis=1)
    return tuple(_merged(owner, inside, band, n))


def _merged(owner: np.ndarray, inside: np.ndarray, band: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The counts of equal (owner, document, band) added up, in that order."""
    order = np.lexsort((band, inside, owner))
    rows = np.stack([owner[order], inside[order], band[order]])
    if not len(order):
        return np.zeros((4, 0), np.int64)
    first = np.flatnonzero(np.append(True, (np.diff(rows, axis=1) != 0).any(0)))
    return np.vstack([rows[:, first], np.add.reduceat(n[order], first)])


def occurrences(items: Items, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, text of items, edits, begin, end): the best occurrence of each item or part in each document."""
    for i, item in enumerate(items.texts):
        if 0 < len(item) < Q:  # too short for a q-gram: exact occurrences between spaces
            for d, text in enumerate(texts):
                at = (b" " + text + b" ").find(b" " + item + b" ")
                if at >= 0:
                    yield d, i, 0, at, at + len(item)
    if not len(items.values):
        return
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes + 1) - sizes - 1
    owner, inside, band, n = _shared(items, b"\0".join(texts), begins)
    if not len(owner):
        return
    longest = max(map(len, items.texts))
    # A band is the pair of stripes (b, b + 1); each q-gram counts in two bands, of its own document only.
    after = np.append((owner[1:] == owner[:-1]) & (inside[1:] == inside[:-1]) & (band[1:] == band[:-1] + 1), False)
    both = n + np.where(after, np.append(n[1:], 0), 0)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for s in np.flatnonzero(both >= np.maximum(items.least[owner], 1)).tolist():
        i, d = int(owner[s]), int(inside[s])
        edits = int(items.edits[i])
        known_best = best.get((d, i))
        if known_best and known_best[0] == 0:
            continue
        low = int(band[s]) * (edits + 1) - longest - int(begins[d])
        begin, last = max(0, low - edits), low + 2 * (edits + 1) + edits
        hit = align(items.texts[i], texts[d][begin:max(begin, last) + len(items.texts[i])], edits, last - begin + 1)
        if hit:
            hit = hit[0], hit[1] + begin, hit[2] + begin
            if known_best is None or hit < known_best:
                best[d, i] = hit
    for (d, i), hit in sorted(best.items()):
        yield d, i, *hit


def leaks(items: Items, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    """occurrences, of an item's parts only where the whole item is not found, and then only the best one."""
    count = int((~items.part).sum())
    found: dict[tuple[int, int], tuple] = {}
    at = np.cumsum([0, *(len(parts(t)) for t in items.texts[:count])])
    for d, i, *hit in occurrences(items, texts):
        owner = i if i < count else int(np.searchsorted(at, i - count, "right")) - 1
        rank = (i >= count, *hit)
        if (d, owner) not in found or rank < found[d, owner][0]:
            found[d, owner] = rank, i
    for (d, _), (rank, i) in sorted(found.items()):
        yield d, i, *rank[1:]


def blocks(benchmark: DataFrame, rate: float = RATE, limit: int = ITEMS) -> Iterator[Items]:
    """The benchmark in blocks of bounded size; null and blank items never occur."""
    names, texts, size = [], [], 0
    for row in benchmark.select("item_id", F.col("text").cast("string").alias("text")).orderBy("item_id", "text").toLocalIterator():
        text = normalise(row["text"])
        if not text:
            continue
        names.append(row["item_id"])
        texts.append(text)
        size += len(text)
        if size >= limit:
            yield compile_items(names, texts, rate)
            names, texts, size = [], [], 0
    if names:
        yield compile_items(names, texts, rate)


def _in_blocks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    start, block, size = 0, [], 0
    for i, text in enumerate(texts):
        block.append(normalise(text))
        size += len(block[-1])
        if size >= BLOCK:
            yield start, block
            start, block, size = i + 1, [], 0
    if block:
        yield start, block


def find(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, edits, begin, end, partial): each item's best occurrence in each document that has it.

    begin and end are byte positions in the normalised text; `partial` says that only a half of the item was
    found, which items of 2 * PART bytes or more are looked through for. Documents without an item give no
    row; neither do null and empty texts, or null and blank items. Repeated rows and repeated items
    give repeated rows. Other columns are not read. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kinds = plain.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, edits int, begin int, end int, partial boolean"
    item_kind = to_arrow_type(kinds[1])
    found = None
    for items in blocks(benchmark, rate):
        shared = spark.sparkContext.broadcast(items)  # bounded by ITEMS

        def run(batches, shared=shared):
            for batch in batches:
                for start, block in _in_blocks(batch.column(1).to_pylist()):
                    hits = list(leaks(shared.value, block))
                    yield pa.record_batch(
                        [batch.column(0).take(pa.array([start + h[0] for h in hits], pa.int64())),
                         pa.array([shared.value.names[h[1]] for h in hits], item_kind),
                         *(pa.array([h[c] for h in hits], pa.int32()) for c in (2, 3, 4)),
                         pa.array([bool(shared.value.part[h[1]]) for h in hits], pa.bool_())],
                        ["doc_id", "item_id", "edits", "begin", "end", "partial"],
                    )
        part = plain.mapInArrow(run, schema)
        found = part if found is None else found.unionAll(part)
    return found if found is not None else spark.createDataFrame([], schema)


def _leaking(shared):
    @F.pandas_udf("boolean")
    def leaking(texts: pd.Series) -> pd.Series:
        hit = np.zeros(len(texts), bool)
        for start, block in _in_blocks([None if t is None else t for t in texts.tolist()]):
            for found in occurrences(shared.value, block):
                hit[start + found[0]] = True
        give_back()
        return pd.Series(hit)
    return leaking


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of `docs` in which no item, and no half of a long one, occurs; columns are those of `docs`.

    Null and empty texts stay. Repeated rows share their fate.
    """
    spark = docs.sparkSession
    ship(spark)
    for items in blocks(benchmark, rate):
        shared = spark.sparkContext.broadcast(items)  # bounded by ITEMS
        docs = docs.filter(~_leaking(shared)(F.col("text").cast("string")))
    return docs

"""Phrases whose words keep company, counted over a prefix-free parse of the texts.

A text is a sequence of words and marks, a mark where a piece ends. It is cut into chunks at triggers:
three neighbours in it whose hash is 0 modulo a parameter. A chunk runs from one trigger (or the start of
the text) through the whole next one (or the end), so neighbours share exactly the three of a trigger
and the same text is cut alike wherever it stands. The distinct chunks with their frequencies are the
dictionary; phrases are counted inside distinct chunks, weighted by frequency. Every phrase of up to four
words lies in a chunk, and one that starts within the last three places of a chunk is left to the next
chunk unless the text ends there, so overlaps count once.

A phrase can only be frequent if the phrases in it are. Hashes of words are counted first, then hashes of
pairs of frequent words, and only phrases all of whose pairs may be frequent are counted themselves. What
is frequent reaches the tasks as a bitmap of hashes of fixed size: a collision costs a count that is
dropped afterwards, never a phrase.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import land, ship
from quarrylight.session import small_side

#: Places that neighbouring chunks share; phrases have at most one word more.
OVERLAP = 3
#: A chunk is also cut after so many places, where no trigger comes.
LONG_CHUNK = 4096
#: Bytes of text handled together in a task.
TOGETHER = 6_000_000
#: Bits of a pair's hash.
PAIR_BITS = 40
#: Partitions of the dictionary that a task counts: what is frequent comes in all of them, and is sent once.
GATHERED = 2
#: Parts that the candidates of a language are ranked in before they meet.
SALTS = 16

#: Runs of what ends a piece become one mark; the mark is no word, as it ends pieces itself.
PIECE_ENDS = r"[.,;:!?\n\x0B\f\r]+"
MARK = "."


def cut_long(texts: pa.Array) -> pa.Array:
    """The texts, long ones cut behind the end of a piece; no phrase crosses one."""
    if not len(texts) or _bytes(texts).max() <= TOGETHER:
        return texts
    found = []
    for text in texts.to_pylist():
        at = 0
        while len(text) - at > TOGETHER and (end := re.compile(PIECE_ENDS).search(text, at + TOGETHER)):
            found.append(text[at:end.end()])
            at = end.end()
        found.append(text[at:])
    return pa.array(found, pa.string())


def _slices(sizes: np.ndarray) -> Iterator[slice]:
    """Neighbouring rows of about TOGETHER bytes; a longer row is alone."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // TOGETHER)) + 1
    edges = [0, *cuts.tolist(), len(sizes)]
    return (slice(a, b) for a, b in zip(edges, edges[1:]) if b > a)


def _bytes(column: pa.Array) -> np.ndarray:
    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _hashes(lang: str, words: pa.Array) -> np.ndarray:
    salt = lang.encode() + b"\0"
    return np.fromiter((crc32(salt + w) for w in words.cast(pa.binary()).to_pylist()), np.int64, len(words))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    return (mixed >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


class Words:
    """Lists of words and marks as one array of codes, with the list each place belongs to."""

    def __init__(self, lang: str, lists: pa.ListArray):
        flat = lists.flatten()
        filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(lists)), sizes)[filled]
        coded = flat.filter(pa.array(filled)).dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.names, self.hashes = coded.dictionary, _hashes(lang, coded.dictionary)
        self.owner, self.ends = owner, np.cumsum(np.bincount(owner, minlength=len(lists)))
        mark = pc.index(self.names, MARK).as_py()
        self.is_mark = self.codes == mark if mark >= 0 else np.zeros(len(self.codes), bool)


def split_texts(texts: pa.Array) -> pa.ListArray:
    """Words and marks of each text: A-Z lower-cased, no other change to a word."""
    marked = pc.replace_substring_regex(pc.ascii_lower(texts), PIECE_ENDS, f" {MARK} ")
    return pc.ascii_split_whitespace(marked)


def parse(lang: str, texts: pa.Array, modulus: int) -> tuple[pa.Table, Words]:
    """The chunks of some texts with their number (chunk, last, n), and the words they were cut from."""
    words = Words(lang, split_texts(texts))
    mixed = words.hashes[words.codes].astype(np.uint64)
    mixed[:-2] += np.uint64(0x9E3779B1) * mixed[1:-1] + np.uint64(0x85EBCA77) * mixed[2:]
    size = len(mixed)
    end = words.ends[words.owner]
    begin = end - np.bincount(words.owner, minlength=len(words.ends))[words.owner]
    places = np.arange(size)
    starts = places == begin
    inner = (places > begin) & (places < end - OVERLAP)
    starts |= inner & ((mixed >> np.uint64(7)) % np.uint64(modulus) == 0)
    since = places - np.maximum.accumulate(np.where(starts, places, 0))
    starts |= inner & (since % LONG_CHUNK == 0)
    start = np.flatnonzero(starts)
    following = np.append(start[1:], size)
    last = following >= end[start]
    stop = np.where(last, end[start], following + OVERLAP)
    lengths = stop - start
    offsets = np.append(0, np.cumsum(lengths))
    taken = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], lengths)
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.names.take(pa.array(words.codes[taken])))
    chunks = pa.table({"chunk": pc.binary_join(lists, " "), "last": pa.array(last)})
    return chunks.group_by(["chunk", "last"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["chunk", "last", "n"]), words


PARSED = "lang string, word long, chunk string, last boolean, n long"


def _parse_batches(modulus: int):
    def run(batches):
        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                texts = cut_long(batch.column(1).filter(pc.equal(batch.column(0), lang)))
                for rows in _slices(_bytes(texts)):
                    chunks, found = parse(lang, texts[rows], modulus)
                    counts = np.bincount(found.codes, minlength=len(found.names))
                    counts[found.codes[found.is_mark][:1]] = 0  # a mark is no word
                    names = lambda table, lang=lang: pa.array([lang] * len(table), pa.string())
                    empty = [pa.nulls(len(counts), pa.string()), pa.nulls(len(counts), pa.bool_())]
                    yield pa.record_batch(
                        [names(counts), pa.array(found.hashes), *empty, pa.array(counts, pa.int64())], ["lang", "word", "chunk", "last", "n"]
                    )
                    chunks = chunks.append_column("lang", names(chunks)).append_column("word", pa.nulls(len(chunks), pa.int64()))
                    yield from chunks.select(["lang", "word", "chunk", "last", "n"]).to_batches()
    return run


def parsed(docs: DataFrame, modulus: int = 64) -> DataFrame:
    """Chunks (lang, chunk, last, n) and, with `word` instead of a chunk, hashes of words (lang, word, n)."""
    ship(docs.sparkSession)
    plain = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")
    ).filter("text is not null")
    rows = plain.mapInArrow(_parse_batches(modulus), PARSED)
    return rows.groupBy("lang", "word", "chunk", "last").agg(F.sum("n").alias("n"))


class Chunks(Words):
    """Distinct chunks of one language, ready for counting."""

    def __init__(self, lang: str, rows: pa.Table):
        chunk = rows.column("chunk").combine_chunks()
        super().__init__(lang, pc.split_pattern(chunk, " "))
        places = np.arange(len(self.codes))
        stops = np.minimum.accumulate(np.where(self.is_mark, places, len(places))[::-1])[::-1]
        end = self.ends[self.owner]
        self.room = np.minimum(stops, end) - places  # words from here to the next mark or the end of the chunk
        last = rows.column("last").to_numpy()[self.owner]
        self.own = (self.room > 0) & (last | (end - places > OVERLAP))
        self.weight = rows.column("n").to_numpy()[self.owner]

    def pairs(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the pairs of words that may be frequent, and how often each comes."""
        often = marked(marks, self.hashes)[self.codes]
        at = np.flatnonzero(self.own[:-1] & (self.room[:-1] > 1) & often[:-1] & often[1:])
        first, total, _ = self._sums(at, self.codes[at] * len(self.names) + self.codes[at + 1])
        return pair_hash(self.hashes[self.codes[first]], self.hashes[self.codes[first + 1]]), total

    def phrases(self, words: np.ndarray, pairs: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Phrases of one to four words that may be frequent, with how often they come."""
        often = marked(words, self.hashes)[self.codes]
        at = np.flatnonzero(self.own & often)
        first, total, _ = self._sums(at, self.codes[at])
        yield self._named(first, 1), total
        hashes = self.hashes[self.codes]
        pair = np.zeros(len(hashes) + 2, bool)
        pair[:max(0, len(hashes) - 1)] = (self.room[:-1] > 1) & often[:-1] & often[1:] & marked(pairs, pair_hash(hashes[:-1], hashes[1:]))
        at = np.flatnonzero(self.own & pair[:-2])
        number = self.codes[at]
        for size in (2, 3, 4):
            if size > 2:
                more = (self.room[at] >= size) & pair[at + size - 2]
                at, number = at[more], number[more]
            first, total, number = self._sums(at, number * len(self.names) + self.codes[at + size - 1])
            yield self._named(first, size), total

    def _sums(self, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A place and the summed weight of each different key, and the number of the key at each place."""
        _, first, number = np.unique(keys, return_index=True, return_inverse=True)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, number, self.weight[at])
        return at[first], total, number

    def _named(self, at: np.ndarray, size: int) -> pa.Array:
        parts = [self.names.take(pa.array(self.codes[at + i])) for i in range(size)]
        return pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]


def marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes & (64 * len(marks) - 1)
    return (marks[bit >> 6] >> (bit & 63)) & 1 == 1


def _chunk_blocks(batches) -> Iterator[tuple[str, Chunks]]:
    """The chunks of some batches by language, about TOGETHER bytes at once."""
    held, size = [], 0

    def blocks():
        table = pa.Table.from_batches(held)
        for lang in pc.unique(table.column("lang")).to_pylist():
            yield lang, Chunks(lang, table.filter(pc.equal(table.column("lang"), lang)))

    for batch in batches:
        for rows in _slices(_bytes(batch.column(1))):
            part = batch.slice(rows.start, rows.stop - rows.start)
            held.append(part)
            size += int(_bytes(part.column(1)).sum())
            if size >= TOGETHER:
                yield from blocks()
                held, size = [], 0
    if held:
        yield from blocks()


def _pair_batches(words: Broadcast):
    def run(batches):
        for _, chunks in _chunk_blocks(batches):
            pair, n = chunks.pairs(words.value)
            yield pa.record_batch([pa.array(pair), pa.array(n)], ["pair", "n"])
    return run


def _phrase_batches(words: Broadcast, pairs: Broadcast):
    def run(batches):
        for lang, chunks in _chunk_blocks(batches):
            for size, (phrase, n) in enumerate(chunks.phrases(words.value, pairs.value), 1):
                columns = [pa.array([lang] * len(n), pa.string()), phrase, pa.array(np.full(len(n), size), pa.int32()), pa.array(n)]
                yield pa.record_batch(columns, ["lang", "phrase", "size", "n"])
    return run


def _marks(hashes: DataFrame, bits: int) -> Broadcast:
    """The bitmap of a column of hashes: 2 ** bits bits, however many hashes there are."""
    bit = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    found = hashes.select(
        F.shiftright(bit, 6).alias("slot"),
        F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("word"),
    ).groupBy("slot").agg(F.bit_or("word").alias("word")).toArrow()
    marks = np.zeros(1 << (bits - 6), np.int64)
    marks[found["slot"].to_numpy()] = found["word"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(marks)


def frequencies(docs: DataFrame, least: int = 30, modulus: int = 64, bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to 4 words found at least `least` times (lang, phrase, size, f), and words per language (lang, n)."""
    rows = land(parsed(docs, modulus), "parsed", "zstd")
    hashed = rows.filter("word is not null")
    totals = hashed.groupBy("lang").agg(F.sum("n").alias("n")).filter("n > 0")
    words = _marks(hashed.filter(F.col("n") >= least).select(F.col("word").alias("hash")), bits)
    chunks = rows.filter("chunk is not null").select("lang", "chunk", "last", "n")
    chunks = chunks.coalesce(max(1, -(-chunks.rdd.getNumPartitions() // GATHERED)))
    pairs = chunks.mapInArrow(_pair_batches(words), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = _marks(pairs.filter(F.col("n") >= least).select(F.col("pair").alias("hash")), bits)
    counted = chunks.mapInArrow(_phrase_batches(words, pairs), "lang string, phrase string, size int, n long")
    every = counted.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    return every, totals


def _part(begin: Column, length: Column) -> Column:
    return F.array_join(F.slice("parts", begin, length), " ")


def mine(
    docs: DataFrame, least: int = 30, top: int = 2000, modulus: int = 64, bits: int = 24,
) -> DataFrame:
    """The collocations of each language: lang, rank, phrase, a, l, r, n, score.

    A candidate is a phrase of 2 to 4 words found a >= `least` times. Of its cuts into a first part
    (found l times) and a rest (r times) the one with the lowest floor(2000000 a / (l + r)) counts, ties to
    the shortest first part. A candidate inside a longer one with at least 80 % of its occurrences is
    dropped. The first `top` by score, a and phrase remain.

    Null texts have no words, null languages are `und`; both kinds of `und` are one. Repeated rows count
    each time. Empty texts and an empty table give no rows. Columns other than text and lang are not
    read. `modulus` sets how often triggers come, `bits` the size of the bitmaps; neither changes a row.
    """
    every, totals = frequencies(docs, least, modulus, bits)
    known = small_side(land(every, "frequent"), materialized=True)
    phrases = known.filter("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", F.split("phrase", " ").alias("parts"))

    cuts = phrases.select(
        "lang", "phrase", "a", "parts", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    ).select(
        "lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("head"),
        _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"),
    )
    head = known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rest = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("cast(2000000 as decimal(8,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cuts.join(head, ["lang", "head"]).join(rest, ["lang", "rest"]).groupBy(
        "lang", "phrase", "a"
    ).agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = phrases.filter("size > 2").select(
        "lang", "a", F.explode(F.expr(
            "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1),"
            " i -> array_join(slice(parts, i, m), ' '))))"
        )).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    kept = best.join(inner, ["lang", "phrase"], "left").filter(
        F.col("within").isNull() | (wide("within") * 100 < wide("a") * 80)
    )
    order = [F.desc("score"), F.desc("a"), "phrase"]
    found = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    # Ranked in parts first, so that the task of a language sees at most SALTS * top rows.
    part = Window.partitionBy("lang", "salt").orderBy(*order)
    best = found.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    first = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )

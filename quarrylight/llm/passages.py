"""Substring dedup with repeated-phrase automata.

A passage of WINDOW words is repeated if the same words also start in a document with a smaller id.
Looking for it in three steps:

1. Confirm. From every window of WINDOW words the phrase of PHRASE words with the smallest hash is
   drawn. Equal windows draw equal phrases, so a repeated window has a phrase that occurs in two
   different texts. Phrases that do are confirmed; a window draws about 2 in WINDOW - PHRASE + 2.
2. Compile and stream. Confirmed phrases are dealt to shards by the first document that holds them, so
   passages of one source stay together. Each shard's phrases are compiled to an Aho-Corasick
   automaton, and every document that holds one of them is streamed through it, which locates every
   occurrence word by word. A shard with many documents takes them in blocks.
3. Cover. The windows around located phrases are hashed (128 bits) and each hash gets the smallest
   document that has it; windows with a smaller document are covered.

Equal documents need none of this: all but the first of them are covered as a whole.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import land, ship
from quarrylight.session import small_side

WINDOW, PHRASE = 50, 16
#: Bytes of text hashed at once, and of documents that meet a shard's automaton in one task (one document may exceed them).
BLOCK, STREAM = 500_000, 6_000_000
#: Confirmed phrases of a shard, about.
SHARD = 20_000
#: Occurrences of a window that go to one task; a window with more is dealt over several.
HOT = 20_000
#: Odd multipliers of the rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
LAST = (1 << 63) - 1

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base and of its inverse, modulo 2^64."""
    known = _powers.get(base)
    if known is None or len(known[0]) < size:
        inverse = pow(base, -1, 1 << 64)
        both = []
        for x in (base, inverse):
            steps = np.full(max(size, 1024), x, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        known = _powers[base] = tuple(both)
    return known


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of each stretch values[begin:end], the same wherever it lies."""
    power, inverse = _power(base, len(values) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(values * power[: len(values)], dtype=np.uint64)))
    return _mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def word_hashes(texts: list[bytes], base: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, hash of each word) of UTF-8 texts, in one go."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(space.astype(np.int8), prepend=1)
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(end) > len(begin):
        end = end[-len(begin):] if len(begin) else end[:0]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    owner = np.searchsorted(starts, begin, "right") - 1
    return np.bincount(owner, minlength=len(texts)), _runs(raw.astype(np.uint64), begin, end, base)


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """best over each stretch of `width` values."""
    reach, found = 1, values
    while reach * 2 <= width:
        found = best(found[:-reach], found[reach:])
        reach *= 2
    rest = width - reach
    return best(found[: len(found) - rest], found[rest:]) if rest else found


def drawn(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each phrase, positions drawn, hash each window draws) for the word hashes of one text."""
    if len(words) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(words) - PHRASE + 1)
    phrases = _runs(words, at, at + PHRASE, BASES[1])
    span = WINDOW - PHRASE + 1
    windows = _slide(phrases, span, np.minimum)
    padded = np.zeros(len(phrases) + span - 1, np.uint64)
    padded[span - 1: span - 1 + len(windows)] = windows
    chosen = _slide(padded, span, np.maximum) == phrases
    return phrases, np.flatnonzero(chosen), windows


def _blocks(texts: list, limit: int):
    block, size = [], 0
    for i, text in enumerate(texts):
        block.append(i)
        size += len(text) + 1
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _profile(batches):
    for batch in batches:
        texts = [b"" if t is None else t for t in batch.column(1).cast(pa.binary()).to_pylist()]
        for block in _blocks(texts, BLOCK):
            part = [texts[i] for i in block]
            counts, words = word_hashes(part, BASES[0])
            phrases, at = [], 0
            for n in counts.tolist():
                hashes, chosen, _ = drawn(words[at:at + n])
                phrases.append(np.unique(hashes[chosen]).view(np.int64))
                at += n
            stops = np.cumsum([0, *map(len, phrases)])
            yield pa.record_batch(
                [batch.column(0).take(pa.array(block, pa.int64())), pa.array(counts, pa.int64()),
                 pa.array([_digest(t.split()) for t in part]),
                 pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(np.concatenate(phrases)))],
                ["doc_id", "n_words", "sha", "phrases"],
            )


def _spell(words: list[bytes], letters: dict[bytes, str]) -> str:
    return "".join([letters.get(x, "\x00") for x in words])


def _letter(i: int) -> str:
    i += 1
    return chr(i if i < 0xD800 else i + 0x800)


def compile_phrases(phrases: dict[int, tuple[bytes, ...]]) -> tuple[ahocorasick.Automaton, dict[bytes, str]]:
    """The automaton of some phrases, and the letter of each of their words; other words have one that no phrase has."""
    letters: dict[bytes, str] = {}
    for phrase in phrases.values():
        for word in phrase:
            if word not in letters:
                letters[word] = _letter(len(letters))
    automaton = ahocorasick.Automaton()
    for name, phrase in phrases.items():
        automaton.add_word(_spell(phrase, letters), (name, len(phrase)))
    if len(automaton):
        automaton.make_automaton()
    return automaton, letters


def locate(words: list[bytes], automaton: ahocorasick.Automaton, letters: dict[bytes, str]) -> list[tuple[int, int]]:
    """(position, phrase) of every occurrence of the automaton's phrases in a text."""
    if not len(automaton):
        return []
    return [(end + 1 - size, name) for end, (name, size) in automaton.iter(_spell(words, letters))]


def _spelled(batches):
    """The words of the confirmed phrases of the documents that are the first to hold them."""
    for batch in batches:
        texts = [b"" if t is None else t for t in batch.column(0).cast(pa.binary()).to_pylist()]
        for block in _blocks(texts, BLOCK):
            part = [texts[i] for i in block]
            counts, words = word_hashes(part, BASES[0])
            found: list[list] = [[], [], []]
            for i, text, end, n in zip(block, part, np.cumsum(counts).tolist(), counts.tolist(), strict=True):
                wanted = {x["phrase"]: x["shard"] for x in batch.column(1)[i].as_py()}
                hashes, chosen, _ = drawn(words[end - n:end])
                split, signed = text.split(), hashes.view(np.int64)
                for at in chosen[np.isin(signed[chosen], np.array(list(wanted), np.int64))].tolist():
                    shard = wanted.pop(int(signed[at]), None)
                    if shard is not None:
                        for column, value in zip(found, (int(signed[at]), shard, b" ".join(split[at:at + PHRASE])), strict=True):
                            column.append(value)
            yield pa.record_batch(
                [pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.binary()).cast(pa.string())],
                ["phrase", "shard", "words"],
            )


WINDOWS = "id long, sha string, start array<int>, one array<long>, two array<long>"


def _stream(phrases: pa.Table, docs: pa.Table) -> pa.Table:
    """The windows around the phrases that a shard's automaton locates: id, sha, starts and 128-bit hashes."""
    known = {i: tuple(w.split(b" ")) for i, w in enumerate(phrases.column("words").cast(pa.binary()).to_pylist())}
    ids, texts = docs.column("id").to_pylist(), docs.column("text").cast(pa.binary()).to_pylist()
    rows: list[list] = [[], [], [], [], []]
    automaton, letters = compile_phrases(known)
    for block in _blocks(texts, BLOCK) if known else ():
        part = [texts[i] for i in block]
        split = [t.split() for t in part]
        counts, words = word_hashes(part, BASES[0])
        _, other = word_hashes(part, BASES[2])
        stops = np.cumsum(counts)
        for k, i in enumerate(block):
            number = int(counts[k]) - WINDOW + 1
            found = locate(split[k], automaton, letters) if number > 0 else []
            if not found:
                continue
            near = np.zeros(len(split[k]) + 2, np.int32)
            at = np.array([x for x, _ in found], np.int64)
            np.add.at(near, np.maximum(at - (WINDOW - PHRASE), 0), 1)
            np.add.at(near, at + 1, -1)
            start = np.flatnonzero(np.cumsum(near)[:number] > 0)
            own = slice(int(stops[k] - counts[k]), int(stops[k]))
            rows[0].append(ids[i])
            rows[1].append(_digest(split[k]))
            rows[2].append(pa.array(start, pa.int32()))
            rows[3].append(pa.array(_runs(words[own], start, start + WINDOW, BASES[1]).view(np.int64)))
            rows[4].append(pa.array(_runs(other[own], start, start + WINDOW, BASES[3]).view(np.int64)))
    return pa.table(
        [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), _lists(rows[2], pa.int32()),
         _lists(rows[3], pa.int64()), _lists(rows[4], pa.int64())],
        names=["id", "sha", "start", "one", "two"],
    )


def _lists(arrays: list[pa.Array], kind: pa.DataType) -> pa.Array:
    stops = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.concat_arrays(arrays) if arrays else pa.array([], kind))


def _cut(batches):
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        out = [[], [], [], []]
        for i, text, starts, sha in zip(
            batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True
        ):
            words = (text or b"").split()
            if _digest(words) != sha:  # another text under the same id
                continue
            covered = np.zeros(len(words) + 1, np.int32)
            np.add.at(covered, np.array(starts), 1)
            np.add.at(covered, np.array(starts) + WINDOW, -1)
            covered = np.cumsum(covered)[:-1] > 0
            out[0].append(i)
            out[1].append(sha)
            out[2].append(int(covered.sum()))
            out[3].append(_digest([w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]))
        yield pa.record_batch(
            [pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2], pa.int64()), pa.array(out[3])],
            ["id", "sha", "n_removed", "kept"],
        )


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.col("text").cast("string").alias("text")
    )


def repeated(docs: DataFrame, hot: int = HOT) -> dict[str, DataFrame]:
    """The tables of the search: `profile` (doc_id, id, n_words, sha), `copies` (sha, first) and `covered`
    (id, sha, start): the starts of covered windows of documents that are no copies of another.

    A window that occurs more than `hot` times is dealt over several tasks, each with its smallest document.
    """
    ship(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = land(
        plain.mapInArrow(_profile, "doc_id long, n_words long, sha string, phrases array<long>")
        .withColumn("id", F.coalesce("doc_id", F.lit(LAST))).withColumn("mark", F.xxhash64("sha")),
        "profile",
    )
    copies = land(profile.groupBy("sha").agg(F.min("id").alias("first")), "copies")
    phrases = profile.select("id", "mark", F.explode("phrases").alias("phrase"))
    confirmed = land(phrases.groupBy("phrase").agg(
        F.min("mark").alias("low"), F.max("mark").alias("high"), F.min("id").alias("home")
    ).filter("low <> high").select("phrase", "home"), "confirmed")
    shards = max(1, -(-confirmed.count() // SHARD))
    shard = F.pmod(F.xxhash64("home"), F.lit(shards)).alias("shard")
    firsts = profile.select("id", "sha", "mark").join(
        copies, (profile["sha"] == copies["sha"]) & (profile["id"] == copies["first"])
    ).select("id", "mark").distinct()
    # For each document the shards of its phrases, and the phrases that it is the first to hold.
    held = phrases.join(confirmed.select("phrase", "home", shard), "phrase").groupBy("id", "mark").agg(
        F.collect_set("shard").alias("shards"), F.collect_list(F.when(F.col("home") == F.col("id"), F.struct("phrase", "shard"))).alias("wanted")
    ).join(firsts, ["id", "mark"]).groupBy("id").agg(
        F.array_distinct(F.flatten(F.collect_list("shards"))).alias("shards"), F.flatten(F.collect_list("wanted")).alias("wanted")
    )
    some = land(_numbered(docs).join(land(held, "held"), "id"), "candidates")
    spelled = some.filter(F.size("wanted") > 0).select("text", "wanted").mapInArrow(_spelled, "phrase long, shard long, words string")
    spelled = land(spelled.dropDuplicates(["phrase"]), "spelled")
    # A shard's documents in blocks of about STREAM bytes, each with the shard's phrases.
    streamed = some.select("id", "text", F.explode("shards").alias("shard"))
    blocks = small_side(streamed.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("text")) / STREAM).alias("blocks")))
    block = F.pmod(F.xxhash64("id", "text"), F.greatest("blocks", F.lit(1))).alias("block")
    dealt = streamed.join(blocks, "shard").select("id", "text", "shard", block)
    every = spelled.join(blocks, "shard").select("words", "shard", F.explode(
        F.sequence(F.lit(0).cast("long"), F.greatest("blocks", F.lit(1)) - 1)
    ).alias("block"))
    windows = land(every.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInArrow(_stream, WINDOWS), "windows")
    each = windows.select("id", "sha", F.inline(F.arrays_zip("start", "one", "two")))
    first = land(
        each.groupBy("one", "two").agg(
            F.min("id").alias("first"), F.max("id").alias("last"), F.ceil(F.count(F.lit(1)) / hot).alias("parts")
        ).filter("first < last").drop("last"), "first",
    )
    often = small_side(first.filter("parts > 1").select("one", "two", "parts"))
    part = F.pmod(F.xxhash64("id", "start"), F.coalesce("parts", F.lit(1)))
    dealt = each.join(often, ["one", "two"], "left").withColumn("part", part).drop("parts")
    every = first.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    covered = dealt.join(every, ["one", "two", "part"]).filter("first < id").select("id", "sha", "start")
    return {"profile": profile, "copies": copies, "candidates": some, "covered": covered}


def remove_repeated(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per row of `docs`: (doc_id, n_words, n_removed, kept_sha256).

    Words are runs of anything but ASCII white space. A word goes if a window of WINDOW words that
    covers it, all within the document, has its words also in a document with a smaller id. Null and
    empty texts have no words. Rows of one doc_id don't cover each other. A null doc_id counts as
    larger than all others. Other columns are not read. An empty table gives an empty result.
    """
    found = repeated(docs, hot)
    cut = found["covered"].groupBy("id", "sha").agg(F.array_distinct(F.collect_list("start")).alias("starts"))
    cut = land(
        found["candidates"].join(cut, "id").select("id", "text", "starts", "sha").mapInArrow(
            _cut, "id long, sha string, n_removed long, kept string"
        ).distinct(), "cut",
    )
    copy = F.col("id") > F.col("first")
    return (
        found["profile"].select("doc_id", "id", "n_words", "sha").join(found["copies"], "sha")
        .join(cut, ["id", "sha"], "left")
        .select(
            "doc_id", "n_words",
            F.when(copy, F.when(F.col("n_words") >= WINDOW, F.col("n_words")).otherwise(0))
            .otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy & (F.col("n_words") >= WINDOW), F.lit(hashlib.sha256(b"").hexdigest()))
            .otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        )
    )

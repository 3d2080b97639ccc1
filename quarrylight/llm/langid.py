"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language is turned into a suffix automaton, whose paths are
the sample's substrings. A text is parsed against each automaton: follow the longest match, count a
phrase, begin again. The fewer phrases, each worth log2(sample length) bits, the more alike text and
sample; the language that needs the fewest normalised phrases wins.

Each automaton has symbols of its own for all letters of its sample; a letter the sample lacks costs a
phrase in that language only. Automata of small alphabets are dense tables, those of large ones (a
script of thousands of letters) rows laid over one another. A block of texts, cut into strips, is
followed through a table strip-parallel with numpy, one column of characters at a time. A strip then
starts anew from the state in which the one before it ended, until it meets the states that it went
through already, so whole texts are parsed as in one go.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.llm.common import give_back, ship

#: Bounds of the training sample: rows and characters for each language, and characters of all languages, which
#: share them evenly where they are too many for CHARS each. No language is left out.
ROWS, CHARS, TOTAL = 400, 40_000, 2_560_000
#: Tables with up to so many symbols are dense; the others give the same phrases in less memory.
DENSE = 64
UNDETERMINED = "und"
STRIP = 256
#: Characters parsed at once.
BLOCK = 1_000_000
GAP, STRANGE = 0, 1


@dataclass
class Dense:
    """A row of `width` entries per state.

    An entry is the next state's row offset; where the match ends it is the complement of the state
    after the symbol alone. The last symbol fills strips up and changes nothing.
    """

    table: np.ndarray

    @staticmethod
    def of(edges: list[dict[str, int]], symbol: dict[str, int], width: int) -> Dense:
        start = np.zeros(width, np.int64)
        for c, to in edges[0].items():
            start[symbol[c]] = to * width
        table = np.tile(~start, (len(edges), 1))
        for state, out in enumerate(edges):
            for c, to in out.items():
                table[state, symbol[c]] = to * width
            table[state, width - 1] = state * width
        return Dense(table.astype(np.int32).ravel())

    def step(self, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one symbol each, and where a match ended."""
        entry = self.table[state + symbols]
        sign = entry >> 31  # -1 where a match ends
        return entry ^ sign, sign != 0


@dataclass
class Sparse:
    """The rows of all states laid over one another: the place base + symbol is a state's if it is the owner."""

    base: np.ndarray
    owner: np.ndarray
    to: np.ndarray
    start: np.ndarray

    @staticmethod
    def of(edges: list[dict[str, int]], symbol: dict[str, int], width: int) -> Sparse:
        base, taken, low, free = [0] * len(edges), bytearray(), 0, width
        for state in sorted(range(len(edges)), key=lambda x: -len(edges[x])):
            used = [symbol[c] for c in edges[state]]
            if len(used) > 1:
                while any(low + x < len(taken) and taken[low + x] for x in used):
                    low += 1
                base[state] = low
            elif used:
                while free < len(taken) and taken[free]:
                    free += 1
                base[state] = free - used[0]
            top = base[state] + width
            if top > len(taken):
                taken.extend(bytes(top))
            for x in used:
                taken[base[state] + x] = 1
        owner, to = np.full(len(taken), -1, np.int32), np.zeros(len(taken), np.int32)
        start = np.zeros(width, np.int32)
        for state, out in enumerate(edges):
            for c, following in out.items():
                owner[base[state] + symbol[c]], to[base[state] + symbol[c]] = state, following
        for c, following in edges[0].items():
            start[symbol[c]] = following
        return Sparse(np.array(base, np.int32), owner, to, start)

    def step(self, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one symbol each, and where a match ended."""
        at = self.base[state] + symbols
        fills = symbols == len(self.start) - 1
        ended = (self.owner[at] != state) & ~fills
        return np.where(fills, state, np.where(ended, self.start[symbols], self.to[at])), ended


def misses(table: Dense | Sparse, grid: np.ndarray, alphabet: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Ended matches in each strip (column); `first` marks the first strip of each text, the others go on."""
    states, ends = np.empty(grid.shape, np.int32), np.empty(grid.shape, bool)
    state = np.zeros(grid.shape[1], np.int32)
    for r, row in enumerate(grid):
        state, ends[r] = table.step(state, alphabet[row])
        states[r] = state
    again = np.flatnonzero(~first)
    while len(again):
        strips, state = again, states[-1, again - 1]
        for r, row in enumerate(grid):
            state, ends[r, strips] = table.step(state, alphabet[row[strips]])
            differs = state != states[r, strips]
            strips, state = strips[differs], state[differs]
            if not len(strips):
                break
            states[r, strips] = state
        after = strips + 1  # strips that now end elsewhere: the next ones begin there
        again = after[after < len(first)]
        again = again[~first[again]]
    return ends.sum(0)


@dataclass
class Model:
    """Symbols of code points over all languages; for each language its own symbols, automaton and figures.

    `alphabets` turn the common symbols into a language's own. `usual` is what text of the language
    takes, in bits per symbol, where the automaton has not seen it.
    """

    languages: list[str]
    symbols: np.ndarray
    alphabets: list[np.ndarray]
    tables: list[Dense | Sparse]
    bits: list[float]
    usual: list[float]

    def limit(self, k: int, max_rate: float) -> float:
        """Bits per symbol up to which a text counts as the language's.

        A language whose own text takes more than usual (thousands of letters) has a limit of its own,
        below what text takes that shares no letter with the sample.
        """
        return max(max_rate, min(1.25 * self.usual[k], 0.75 * self.bits[k]))


def normalise(text: str) -> str:
    """Lower case; each run of anything but letters is one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the states; state 0 is the start and every substring is a path from it."""
    edges, link, length, last = [{}], [-1], [0], 0
    for c in text:
        state = len(edges)
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = state
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                twin = len(edges)
                edges.append(dict(edges[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                link[q] = link[state] = twin
        last = state
    return edges


def phrases(text: str, edges: list[dict[str, int]]) -> int:
    """Number of phrases of a cross-parse, one symbol at a time (the plain form of what Model does)."""
    count, state = 0, 0
    for c in text:
        if c in edges[state]:
            state = edges[state][c]
        else:
            count += 1
            state = edges[0].get(c, 0)
    return count


def sample(docs: DataFrame, rows: int = ROWS, chars: int = CHARS, total: int = TOTAL) -> dict[str, str]:
    """Normalised training text per language: texts in the order of a hash of them, as far as the bounds go.

    `docs` has (text, lang). Equal texts of a language count once. Of a text longer than a quarter of
    the characters a piece is taken, at a place its hash gives; the last text is cut at the bound. All
    languages are learned; more than `total` / `chars` of them get a smaller, equal part of `total` each.
    """
    usable = docs.select("lang", F.col("text").cast("string").alias("text")).filter(
        "text is not null and lang is not null and length(text) > 0"
    ).withColumn("hash", F.xxhash64("text"))
    counts = usable.groupBy("lang").agg(
        F.count(F.lit(1)).alias("count"), F.approx_count_distinct("hash").alias("texts")
    ).collect()  # one row for each language
    if not counts:
        return {}
    chars = max(1, min(chars, total // len(counts)))
    share = F.create_map(*[
        x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 4.0 * rows / max(r["texts"], 1))))
    ])
    most = max(chars // 4, 1)
    begin = F.pmod(F.xxhash64("hash"), F.greatest(F.length("text") - most, F.lit(0)) + 1).cast("int") + 1
    place = F.pmod(F.col("hash"), F.lit(1 << 30))
    drawn = usable.withColumn("place", place).filter(
        F.col("place") < F.element_at(share, F.col("lang")) * (1 << 30)
    ).select("lang", "hash", "place", F.substr("text", begin, F.lit(most)).alias("text")).dropDuplicates(["lang", "hash"])
    ordered = Window.partitionBy("lang").orderBy("place", "hash")
    kept = drawn.select(
        "lang", "text", "place", "hash", F.row_number().over(ordered).alias("row"),
        (F.sum(F.length("text")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.length("text")).alias("before"),
    ).filter((F.col("row") <= rows) & (F.col("before") < chars))
    kept = kept.withColumn("text", F.substr("text", F.lit(1), (F.lit(chars) - F.col("before")).cast("int")))
    found: dict[str, list[str]] = {}
    for r in kept.orderBy("lang", "place", "hash").collect():
        found.setdefault(r["lang"], []).append(normalise(r["text"]))
    return {lang: f" {' '.join(texts)} " for lang, texts in found.items() if "".join(texts)}


def _usual(text: str) -> float:
    """Bits per symbol of the text's second half in an automaton of its first: the median of its pieces."""
    known, rest = text[: len(text) // 2], text[len(text) // 2:]
    edges, size = suffix_automaton(known), 500
    pieces = [rest[i:i + size] for i in range(0, max(len(rest) - size // 2, 1), size)]
    return float(np.median([phrases(x, edges) / max(len(x), 1) for x in pieces])) * math.log2(len(known) + 1)


def build(texts: dict[str, str]) -> Model:
    """The model of normalised training texts."""
    letters = sorted(set().union(*texts.values()) - {" "})
    symbol = {c: i + 2 for i, c in enumerate(letters)}
    symbols = np.fromiter(
        (symbol.get(c.lower(), STRANGE) if c.isalpha() else GAP for c in map(chr, range(0x110000))),
        np.min_scalar_type(len(letters) + 2), 0x110000,
    )
    alphabets, tables, bits, usual = [], [], [], []
    for lang in sorted(texts):
        own = {c: i + 2 for i, c in enumerate(sorted(set(texts[lang]) - {" "}))}
        width = len(own) + 3  # the last symbol fills strips up
        alphabet = np.full(len(letters) + 3, STRANGE, np.int32)
        alphabet[GAP], alphabet[-1] = GAP, width - 1
        for c, i in own.items():
            alphabet[symbol[c]] = i
        alphabets.append(alphabet)
        kind = Dense if width <= DENSE else Sparse
        tables.append(kind.of(suffix_automaton(texts[lang]), own | {" ": GAP}, width))
        bits.append(math.log2(len(texts[lang]) + 1))
        usual.append(_usual(texts[lang]))
    return Model(sorted(texts), symbols, alphabets, tables, bits, usual)


def fit(docs: DataFrame, **bounds) -> Model:
    return build(sample(docs, **bounds))


def parse(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of each text, phrases of each text and language)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = model.symbols[points]
    owner = np.repeat(np.arange(len(texts)), sizes)
    keep = codes != GAP
    keep[1:] |= (codes[:-1] != GAP) & (owner[1:] == owner[:-1])  # one gap after each word
    codes, owner = codes[keep], owner[keep]
    n = np.bincount(owner, minlength=len(texts))
    strips = -(-n // STRIP)
    first = np.cumsum(strips) - strips
    begins = np.zeros(int(strips.sum()), bool)
    begins[first[strips > 0]] = True
    within = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
    fill = len(model.alphabets[0]) - 1
    grid = np.full((STRIP, int(strips.sum())), fill, model.symbols.dtype)
    grid[within % STRIP, first[owner] + within // STRIP] = codes
    of = np.repeat(np.arange(len(texts)), strips)
    counts = np.zeros((len(texts), len(model.languages)))
    for k, (alphabet, table) in enumerate(zip(model.alphabets, model.tables, strict=True)):
        counts[:, k] = np.bincount(of, weights=misses(table, grid, alphabet, begins), minlength=len(texts))
    return n, counts


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, bits per symbol of the best) of each text.

    The score is the winner's share if every phrase costs log2(sample length) bits: texts without
    any letter have language `und` and score 0.
    """
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    n, counts = parse(model, texts)
    cost = (counts + 1) * np.array(model.bits)
    best = cost.argmin(axis=1)
    least = cost.min(axis=1)
    score = 1 / np.exp2(np.maximum(least[:, None] - cost, -60)).sum(axis=1)
    named = [model.languages[b] if size else UNDETERMINED for b, size in zip(best, n, strict=True)]
    rate = (counts * np.array(model.bits)).min(axis=1) / np.maximum(n, 1)
    return named, np.where(n > 0, score, 0.0), rate


def recognised(docs: DataFrame, model: Model, max_rate: float = 7.0) -> DataFrame:
    """The rows of `docs` whose text has a letter and parses like some learned language.

    Text of a known alphabetic language takes 1 to 5 bits per symbol, random letters 9 or more; text
    in a script of thousands of letters takes more by nature and is held against its language's own
    limit. Columns are those of `docs`; null and empty texts go; repeated rows share their fate. A
    model without languages rejects all.
    """
    told = identify(docs, model, "__lang", "__score", "__rate")
    limit = F.lit(max_rate)
    for k, name in enumerate(model.languages):
        if model.limit(k, max_rate) > max_rate:
            limit = F.when(F.col("__lang") == name, model.limit(k, max_rate)).otherwise(limit)
    return told.filter((F.col("__lang") != UNDETERMINED) & (F.col("__rate") <= limit)).select(*docs.columns)


def identify(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score",
             rate: str = "bits_per_letter") -> DataFrame:
    """`docs` with the predicted language, its score from 0 to 1, and the best parse's bits per symbol.

    Null and empty texts and texts without a letter get `und`, score 0. Repeated rows get the same
    result each. Other columns are kept; none but `text` is read. If `docs` has one of the three
    names already, its column is replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by TOTAL

    @F.pandas_udf("lang string, score double, rate double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        known, parts, block, size = shared.value, [], [], 0
        for text in texts.fillna("").tolist():
            block.append(text)
            size += len(text)
            if size >= BLOCK:
                parts.append(predict(known, block))
                block, size = [], 0
        parts.append(predict(known, block) if block else ([], np.zeros(0), np.zeros(0)))
        give_back()
        return pd.DataFrame({
            "lang": [x for p in parts for x in p[0]],
            "score": np.concatenate([p[1] for p in parts]), "rate": np.concatenate([p[2] for p in parts]),
        })

    return docs.withColumn("__guess", guess(F.col("text").cast("string"))).withColumns(
        {lang: F.col("__guess.lang"), score: F.col("__guess.score"), rate: F.col("__guess.rate")}
    ).drop("__guess")

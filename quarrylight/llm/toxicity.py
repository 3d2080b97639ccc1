"""Toxicity by maximum-scoring segments.

Features of a word are the word and its first letters. In a bounded sample of labelled texts, equal
texts once, the texts with a feature are counted; the feature gets the log-odds of toxic against other
texts under a Dirichlet prior whose shape is its share of the texts of the whole corpus, and keeps
them only where they are many standard errors above zero. A word scores by its most specific kept feature; every other word costs a little, so that the
expected score of ordinary text is negative.

A linear-time scan (all maximal scoring segments) finds the passages. How high a passage scores by
chance follows an extreme-value law: the solution lambda of sum p e^(lambda s) = 1 and K from the best
segments of clean texts. A text's evidence is the sum of lambda S - ln(K n) over its significant
passages, and a logistic curve, fitted on the sample, turns it into a score from 0 to 1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import land, ship

#: Bounds of the labelled sample (rows of each class) and of the kept features.
ROWS, FEATURES = 6_000, 50_000
#: Least toxic texts of a feature, least standard errors, weight of the prior (in texts) and its flat part.
SEEN, ERRORS, PRIOR, FLAT = 4, 3.2, 10.0, 0.5
#: Entries of the counts that are no features: texts and words.
TEXTS, WORDS = "", "*"
STEMS = (5, 4)
LONGEST = 64
#: Words whose score a worker remembers.
REMEMBERED = 300_000
EULER = 0.5772156649015329
words_of = re.compile(r"[^\W\d_]+").findall


def features(word: str) -> list[str]:
    """A word's features, the most specific first; letters of very long words beyond LONGEST don't matter."""
    return [word[:LONGEST], *(word[:n] + "*" for n in STEMS if len(word) > n)]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    other: float = -0.01
    rate: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    base: float = -1.0
    memory: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def word_scores(self, words: list[str]) -> list[tuple[int, float]]:
        """(position, score) of the words that have a kept feature."""
        memory, known = self.memory, self.scores
        if len(memory) > REMEMBERED:
            memory.clear()
        for word in set(words).difference(memory):
            memory[word] = next((known[x] for x in features(word) if x in known), 0.0)
        return [(at, score) for at, score in enumerate(map(memory.__getitem__, words)) if score]

    def passages(self, text: str) -> tuple[list[tuple[int, int, float, float]], int]:
        """Significant passages (first word, end, score, evidence) of a text, and its number of words."""
        words = words_of(text.lower())
        log_size = math.log(max(1, len(words)))
        found = []
        for begin, end, score in segments(self.word_scores(words), self.other):
            evidence = self.rate * score - self.log_k - log_size
            if evidence > 0:
                found.append((begin, end, score, evidence))
        return found, len(words)

    def evidence(self, text: str) -> float:
        return sum(x[3] for x in self.passages(text)[0])

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.base + self.slope * self.evidence(text)))))


def segments(scores: list[tuple[int, float]], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) of a row of words, in linear time.

    `scores` lists the words above zero by position; each other word scores `other` (below zero).
    Candidates are kept with the running totals before and at their ends; a new one is merged with
    the nearest earlier one that began lower and ended lower.
    """
    kept: list[tuple[int, int, float, float]] = []  # begin, end, total before, total at the end
    total, last = 0.0, -1
    for at, score in scores:
        before = total + other * (at - last - 1)
        total, last = before + score, at
        begin, low, high = at, before, total
        while True:
            j = len(kept) - 1
            passed = []
            while j >= 0 and kept[j][2] >= low:
                passed.append(kept[j])
                j -= 1
            if j < 0 or kept[j][3] >= high:
                break
            begin, low = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append((begin, at + 1, low, high))
    return [(begin, end, high - low) for begin, end, low, high in kept]


def _count(batches):
    """Texts with each feature, toxic and other, of a partition."""
    counts = (Counter(), Counter())
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text.lower())
            own = counts[1 - toxic]
            own.update({x for word in set(words) for x in features(word)})
            own[TEXTS] += 1
            own[WORDS] += len(words)
    for kind, both in enumerate(counts):
        names = list(both)
        numbers = pa.array([both[x] for x in names], pa.int64())
        none = pa.array(np.zeros(len(names), np.int64))
        yield pa.record_batch(
            [pa.array(names, pa.string()), none if kind else numbers, numbers if kind else none], ["feature", "toxic", "clean"]
        )


def _background(wanted):
    def run(batches):
        known, counts, memory = wanted.value, Counter(), {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = set()
                for word in set(words_of(text.lower())):
                    own = memory.get(word)
                    if own is None:
                        own = memory[word] = tuple(x for x in features(word) if x in known)
                    if own:
                        found.update(own)
                counts.update(found)
                counts[TEXTS] += 1
                if len(memory) > 200_000:
                    memory.clear()
        yield pa.record_batch(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["feature", "corpus"]
        )
    return run


def fit(docs: DataFrame, labels: DataFrame, corpus: DataFrame, rows: int = ROWS, features: int = FEATURES) -> Model:
    """Learn from the texts of `docs` (doc_id, text) that `labels` (doc_id, toxic) marks 0 or 1, at most
    `rows` of each class, drawn by a hash of their ids, and from the words of all of `corpus` (text). Of the words
    and pairs that may tell, the `features` most frequent in toxic texts are weighed.

    Rows with a null id, text or label are not learned from. Without both classes nothing is toxic.
    """
    spark = docs.sparkSession
    ship(spark)
    marked = labels.filter("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if 1 not in totals or 0 not in totals:
        return Model()
    drawn = None
    for toxic, n in totals.items():
        part = marked.filter(
            (F.col("toxic") == toxic) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < min(1.0, 0.95 * rows / n) * (1 << 30))
        ).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        drawn = part if drawn is None else drawn.unionAll(part)
    texts = docs.filter("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    drawn = land(
        texts.join(F.broadcast(drawn), "doc_id").dropDuplicates(["toxic", "text"]).select("toxic", "text"),  # bounded by rows
        "drawn",
    )
    if drawn.select("toxic").distinct().count() < 2:
        return Model()

    counts = drawn.mapInArrow(_count, "feature string, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    counts = land(counts, "counts")
    size = {r["feature"]: r for r in counts.filter(F.col("feature").isin(TEXTS, WORDS)).collect()}
    texts, words = size[TEXTS], size.get(WORDS, size[TEXTS])
    likely = counts.filter(
        ~F.col("feature").isin(TEXTS, WORDS) & (F.col("toxic") >= SEEN)
        & (F.col("toxic") * texts["clean"] > 3.0 * (F.col("clean") + FLAT) * texts["toxic"])
    ).orderBy(F.desc("toxic"), "feature").limit(features)
    seen = {r["feature"]: (r["toxic"], r["clean"]) for r in likely.collect()}  # bounded by features
    wanted = spark.sparkContext.broadcast(frozenset(seen))
    corpus_counts = dict(
        tuple(r) for r in corpus.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .mapInArrow(_background(wanted), "feature string, corpus long").groupBy("feature").agg(F.sum("corpus")).collect()
    )
    model = _weigh(seen, corpus_counts, texts, words)
    if not model.scores:
        return model
    return _calibrate(model, drawn)


def _weigh(seen: dict, corpus: dict, texts, words) -> Model:
    scores, rates = {}, []
    everywhere = max(1, corpus.get(TEXTS, 0))
    toxic, clean = texts["toxic"], texts["clean"]
    for name, (t, c) in seen.items():
        prior = FLAT + PRIOR * corpus.get(name, 0) / everywhere
        odds = math.log((t + prior) / (toxic - t + prior)) - math.log((c + prior) / (clean - c + prior))
        error = math.sqrt(1 / (t + prior) + 1 / (c + prior))
        if odds >= ERRORS * error and odds >= 1.5:
            scores[name] = min(odds, 8.0)
            rates.append(((t + prior) / (words["toxic"] + 1), (c + prior) / (words["clean"] + 1), scores[name]))
    if not rates:
        return Model()
    in_toxic, in_clean = sum(x[0] for x in rates), sum(x[1] for x in rates)
    other = min(-0.02, math.log((1 - min(0.9, in_toxic)) / (1 - min(0.9, in_clean))))
    low, high = 1e-6, 20.0  # sum p e^(lambda s) grows beyond 1 once, from its dip below 1
    for _ in range(100):
        middle = (low + high) / 2
        mass = (1 - in_clean) * math.exp(middle * other) + sum(c * math.exp(middle * s) for _, c, s in rates)
        low, high = (middle, high) if mass < 1 else (low, middle)
    return Model(scores, other, max(low, 0.05))


def _calibrate(model: Model, drawn: DataFrame) -> Model:
    """K from the best segments of clean texts, then the logistic curve; both from the sample alone."""
    shared = drawn.sparkSession.sparkContext.broadcast(model)

    def best(batches):
        for batch in batches:
            tops, sizes = [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text.lower())
                sizes.append(len(words))
                tops.append(max((x[2] for x in segments(shared.value.word_scores(words), shared.value.other)), default=0.0))
            yield pa.record_batch([batch.column(0), pa.array(tops, pa.float64()), pa.array(sizes, pa.int64())], ["toxic", "top", "n"])

    rows = drawn.mapInArrow(best, "toxic int, top double, n long").collect()  # bounded by twice ROWS
    clean = [r["top"] * model.rate - math.log(max(1, r["n"])) for r in rows if r["toxic"] == 0 and r["n"]]
    model.log_k = float(np.mean(clean)) - EULER if clean else 0.0
    again = drawn.sparkSession.sparkContext.broadcast(model)

    def evidence(batches):
        for batch in batches:
            found = [again.value.evidence(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.float64())], ["toxic", "x"])

    rows = drawn.mapInArrow(evidence, "toxic int, x double").collect()
    model.slope, model.base = logistic(np.array([r["x"] for r in rows]), np.array([float(r["toxic"]) for r in rows]))
    return model


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(slope, base) by Newton's method with a small ridge, classes weighted alike."""
    scale = max(1e-9, float(np.abs(x).max()))
    data = np.stack([x / scale, np.ones(len(x))], axis=1)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(data @ beta, -30, 30)))
        slope = data.T @ (weight * (y - p)) - 1e-3 * beta
        bend = (data * (weight * p * (1 - p))[:, None]).T @ data + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(0.0, beta[0]) / scale), float(beta[1])


def rate(docs: DataFrame, model: Model, score: str = "score", passages: str = "passages") -> DataFrame:
    """`docs` with a score from 0 to 1 and the significant passages (begin, end, score, evidence; words).

    Null and empty texts score as texts without evidence. Repeated rows get equal results. Other
    columns stay and none but `text` is read; columns of the two names are replaced.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the features of its fit

    @F.pandas_udf("score double, passages array<struct<begin:int,end:int,score:double,evidence:double>>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        known, scores, spans = shared.value, [], []
        for text in texts:
            found = known.passages(text or "")[0]
            x = known.base + known.slope * sum(p[3] for p in found)
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))))
            spans.append([{"begin": b, "end": e, "score": s, "evidence": v} for b, e, s, v in found])
        return pd.DataFrame({"score": scores, "passages": spans})

    return docs.withColumn("__judged", judge(F.col("text").cast("string"))).withColumns(
        {score: F.col("__judged.score"), passages: F.col("__judged.passages")}
    ).drop("__judged")

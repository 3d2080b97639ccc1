"""Token counts from a cache of digests: only texts never counted before are encoded.

A text's digest is that of its normalised content: every run of white space is one space and none is
left at the ends. That changes no count, as the tokenizers counted here drop white space before they
cut words. A tokenizer's digest covers its file, the library's version and the normalisation, so a
change of any starts counts of its own. The cache is a Parquet table (digest, n_tokens, tokenizer),
partitioned by tokenizer. Counting joins the documents' digests to it, encodes one text for each
digest that has none, and appends those counts. No token spans white space, so a text's count is the sum
over its words, and a worker remembers those of words.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import land, ship, whole_text
from quarrylight.session import small_side

CACHE = "digest binary, n_tokens long, tokenizer string"
#: ASCII white space; what else counts as white space stays as it is in a digest.
SPACES = r"[\x20\x09-\x0D]+"
NORMALISATION = "ascii spaces, 1"
#: Words a worker remembers before it forgets them all, and the longest it remembers.
REMEMBERED, LONGEST = 200_000, 100
#: Bytes of text counted together, and words given to the library at once.
TOGETHER, AT_ONCE = 2_000_000, 1000

#: Fixed value: the pieces of the tokenizers whose words are encoded together; and marks that often end a word.
LETTER_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARKS = ".,"

_counters: dict[str, Counter] = {}


def version(path: str) -> str:
    """The digest of what a count depends on besides the text."""
    with open(path, "rb") as file:
        content = file.read()
    known = tokenizers.Tokenizer.from_str(content.decode())
    probe = ["a b", "a  b", " a b ", "a\tb", "a\n\x0b\x0c\rb", "a\n 1", "( \n)", "<| a |> \n's"]
    size = lambda x: len(known.encode_batch_fast([x], add_special_tokens=False)[0].ids)
    if any(size(x) != sum(map(size, x.split())) for x in probe):
        raise ValueError("this tokenizer does not drop white space")
    return hashlib.sha256(b"\0".join([content, tokenizers.__version__.encode(), NORMALISATION.encode()])).hexdigest()


def normalised() -> Column:
    return F.regexp_replace(F.btrim(whole_text(), F.lit(" \t\n\x0b\x0c\r")), SPACES, " ")


def cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """The counts of a tokenizer version, one for each digest: jobs running side by side may append one twice."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    rows = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == tokenizer)
    return rows.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


class Counter:
    """Counts tokens of texts, each word encoded once; it only remembers, so losing it costs time alone."""

    def __init__(self, path: str):
        self.known: dict[bytes, int] = {}
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        # Where runs of letters are pieces whose last token has a mark, many of them are encoded in one call.
        by_letters = LETTER_PIECES in str(self.tokenizer.pre_tokenizer)
        self.end = getattr(self.tokenizer.model, "end_of_word_suffix", None) if by_letters else None
        if self.end:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(self.end)]] = True

    def _sizes(self, words: list[str]) -> list[int]:
        parts = (words[at:at + AT_ONCE] for at in range(0, len(words), AT_ONCE))
        return [len(x.ids) for part in parts for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[int]:
        """The sizes of words that are one piece each."""
        found: list[int] = []
        for lo in range(0, len(words), 500):
            part = words[lo:lo + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int64)
            stops = np.flatnonzero(self.ends[ids]) + 1
            found += np.diff(stops, prepend=0).tolist() if len(stops) == len(part) else self._sizes(part)
        return found

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        kind = [0] * len(texts)
        if self.end:  # 1: a run of letters, 2: one with a mark behind it
            kind = [1 if t.isalpha() else 2 if t[-1:] in MARKS and t[:-1].isalpha() else 0 for t in texts]
            kind = [k if k and t.lower().rstrip(MARKS).isalpha() else 0 for k, t in zip(kind, texts, strict=True)]
        runs = sorted({t if k == 1 else t[:-1] for k, t in zip(kind, texts, strict=True) if k})
        size = dict(zip(runs, self._letters(runs), strict=True)) if runs else {}
        mark = dict(zip(MARKS, self._sizes(list(MARKS)), strict=True))
        odd = iter(self._sizes([t for k, t in zip(kind, texts, strict=True) if not k]))
        for k, w, t in zip(kind, words, texts, strict=True):
            self.known[w] = size[t] if k == 1 else size[t[:-1]] + mark[t[-1]] if k else next(odd)

    def words(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = [w for w in words if w not in self.known]
        self._learn(new)
        found = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        for w in new:
            if len(w) > LONGEST:
                del self.known[w]
        return found

    def texts(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each normalised text."""
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        each = self.words(coded.dictionary.cast(pa.binary()).to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        upto = np.append(0, np.cumsum(each))
        stops = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        return upto[stops] - upto[np.append(0, stops[:-1])]


def _encode(path: str):
    def run(batches):
        if path not in _counters:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and each thread would hold memory
            _counters[path] = Counter(path)
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            edges = [0, *(np.flatnonzero(np.diff(sizes // TOGETHER)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    counts = _counters[path].texts(batch.column(1).slice(a, b - a))
                    yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64())], ["digest", "n_tokens"])
    return run


def count(docs: DataFrame, tokenizer: str, cache: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens), one row for each row of docs.

    Counts are those of the tokenizer file's `encode` without begin, end or other added tokens; the
    strings of special tokens in a text are encoded as the library does by default. `cache` is a folder
    that all executors reach; it need not exist. Null texts are empty: 0 bytes, 0 tokens. Texts alike
    but for white space are encoded once. Repeated rows and repeated or null ids each keep their row. An
    empty table gives no rows and appends nothing. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    ship(spark)
    mark = version(tokenizer)
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    digest = F.unhex(F.sha2(normalised().cast("binary"), 256)).alias("digest")
    keys = land(plain.select("doc_id", F.octet_length(whole_text()).cast("long").alias("n_bytes"), digest), "digests")
    stored = cached(spark, cache, mark)
    missing = small_side(land(keys.select("digest").distinct().join(stored, "digest", "left_anti"), "misses"), materialized=True)

    texts = plain.select(digest, normalised().alias("text"))
    # Copies meet in the map tasks first, so a digest of a third of all rows is one row from each task.
    # Few misses are broadcast, and the optimizer then filters by them before texts are shuffled.
    distinct = texts.groupBy("digest").agg(F.any_value("text").alias("text"))
    fresh = distinct.join(missing, "digest", "left_semi").mapInArrow(_encode(tokenizer), "digest binary, n_tokens long")
    fresh.withColumn("tokenizer", F.lit(mark)).write.mode("append").partitionBy("tokenizer").parquet(cache)

    known = small_side(cached(spark, cache, mark))
    return keys.join(known, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )

"""Token counts against the library on every text, and what the cache holds."""

import random
import re

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrylight.llm import token_counts
from quarrylight.session import new_folder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(1)
    letters = list("abC é́漢1'.-\t\n\x0b\x0c\r  \x85\x1cΣς") + ["<|endoftext|>", "<|startoftext|>", "<|STARTOFTEXT|>", "'s", "don't", "  "]
    made = [(i, "".join(draw.choice(letters) for _ in range(draw.choice([1, 5, 60])))) for i in range(200)]
    copy = "the same words in many rows"
    made += [(300 + i, copy) for i in range(100)] + [(400, copy.replace(" ", "\n\t")), (401, f"  {copy} \n")]
    made += [(500, None), (501, ""), (502, " \n "), (None, "x"), (3, made[3][1]), (503, "word " * 5000), (504, "a" * 3000)]
    return made


def want(texts):
    known = Tokenizer.from_file(PATH)
    return sorted(
        (-1 if i is None else i, len((t or "").encode()), n := len(known.encode(t or "", add_special_tokens=False).ids), n > 2048)
        for i, t in texts
    )


def got(df):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in df.collect())


def test_cold_and_warm_cache(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    docs = docs.withColumns({"digest": F.lit(1), "n_tokens": F.lit("x"), "tokenizer": F.lit(2)})
    cache = new_folder(spark, "cache")
    assert got(token_counts.count(docs, PATH, cache)) == want(texts)
    entries = spark.read.parquet(cache)
    contents = {" ".join((t or "").replace("\x1c", "").replace("\x85", "").encode().decode().split(" ")) for _, t in texts}
    held = entries.count()
    assert held == entries.select("digest").distinct().count() <= len(contents)

    # Again: nothing is added. One new text: one entry more.
    assert got(token_counts.count(docs, PATH, cache)) == want(texts)
    assert spark.read.parquet(cache).count() == held
    more = [*texts, (900, "never seen before, <|endoftext|>"), (901, "never  seen\nbefore, <|endoftext|>")]
    assert got(token_counts.count(spark.createDataFrame(more, "doc_id long, text string"), PATH, cache)) == want(more)
    assert spark.read.parquet(cache).count() == held + 1


def test_stored_counts_are_used(spark):
    """A count put into the cache by hand is what documents get; another tokenizer's is not."""
    docs = spark.createDataFrame([(1, "alpha  beta"), (2, "gamma")], "doc_id long, text string")
    cache = new_folder(spark, "cache")
    stored = spark.createDataFrame([("alpha beta",), ("gamma",)], "text string").select(
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.lit(4000).cast("long").alias("n_tokens"),
        F.when(F.col("text") == "gamma", "other").otherwise(token_counts.version(PATH)).alias("tokenizer"),
    )
    stored.unionAll(stored).write.partitionBy("tokenizer").parquet(cache)  # side by side, twice
    assert got(token_counts.count(docs, PATH, cache)) == [(1, 11, 4000, True), (2, 5, 1, False)]


def test_empty_table(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").limit(0)
    cache = new_folder(spark, "cache")
    assert token_counts.count(docs, PATH, cache).collect() == []
    assert token_counts.count(docs, PATH, cache).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_words_are_remembered_and_forgotten(monkeypatch, texts):
    known = Tokenizer.from_file(PATH)
    plain = pa.array([re.sub(r"[\x20\x09-\x0D]+", " ", t or "").strip(" ") for _, t in texts])
    for remembered, longest in ((10 ** 6, 100), (20, 3)):
        monkeypatch.setattr(token_counts, "REMEMBERED", remembered)
        monkeypatch.setattr(token_counts, "LONGEST", longest)
        counter = token_counts.Counter(PATH)
        for part in (plain, plain.slice(3, 40), plain.slice(0, 0)):
            assert counter.texts(part).tolist() == [len(known.encode(t, add_special_tokens=False).ids) for t in part.to_pylist()]


def test_other_kinds_of_tokenizer_are_refused():
    with pytest.raises(ValueError, match="white space"):
        token_counts.version(public_tokenizers.path("byte_bpe_50k.json"))

"""Collocations against a plain count over whole texts."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import collocations
from quarrylight.llm.common import land

DOCS = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        if words := re.findall(r"[^\x20\x09]+", piece):
            yield words


def plain(rows, least, top):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            totals[lang] += len(words)
            for k in range(1, 5):
                counts.setdefault(lang, Counter()).update(zip(*[words[i:] for i in range(k)], strict=False))
    found = []
    for lang, f in counts.items():
        often = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        kept = []
        for p, a in often.items():
            if any(
                len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in often.items()
            ):
                continue
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            found.append((lang, rank, p.decode(), -a, l, r, totals[lang], -s))
    return sorted(found)


def some_text(draw, n, kinds=12):
    ends = [" "] * 12 + [", ", ".\n", "\t ", " ! ", ";"]
    return "".join(draw.choice("ABcdeöñ漢gxyz"[:kinds]) + draw.choice(["", "n", "Q"]) + draw.choice(ends) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(1)
    shared = some_text(draw, 300)
    made = [(i, some_text(draw, draw.choice([0, 1, 3, 40, 200])), draw.choice(["en", "de", None, "und"])) for i in range(60)]
    made += [(100 + i, shared, "en") for i in range(40)]
    made += [(200, None, "en"), (201, "", None), (202, " \n.,", "xx"), (None, shared, "en"), (3, made[3][1], made[3][2])]
    made += [(300, "over and over " * 9000, "fr"), (301, "no end here " * 30, "fr"), (302, " ".join(f"w{i}" for i in range(9000)), "fr")]
    return made


@pytest.mark.parametrize(("modulus", "bits"), [(1, 6), (16, 24), (10 ** 6, 12)])
def test_same_as_plain(spark, rows, modulus, bits):
    """Whatever the triggers and however many hashes collide."""
    df = spark.createDataFrame(rows, DOCS).repartition(5).withColumns({"n": F.lit("x"), "phrase": F.lit(1), "chunk": F.lit(2)})
    got = sorted(tuple(r) for r in collocations.mine(df, least=4, top=25, modulus=modulus, bits=bits).collect())
    want = plain(rows, 4, 25)
    assert got == want and len({r[0] for r in got}) >= 4


def test_counts_over_chunks(rows, monkeypatch):
    """Chunks cut at any trigger, or in the middle, hold each phrase exactly once."""
    texts = [t for _, t, _ in rows if t]
    want = Counter()
    for text in texts:
        for words in pieces(text):
            for k in range(1, 5):
                want.update(" ".join(words[i:i + k]) for i in range(len(words) - k + 1))
    everything = np.full(4, -1, np.int64)  # a bitmap that marks all hashes
    for modulus, longest in ((1, 4096), (4, 7), (10 ** 9, 5), (10 ** 9, 4096)):
        monkeypatch.setattr(collocations, "LONG_CHUNK", longest)
        chunks, words = collocations.parse("en", pa.array(texts), modulus)
        assert (~words.is_mark).sum() == sum(n for p, n in want.items() if " " not in p)
        counted = Counter()
        for phrases, f in collocations.Chunks("en", chunks).phrases(everything, everything):
            counted.update(dict(zip(phrases.to_pylist(), f.tolist(), strict=True)))
        assert counted == want
        if modulus == 10 ** 9:
            assert max(len(c.split(" ")) for c in chunks["chunk"].to_pylist()) <= longest + 3 + 1


def test_small_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "TOGETHER", 50)
    whole = pa.array([t for _, t, _ in rows if t][:30])
    texts = collocations.cut_long(whole)
    assert len(texts) > 2 * len(whole) and "".join(texts.to_pylist()) == "".join(whole.to_pylist())
    assert len(list(collocations._slices(collocations._bytes(texts)))) > 10
    chunks, _ = collocations.parse("en", texts, 4)
    table = chunks.append_column("lang", pa.array(["en"] * len(chunks))).select(["lang", "chunk", "last", "n"])
    everything, counted = np.full(4, -1, np.int64), Counter()
    for _, block in collocations._chunk_blocks(table.to_batches()):
        for phrases, f in block.phrases(everything, everything):
            counted.update(dict(zip(phrases.to_pylist(), f.tolist(), strict=True)))
    want = Counter()
    table = collocations.parse("en", whole, 4)[0]
    for phrases, f in collocations.Chunks("en", table).phrases(everything, everything):
        want.update(dict(zip(phrases.to_pylist(), f.tolist(), strict=True)))
    assert counted == want


def test_copies_share_chunks(spark, rows):
    """The dictionary of a text and of forty copies has the same chunks."""
    one, many = (land(collocations.parsed(spark.createDataFrame(r, DOCS)), "parsed") for r in ([rows[60]], rows[60:100]))
    assert one.count() == many.count() > 20 and many.agg(F.min(F.col("n") % 40), F.max(F.col("n") % 40)).first() == (0, 0)


def test_empty(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    assert collocations.mine(df.limit(0)).count() == 0
    assert collocations.mine(df.filter("doc_id in (200, 201, 202)")).count() == 0
    assert collocations.mine(df.limit(0)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]

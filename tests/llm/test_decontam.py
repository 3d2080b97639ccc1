"""Decontamination against whole edit-distance tables, on repetitive texts and on parts of items."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import decontam


def plain_best(item, text):
    """Least edits of item anywhere in text, by the whole table."""
    row = [0] * (len(text) + 1)
    for j, byte in enumerate(item, 1):
        above, row = row, [j]
        for i in range(1, len(text) + 1):
            row.append(min(above[i - 1] + (text[i - 1] != byte), above[i] + 1, row[-1] + 1))
    return min(row)


def noisy(draw, text, edits):
    text = list(text)
    for _ in range(edits):
        at, kind = draw.randrange(len(text)), draw.randrange(3)
        if kind == 0:
            text[at] = draw.choice("abcdxyz ")
        elif kind == 1:
            del text[at]
        else:
            text.insert(at, draw.choice("abcdxyz "))
    return "".join(text)


@pytest.mark.parametrize("letters", ["abcdefghij klmnop", "ab ", "-"])
@pytest.mark.parametrize(("heavy", "pairs"), [(1, 20_000_000), (16, 20_000_000), (16, 0)])
def test_against_whole_tables(monkeypatch, letters, heavy, pairs):
    monkeypatch.setattr(decontam, "PAIRS", pairs)
    monkeypatch.setattr(decontam, "HEAVY", heavy)
    monkeypatch.setattr(decontam, "AT_ONCE", 500)
    monkeypatch.setattr(decontam, "PART", 40)
    draw = random.Random(len(letters))
    make = lambda n: "".join(draw.choice(letters) for _ in range(n))
    sources = [make(draw.randrange(9, 120)) for _ in range(8)] + ["----------" + make(40), make(3)]
    texts = []
    for _ in range(14):
        inside = " ".join(noisy(draw, draw.choice(sources), draw.randrange(0, 9)) for _ in range(draw.randrange(1, 3)))
        texts.append(make(draw.randrange(0, 80)) + inside + make(draw.randrange(0, 80)))
    texts += ["", "x"]
    raw, items = [decontam.normalise(t) for t in texts], [decontam.normalise(t) for t in sources]
    items = [x for x in items if x]
    compiled = decontam.compile_items(list(range(len(items))), items)
    got = {(d, i): e for d, i, e, _, _ in decontam.occurrences(compiled, raw)}
    want = {}
    for i, item in enumerate(compiled.texts):
        for d, text in enumerate(raw):
            if len(item) < decontam.Q:
                if b" " + item + b" " in b" " + text + b" ":
                    want[d, i] = 0
            elif (best := plain_best(item, text)) <= decontam.budget(len(item)):
                want[d, i] = best
    assert got == want and (want or letters == "-")
    for d, i, edits, begin, end in decontam.occurrences(compiled, raw):
        if len(compiled.texts[i]) >= decontam.Q:
            assert plain_best(compiled.texts[i], raw[d][begin:end]) == edits


def test_counts_do_not_depend_on_the_form():
    """The same stripes whether a q-gram's places are listed or counted by band."""
    draw = random.Random(3)
    items = [bytes(draw.choice(b"ab") for _ in range(90)), b"-" * 300, b"abcabcabc" * 20]
    text = bytes(draw.choice(b"abc-") for _ in range(400)) + b"-" * 500 + b"abcabcabc" * 30 + items[0]
    found = []
    for heavy in (1, 10 ** 9):
        old, decontam.HEAVY = decontam.HEAVY, heavy
        try:
            compiled = decontam.compile_items([0, 1, 2], items)
        finally:
            decontam.HEAVY = old
        found.append(np.vstack(decontam._shared(compiled, text, np.array([0]))))
    assert (found[0] == found[1]).all() and found[0].shape[1] > 50


def test_dashes_in_bounded_memory():
    """An item of dashes against a long text of dashes lists no pair of places."""
    compiled = decontam.compile_items([1], [b"-" * 500])
    begun = time.time()
    hits = list(decontam.occurrences(compiled, [b"-" * 200_000, b"- " * 100_000]))
    assert [h[:3] for h in hits if h[1] == 0] == [(0, 0, 0)] and time.time() - begun < 60
    shared = decontam._shared(compiled, b"-" * 200_000, np.array([0]))
    assert len(shared[0]) < 50_000


def test_halves_of_items(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item, short = prose(50), prose(20)
    half, clean = len(item) // 2 + 8, prose(400)
    rows = [
        (1, prose(40) + " " + item[:half] + " " + prose(40)), (2, prose(40) + " " + noisy(draw, item[-half:], 4)), (3, clean), (4, item),
        (5, prose(40) + item[half // 2 - 4:half // 2 + half + 4]), (6, short[:len(short) // 2]), (7, prose(9) + item[:60] + prose(9)), (8, None), (9, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit(1), "begin": F.lit("x")})
    items = spark.createDataFrame([(70, item), (71, short), (72, None)], "item_id long, text string").withColumn("doc_id", F.lit(5))
    found = {r["doc_id"]: (r["item_id"], r["partial"]) for r in decontam.find(docs, items).collect()}
    assert found == {1: (70, True), 2: (70, True), 4: (70, False), 5: (70, True)}
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {3, 6, 7, 8, 9}

"""Repeated passages: what the automata locate, and shards and blocks of any size."""

import random

import pyarrow as pa
import pytest

from quarrylight.llm import passages

W, P = passages.WINDOW, passages.PHRASE


def words(draw, n, kinds=400):
    return [f"w{draw.randrange(kinds)}" for _ in range(n)]


def table(texts):
    return pa.table({"id": pa.array([i for i, _ in texts], pa.int64()), "text": pa.array([" ".join(t) for _, t in texts], pa.string())})


def test_automaton_locates_every_occurrence():
    """All windows that hold a phrase of the shard, wherever it stands; without phrases none."""
    draw = random.Random(1)
    phrase = [words(draw, P) for _ in range(3)]
    texts = []
    for i in range(20):
        text = words(draw, draw.randrange(0, 300))
        for _ in range(draw.randrange(0, 4)):
            at = draw.randrange(len(text) + 1)
            text[at:at] = draw.choice(phrase)
        texts.append((i, text))
    texts.append((20, phrase[0] * 30))
    found = passages._stream(pa.table({"words": [" ".join(p) for p in phrase]}), table(texts))
    got = {r["id"]: r["start"] for r in found.to_pylist()}
    want = {}
    for i, text in texts:
        starts = [
            s for s in range(len(text) - W + 1) if any(text[a:a + P] in phrase for a in range(s, s + W - P + 1))
        ]
        if starts:
            want[i] = starts
    assert got == want and len(want) > 5
    assert passages._stream(pa.table({"words": pa.array([], pa.string())}), table(texts)).num_rows == 0


@pytest.mark.parametrize(("shard", "stream"), [(1, 1), (10, 3000), (10_000, 2_000_000)])
def test_shards_and_blocks(spark, monkeypatch, shard, stream):
    monkeypatch.setattr(passages, "SHARD", shard)
    monkeypatch.setattr(passages, "STREAM", stream)
    draw = random.Random(2)
    shared = [words(draw, 70) for _ in range(4)]
    rows = []
    for i in range(60):
        text = words(draw, draw.randrange(0, 80))
        for _ in range(draw.randrange(0, 3)):
            text += draw.choice(shared)[draw.randrange(0, 15):] + words(draw, draw.randrange(0, 30))
        rows.append((i, " ".join(text)))
    rows += [(100 + i, rows[5][1]) for i in range(5)] + [(7, rows[7][1]), (7, rows[9][1])]
    got = sorted(tuple(r)[:3] for r in passages.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    first = {}
    for i, text in rows:
        split = text.split()
        for s in range(len(split) - W + 1):
            key = tuple(split[s:s + W])
            first[key] = min(first.get(key, i), i)
    want = []
    for i, text in rows:
        split, gone = text.split(), set()
        for s in range(len(split) - W + 1):
            if first[tuple(split[s:s + W])] < i:
                gone.update(range(s, s + W))
        want.append((i, len(split), len(gone)))
    assert got == sorted(want) and sum(n for _, _, n in got) > 1000

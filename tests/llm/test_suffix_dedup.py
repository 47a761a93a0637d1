import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import suffix_dedup as sd


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60))
def test_suffix_array(t):
    want = sorted(range(len(t)), key=lambda i: t[i:])
    assert sd.suffix_array(np.array(t), 10**6).tolist() == want


def test_large_alphabet():
    t = np.random.default_rng(0).integers(1, 1 << 40, 500) // (1 << 38) * (1 << 30) + 1
    assert sd.suffix_array(t, 10**6).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


@pytest.mark.parametrize("colliding", [False, True])
@settings(max_examples=200, deadline=None)
@given(spans=st.lists(st.text("ab", max_size=30).map(str.encode), min_size=1, max_size=5), sizes=st.tuples(st.integers(2, 5), st.integers(6, 9)))
def test_repeats(colliding, spans, sizes):
    counts = [[max(0, len(s) - z + 1) for s in spans] for z in sizes]
    part = sd._part
    sd._part = (lambda *a: part(*a) & np.uint64(1)) if colliding else part
    try:
        found = sd.repeats(spans, counts, list(sizes))
    finally:
        sd._part = part
    for z, own in zip(sizes, found, strict=True):
        strings = [s[i : i + z] for s in spans for i in range(len(s) - z + 1)]
        c = Counter(strings)
        assert own.twice.tolist() == [c[x] > 1 for x in strings]
        assert own.first.sum() == len(c) and len({x for x, f in zip(strings, own.first, strict=True) if f}) == len(c)


def covered(texts, size):
    c = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    for t in texts:
        edge = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - size + 1):
            if c[t[i : i + size]] > 1:
                edge[i] += 1
                edge[i + size] -= 1
        yield np.cumsum(edge)[: len(t)] > 0


def brute(rows, length, shorter=sd.SHORTER):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (d, _), t, gone, also in zip(rows, texts, covered(texts, length), covered(texts, shorter), strict=True):
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = bytes(b for b, x in zip(t, gone, strict=True) if not x)
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), int(also.sum())))
    return sorted(out, key=str)


def corpus(rng, n, size):
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(size) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [text(rng.randint(0, size))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            parts += [p[a:b], text(rng.randint(0, 5))]
        if rng.random() < 0.1:
            parts.append("z" * rng.randint(0, 40 * size))
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("block_runs", [3, 3000])
def test_against_brute_force(spark, monkeypatch, block_runs):
    monkeypatch.setattr(sd, "BLOCK_RUNS", block_runs)
    monkeypatch.setattr(sd, "BLOCK_BYTES", 5000)
    rows = corpus(random.Random(3), 60, 220)
    rows += [(900, None), (901, ""), (902, "short"), (None, rows[5][1]), (7, rows[7][1]), (7, rows[8][1]), (903, "q" * 399), (904, "q" * 400), (905, "r" * 401)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as d", "2 as r").repartition(4)
    assert sorted(map(tuple, sd.report(df).collect()), key=str) == brute(rows, 400)


def test_many_copies_of_one_passage(spark):
    """A passage of 700 bytes in 2,400 documents, each time with other words around it, and cut short in some."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    passage = " ".join(word() for _ in range(110))
    rows = []
    for i in range(2400):
        own = passage if i % 3 else passage[rng.randrange(300) :]
        rows.append((i, " ".join([word() for _ in range(rng.randint(0, 12))] + [own] + [word() for _ in range(rng.randint(0, 12))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, sd.report(df).collect()), key=str) == brute(rows, 400)


def test_one_size(spark):
    rows = corpus(random.Random(4), 20, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in sd.report(df, 150, None).collect()), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in brute(rows, 150)] and {r[5] for r in got} == {0}
    with pytest.raises(ValueError, match="below"):
        sd.report(df, 150, 150)


def test_empty(spark):
    assert sd.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0

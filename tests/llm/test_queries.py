"""The registered queries that SQL cannot express, over whole tables, against brute force."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from tests.llm.test_bpe import LIB
from tests.llm.test_kneser_ney import brute as brute_scores
from tests.llm.test_line_dedup import words as line_words
from tests.llm.test_simhash import brute_components
from tracewright.llm import line_dedup, queries, token_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet') ORDER BY doc_id").fetchall()


def test_op1(spark, documents):
    texts = [t.encode() for _, t in documents]
    count = {}
    for t in texts:
        for i in range(len(t) - 399):
            h = hashlib.blake2b(t[i : i + 400], digest_size=12).digest()
            count[h] = count.get(h, 0) + 1
    want = []
    for (d, _), t in zip(documents, texts, strict=True):
        gone = np.zeros(len(t) + 1, np.int32)
        for i in range(len(t) - 399):
            if count[hashlib.blake2b(t[i : i + 400], digest_size=12).digest()] > 1:
                gone[i] += 1
                gone[i + 400] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    got = sorted(tuple(r)[:5] for r in queries.op1_suffix_dedup(spark, SF).collect())
    assert got == want
    assert sum(r[2] for r in want) > 0


def test_op2(spark, documents):
    got = {r.doc_id: r for r in queries.op2_token_counts(spark, SF).collect()}
    assert len(got) == len(documents)
    for d, t in documents:
        after = t
        for a, b, new in reversed(token_counts.mask_private(t)):
            after = after[:a] + new + after[b:]
        assert (got[d].n_tokens, got[d].n_tokens_after, got[d].n_chars_after) == (len(LIB.encode_ordinary(t)), len(LIB.encode_ordinary(after)), len(after))
    assert sum(r.n_edits for r in got.values()) > 0


def test_op3(spark, documents):
    assert sorted(map(tuple, queries.op3_simhash(spark, SF).collect())) == brute_components(documents)


def test_op5(spark, documents):
    got = sorted(map(tuple, queries.op5_kneser_ney(spark, SF).collect()))
    for a, b in zip(got, sorted(brute_scores(documents)), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_op6(spark, documents):
    got = queries.op6_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == [d for d, _ in documents]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)


def test_op9(spark, documents):
    """Brute force by a dictionary of all variants, each with the earliest line that has it."""
    lines = [(d, n, line_words(x)) for d, t in documents for n, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]

    def keys(w):
        yield ("whole", tuple(w))
        if len(w) >= line_dedup.MIN_WORDS:
            for i in range(len(w)):
                yield (i, tuple(w[:i] + w[i + 1 :]))

    whole, placed, lost = {}, {}, {}
    for at, (_, _, w) in enumerate(lines):
        for place, k in keys(w):
            if place == "whole":
                whole.setdefault(k, at)
            else:
                placed.setdefault((place, k), at)
                lost.setdefault(k, at)
    gone = {d: [] for d, _ in documents}
    for at, (d, n, w) in enumerate(lines):
        first = [whole[tuple(w)], lost.get(tuple(w), at)]
        if len(w) >= line_dedup.MIN_WORDS:
            for i in range(len(w)):
                k = tuple(w[:i] + w[i + 1 :])
                first += [placed[i, k], whole.get(k, at)]
        if min(first) < at:
            gone[d].append(n)
    got = {r.doc_id: r for r in queries.op9_line_dedup(spark, SF).collect()}
    assert {d: r.removed for d, r in got.items()} == gone
    assert all(got[d].n_lines == t.count("\n") + 1 for d, t in documents)
    assert sum(map(len, gone.values())) > 0


def test_op10(spark, documents):
    want = []
    for d, t in documents:
        ids = LIB.encode_ordinary(t)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, queries.op10_byte_bpe(spark, SF).collect())) == want

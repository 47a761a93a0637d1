import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracewright.llm import kneser_ney as kn
from tracewright.llm import queries


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]


def brute(rows):
    """Scores straight from the formulas."""
    train = [tokens(t) for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 5 != 1]
    c1 = Counter(w for t in train for w in t)
    c2 = Counter(p for t in train for p in zip(["<s>", *t], t))
    before = Counter(w for _, w in c2)
    follow = {}
    for (v, w), n in c2.items():
        follow.setdefault(v, {})[w] = n
    n_of = lambda c: [sum(1 for x in c.values() if x == k) for k in (1, 2, 3, 4)]
    d2, d1 = kn.discounts(n_of(c2)), kn.discounts(n_of(before))
    cut = lambda n, d: max(0, n - d[min(n, 3) - 1]) if n else 0
    total, v_size, n_all = sum(before.values()), len(c1), sum(c1.values())

    gamma = sum(min(x, d1[min(x, 3) - 1]) for x in before.values()) / total if total else 1
    left = {v: (sum(own.values()), sum(d2[min(x, 3) - 1] for x in own.values())) for v, own in follow.items()}

    def p1(w):
        return (cut(before[w], d1) / total if total else 0) + gamma / (v_size + 1)

    def p2(v, w):
        own = follow.get(v)
        if not own:
            return p1(w)
        c, held = left[v]
        return cut(own.get(w, 0), d2) / c + held / c * p1(w)

    out = []
    for d, t in rows:
        own = tokens(t)
        base = sum(math.log10((c1[w] + 0.5) / (n_all + 0.5 * (v_size + 1))) for w in own)
        held = d is None or zlib.crc32(str(d).encode()) % 5 == 1
        out.append((d, held, len(own), sum(c1[w] > 0 for w in own), n_all, base, sum(math.log10(p2(v, w)) for v, w in zip(["<s>", *own], own))))
    for v in ["<s>", "<none>", *list(c1)[:5]]:
        assert abs(sum(p2(v, w) for w in [*c1, "<none>"]) - 1) < 1e-9
    return sorted(out, key=str)


@pytest.mark.parametrize(("per_task", "per_bucket", "held"), [(20, 1 << 27, 4_000_000), (20, 100, 5), (6_000_000, 1 << 27, 4_000_000)])
def test_against_brute_force(spark, monkeypatch, per_task, per_bucket, held):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(40)] + ["É", "Ab"]
    rows = [(i, " ".join(rng.choice(vocab, size=rng.integers(0, 25), p=np.arange(42, 0, -1) / 903).tolist())) for i in range(150)]
    rows += [(900, None), (901, ""), (None, "w1 new"), (902, "\x0b\x1c w1\x85"), (3, rows[3][1])]
    monkeypatch.setattr(kn, "TASK_TOKENS", per_task)
    monkeypatch.setattr(kn, "BUCKET_BYTES", per_bucket)
    monkeypatch.setattr(kn, "HELD_ENTRIES", held)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as bucket").repartition(3)
    got = sorted(map(tuple, kn.score_corpus(df).collect()), key=lambda r: str(r[:5]))
    want = sorted(brute(rows), key=lambda r: str(r[:5]))
    for a, b in zip(sorted(got, key=lambda r: (str(r[0]), r[5])), sorted(want, key=lambda r: (str(r[0]), r[5])), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-9) and a[6] == pytest.approx(b[6], abs=1e-9)


def test_no_training_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    rows = kn.score_corpus(df).collect()
    assert [(r.n_known, r.train_tokens) for r in rows] == [(0, 0), (0, 0)]
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert kn.score_corpus(df.limit(0)).count() == 0


def test_better_than_base(spark):
    rows = {r.held_out: r for r in kn.perplexity(queries.op5_kneser_ney(spark, "/root/testdata/sf0.01")).collect()}
    assert rows[True].perplexity < rows[True].base_perplexity
    assert rows[False].perplexity < rows[False].base_perplexity

import math
import zlib
from collections import Counter

import numpy as np

from tracewright.llm import langid, queries


def test_codewords():
    for n in (2, 3, 4, 6, 9, 20):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code}) == n
        assert (np.abs(code.sum(0)) < n).all()
    assert langid.codewords(4).shape == (4, 7)
    assert min((a != b).sum() for i, a in enumerate(langid.codewords(4)) for b in langid.codewords(4)[:i]) == 4


def test_margins_do_not_depend_on_runs(monkeypatch):
    texts = ["one two three " * 9, "uno dos tres", "", "ßäö é " * 30, "x"]
    model = langid.fit(["one two", "uno dos", "ein zwei"] * 4, ["en", "es", "de"] * 4)
    raw = [langid.letters(x) for x in texts]
    whole = model.margins(raw)
    monkeypatch.setattr(langid, "RUN", 7)
    assert np.allclose(whole, model.margins(raw))
    alone = np.stack([langid.features(x) @ model.weights + model.bias for x in raw if x])
    assert np.allclose(whole[[bool(x) for x in raw]], alone, atol=1e-4)


def test_corrects_a_wrong_bit():
    code = langid.codewords(4)
    model = langid.Model(list("abcd"), code, np.zeros((1, 7)), np.zeros(7))
    for i, word in enumerate(code):
        for bit in range(7):
            margins = word.astype(float) * 2
            margins[bit] *= -1
            best, score, _ = model.decode(margins[None])
            assert best[0] == i and 0 <= score[0] <= 1
    assert model.decode(np.zeros((1, 7)))[2][0]


def test_edges(spark):
    rows = [(i, t, lang) for i in range(40) for t, lang in [(f"the and of number {'x' * (i % 3)}", "en"), ("und der die das", "de")]]
    rows += [(900, None, "en"), (901, "", None), (902, "123 !?", "en"), (903, "der und", None), (None, "the of", "en"), (903, "der und", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as score", "1 as lang_pred")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id >= 900}
    assert [by[k].lang_pred for k in (900, 901, 902, 903, None)] == ["und", "und", "und", "de", "en"]
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", df.lang.substr(9, 1).cast("string"))).collect()} <= {"und", ""}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in queries.op6_language_id(spark, sf).collect() if r.held_out]
    for lang in set(truth.values()) - {None}:
        own = [r for r in got if truth[r.doc_id] == lang]
        assert own and np.mean([r.lang_pred == lang for r in own]) > 0.95, lang


def brute_decode(model, text):
    """A plain loop over n-grams, bits and languages."""
    raw = langid.letters(text or "")
    if not raw:
        return "und", 0.0
    shift = 32 - (langid.FEATURES.bit_length() - 1)
    mask = (1 << 32) - 1
    m = [int(x) for x in langid.MULTIPLY]
    bits = model.weights.shape[1]
    total = [0.0] * bits
    for i in range(len(raw)):
        a, b, c = (raw[i + k] + 1 if i + k < len(raw) else 0 for k in range(3))
        one = a * m[0] & mask
        two = (one ^ b) * m[1] & mask
        three = (two ^ c) * m[2] & mask
        for h in (one >> shift, two >> shift, three >> shift):
            for j in range(bits):
                total[j] += float(model.weights[h, j])
    margins = [t / (3 * len(raw)) + float(model.bias[j]) for j, t in enumerate(total)]
    sure = [abs(math.tanh(x)) for x in margins]
    losses = [sum(s / (1 + math.exp(max(-30, min(30, x * int(w))))) for s, x, w in zip(sure, margins, word, strict=True)) / max(sum(sure), 1e-9) for word in model.code]
    best = min(range(len(losses)), key=losses.__getitem__)
    p = [math.exp(-20 * (x - losses[best])) for x in losses]
    return model.langs[best], max(p) / sum(p)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(langid.sample(docs.filter("not pmod(crc32(cast(doc_id as string)), 4) = 2")))
    got = {r.doc_id: r for r in queries.op6_language_id(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for d, text in rows:
        lang, score = brute_decode(model, text)
        assert got[d].lang_pred == lang and abs(got[d].score - score) < 1e-4


def test_sample_is_shared_by_the_languages(spark):
    rows = [(i, f"the man number {'abcdefghij'[i % 10] * (i % 7 + 1)} {'xyz'[i % 3]}", "en") for i in range(400)] + [(i, "der Mann und die Frau", "de") for i in range(400, 404)]
    rows += [(500, "long " * 30_000, "fr"), (501, None, "fr"), (502, "12", "fr"), (503, "none", None)]
    found = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 30)
    n = Counter(row[2] for row in found)
    assert n["de"] == 4 and n["fr"] == 1 and 5 <= n["en"] <= 10
    at, counts, _ = next(row for row in found if row[2] == "fr")
    whole = np.zeros(langid.FEATURES)
    whole[at] = counts
    assert np.allclose(whole / counts.sum(), langid.features(langid.letters("long " * 30_000)), atol=1e-6)

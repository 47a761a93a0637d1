"""The pipeline against the operators' brute-force versions."""

import hashlib
import random

import numpy as np

import corpus_pipeline
from tests.llm.test_bpe import LIB
from tests.llm.test_decontaminate import brute as brute_items
from tests.llm.test_line_dedup import distance, words
from tests.llm.test_simhash import brute_components
from tracewright.llm import line_dedup


def brute(docs, items):
    docs = [d for d in docs if any(c.isalpha() for c in d[1] or "")]
    earlier, kept = [], []
    for d, text in sorted(docs):
        left, had, gone = [], False, False
        for line in text.split("\n"):
            w = words(line)
            if w and any(w == e or max(len(w), len(e)) >= line_dedup.MIN_WORDS and distance(w, e) <= 1 for e in earlier):
                gone = True
            else:
                left.append(line)
                had |= bool(w)
            if w:
                earlier.append(w)
        if had or not gone:
            kept.append((d, "\n".join(left)))
    first = {c for _, _, c in brute_components(kept)}
    kept = [x for x in kept if x[0] in first]
    bad = {r[0] for r in brute_items(kept, items, 8) if r[5]}
    out = []
    for d, text in kept:
        if d not in bad:
            ids = LIB.encode_ordinary(text)
            out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    vocab = {"en": "the of and to in with that".split(), "de": "der die und ist nicht ein zu".split()}
    text = lambda lang, n: " ".join(rng.choice(vocab[lang]) + rng.choice(["", "", "a", "b", "er"]) for _ in range(n))
    items = [(i, text("en", 12)) for i in range(6)]
    rows = []
    for i in range(70):
        lang = rng.choice(["en", "de"])
        lines = [text(lang, rng.randint(1, 30)) for _ in range(rng.randint(1, 4))]
        if i % 7 == 0:
            lines.append(" ".join(x[1] for x in rng.sample(items, 2)))
        if i % 5 == 0 and rows:
            lines.append(rng.choice(rows)[1].split("\n")[0])
        rows.append((i, "\n".join(lines), lang))
    rows += [(100, rows[3][1], "en"), (101, rows[4][1] + "x", "en"), (102, "123 456", "en"), (103, None, "en"), (104, "", None), (105, "!!", "de"), (106, rows[9][1].split("\n")[0], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' as source", "cast(length(text) as long) n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    want = brute([r[:2] for r in rows], items)
    assert got == want
    assert 20 < len(got) < 70
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_one_passage_is_enough(spark, tmp_path):
    passage = "who wrote the long letter that the old man found"
    spark.createDataFrame([(1, passage), (2, "what does the second of all these items ask us now")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"before it {passage} and after it", "en"), (2, passage.rsplit(" ", 4)[0], "en"), (3, "nothing of the kind", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.benchmarks(spark, docs, str(tmp_path)).collect()) == [2, 3]


def test_language_without_labels(spark, tmp_path):
    rows = [(1, "the old man", None), (2, "123 !?", None), (3, None, None), (4, "\u00e9", None), (None, "ein", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted((r.text for r in got.collect())) == ["ein", "the old man", "\u00e9"]


def test_language_is_filled_in(spark, tmp_path):
    rows = [(i, t, lang) for i in range(40) for t, lang in [(f"the man and the house of wood {'abc'[i % 3]}", "en"), (f"der Mann und das Haus aus Holz {'abc'[i % 3]}", "de")]]
    rows += [(90, "the house and the man of the wood", None), (91, "das Haus und der Mann aus dem Holz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect() if r.doc_id >= 90}
    assert got == {90: "en", 91: "de"}

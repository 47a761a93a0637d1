import hashlib
import random
import re

from tests.llm.oracle import rows_match
from tracewright.llm import decontaminate, queries


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, width):
    out = []
    for d, text in docs:
        own, hit, found = words(text), set(), set()
        for item, t in items:
            w = words(t)
            n = min(width, len(w))
            for s in range(len(w) - n + 1 if n else 0):
                for i in range(len(own) - n + 1):
                    if own[i : i + n] == w[s : s + n]:
                        hit |= set(range(i, i + n))
                        found.add(str(item))
        out.append((d, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


def data():
    rng = random.Random(5)
    vocab = ["a", "B", "é1", "cc", "9"]
    text = lambda n: rng.choice([" ", ", "]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 6, 12]))) for i in range(12)] + [(3, "zz yy xx ww vv"), (77, None)]
    docs = [(i, text(rng.randint(0, 40))) for i in range(60)] + [(100, None), (101, ""), (102, "zz yy xx ww"), (103, "Zz-yy xx\nWW vv! a"), (103, "Zz-yy xx\nWW vv! a")]
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = data()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 50)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as terms").repartition(3)
    b = spark.createDataFrame([*items, (None, "a a a a")], "item_id long, text string")
    for width in (4, 8):
        got = sorted(map(tuple, decontaminate.report(d, b, width).collect()), key=str)
        assert got == brute(docs, items, width)


def test_items_in_chunks(spark, monkeypatch):
    docs, items = data()
    docs = [x for i, x in enumerate(docs) if i < 63]
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 100)
    got = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 4)


def test_repeated_and_null_ids_in_chunks(spark, monkeypatch):
    docs, items = data()
    docs += [(None, docs[7][1]), (None, docs[8][1]), (None, "zz yy xx ww vv"), (5, docs[9][1])]
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 100)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 50)
    got = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), 4)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 4)


def test_near(spark):
    docs = [(1, "x a x x b x"), (2, "a x x x x x b"), (3, "b a"), (4, "a"), (5, "b")]
    index = decontaminate.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    assert sorted(map(tuple, decontaminate.near(index, ["a", "b"], 4).collect())) == [(1, 1, 5), (3, 0, 2)]


def test_empty(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert decontaminate.report(d.limit(0), b).count() == 0
    assert decontaminate.report(d, b.limit(0)).first().n_items == 0


def test_sql(spark):
    rows_match(spark, queries.op8_decontaminate, queries.OP8_SQL)

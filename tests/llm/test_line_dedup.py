import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import line_dedup as ld


def words(line):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs):
    earlier, out = [], []
    for d, text in sorted(docs):
        lines = (text or "").split("\n")
        kept, gone = [], []
        for number, line in enumerate(lines):
            w = words(line)
            if w and any(w == e or max(len(w), len(e)) >= ld.MIN_WORDS and distance(w, e) <= 1 for e in earlier):
                earlier.append(w)
                gone.append(number)
                continue
            if w:
                earlier.append(w)
            kept.append(line)
        out.append((d, 0 if text is None else len(lines), len(gone), gone, "\n".join(kept)))
    return sorted(out)


@given(st.lists(st.sampled_from("abc"), max_size=7), st.lists(st.sampled_from("abc"), max_size=7))
@settings(max_examples=400)
def test_within_one_edit(a, b):
    assert ld.within_one_edit(a, b) == (distance(a, b) <= 1)


def test_halves_meet():
    for n in range(ld.MIN_WORDS, 400):
        for m in (n - 1, n):
            common = (max(n, m) - 1 + 1) // 2
            assert any(g <= common or g <= 2 and n <= 4 for g in ld.half_sizes(n) & ld.half_sizes(m))


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    base = [[rng.choice("abcde") for _ in range(rng.randint(1, 9))] for _ in range(25)]

    def line():
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i = rng.randrange(len(w) + 1)
            if rng.random() < 0.4:
                w.insert(i, rng.choice("abcdé"))
            elif i < len(w):
                w[i : i + 1] = rng.choice([[], ["Q"]])
        return rng.choice([" ", "  "]).join(w)

    docs = [(1000 - i, "\n".join(line() for _ in range(rng.randint(0, 6)))) for i in range(60)]
    docs += [(2000, None), (2001, ""), (2002, "\n\n \n"), (2003, " ".join(["x", "y"] * 900)), (2004, " ".join(["x", "y"] * 900 + ["z"]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as key", "2 as n_lines").repartition(3)
    want = brute(docs)
    assert sorted(map(tuple, ld.report(df).collect())) == [r[:4] for r in want]
    assert sorted((r.doc_id, r.n_lines, r.n_removed, r.text or "") for r in ld.dedup(df, keep="all").collect()) == [(*r[:3], r[4]) for r in want]
    monkeypatch.setattr(ld, "AT_ONCE", 40)
    assert sorted(map(tuple, ld.report(df).collect())) == [r[:4] for r in want]


def test_documents_left(spark):
    rows = [(1, "a\nb\nc d e f g", "x"), (2, "a\nc d e f h", "y"), (3, "\n", "z"), (None, "a", "n"), (4, None, "m"), (5, "a\nnew", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = ld.dedup(df)
    assert got.columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got.collect()), key=str) == sorted([(1, rows[0][1], 0), (3, "\n", 0), (4, None, 0), (5, "new", 1), (None, "a", 0)], key=str)
    assert ld.dedup(df.limit(0)).count() == 0
    assert sorted(r.n_removed for r in ld.dedup(df, fuzzy=False, keep="all").collect()) == [0, 0, 0, 0, 1, 1]


def test_repeated_rows(spark):
    text = "a b c d e f\n\nshort\na b c d e x\ng h i j k l"
    rows = [(1, text, "x"), (1, text, "x"), (2, "m n o p q\nshort", "y"), (2, "m n o p q r\na b c d e f\nnew\nn2", "z"), (3, text, "w"), (None, text, "n"), (None, text, "n"), (4, None, "v"), (4, None, "v"), (4, "", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = sorted((tuple(r) for r in ld.report(df).collect()), key=str)
    assert [r for r in got if r[0] != 2] == sorted([(1, 5, 1, [3]), (1, 5, 4, [0, 2, 3, 4]), (3, 5, 4, [0, 2, 3, 4]), *[(None, 5, 0, [])] * 2, *[(4, 0, 0, [])] * 2, (4, 1, 0, [])], key=str)
    # Of the two texts under one doc_id, that of the smaller hash is the earlier.
    assert [r[3] for r in got if r[0] == 2] in ([[1], [0, 1]], [[0, 1], [1]])
    kept = sorted((r.doc_id, r.text, r.n_removed) for r in ld.dedup(df).collect() if r.doc_id in (1, 3))
    assert kept == [(1, "a b c d e f\n\nshort\ng h i j k l", 1)]
    every = sorted((r.doc_id, r.text, r.n_removed) for r in ld.dedup(df, keep="all").collect() if r.doc_id in (1, 3))
    assert every == [(1, "", 4), (1, "a b c d e f\n\nshort\ng h i j k l", 1), (3, "", 4)]
    assert sum(r.doc_id is None and r.text == text for r in ld.dedup(df).collect()) == 2
    exact = sorted((r.doc_id, r.n_removed) for r in ld.dedup(df, fuzzy=False, keep="all").collect() if r.doc_id in (1, 3))
    assert exact == [(1, 0), (1, 4), (3, 4)]


def test_few_lines_in_many_partitions(spark):
    line, other = "a b c d e f g h i j", "a b c d e f g h i x"
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        for rows in ([(1, line)], [(1, line), (2, other)], [(1, line), (1, line), (2, other)], [(1, line), (1, other)], [(None, line), (3, other)]):
            df = spark.createDataFrame(rows, "doc_id long, text string")
            assert sum(r.n_removed for r in ld.report(df).collect()) == (0 if rows[0][0] is None else len(rows) - 1)
            assert sum(r.n_removed == 0 for r in ld.dedup(df).collect()) == (2 if rows[0][0] is None else 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_long_lines(spark):
    """Places beyond 65,536 words are told apart."""
    words = [f"w{i}" for i in range(70_000)]
    changed = [*words[:69_000], "x", *words[69_001:]]
    twice = [*words[:66_000], "x", *words[66_001:69_000], "x", *words[69_001:]]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(twice)), (4, " ".join(["y", *words[1:66_000], "z", *words[66_001:]]))]
    got = {r.doc_id: r.removed for r in ld.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0], 3: [0], 4: []}

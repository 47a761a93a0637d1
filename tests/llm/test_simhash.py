import random
import re

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import simhash
from tracewright.llm.components import components


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("aB é\t\n\x0b\x85 "), max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fp(text)


def brute_components(rows):
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for (d, _), r in zip(rows, root):
        least[r] = min(d, least.get(r, d))
    return sorted((d, f"{fp:016x}", least[r]) for (d, _), fp, r in zip(rows, fps, root))


def test_near_duplicates(spark):
    rng = random.Random(2)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(200)] for _ in range(4)]
    rows = [(1000 - i, None if i % 9 == 0 else "" if i % 9 == 1 else " ".join(w if rng.random() > 0.004 else "zz" for w in base[i % 4])) for i in range(120)]
    rows += [(5, "one two"), (6, "ONE  two"), (7, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp").repartition(3)
    assert sorted(map(tuple, simhash.near_duplicates(df).collect())) == brute_components(rows)
    kept = sorted(r.doc_id for r in simhash.keep_one(df).collect())
    assert kept == sorted({c for _, _, c in brute_components(rows)})
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_keep_one_of_null_and_repeated_ids(spark):
    rng = random.Random(9)
    a, b, c, d, e = (" ".join(rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(60)) for _ in range(5))
    rows = [(None, a, "alone"), (None, b, "copy"), (1, b, "x"), (1, b, "x"), (2, c, "y"), (5, d, "z"), (2, d, "other"), (3, c, "copy"), (3, e, "w"), (None, e, "copy"), (None, a, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, a, "alone"), (1, b, "x"), (2, c, "y"), (2, d, "other"), (3, e, "w")], key=str)


def test_keep_one_drops_a_copy_under_another_groups_id(spark):
    rng = random.Random(10)
    a, b = (" ".join(rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(60)) for _ in range(2))
    rows = [(1, a), (2, a), (2, b), (None, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(df).collect())) == [(1, a), (2, b)]


def test_links_connect_all_pairs(spark):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(260):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        fps.append(x)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = simhash.local_links(fps, 3)
    assert simhash.Tree().search(1, 3) == []
    brute = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    tops = {x: x for x in fps}
    for a, b in brute:
        lo, hi = sorted((tops[a], tops[b]))
        tops = {x: lo if t == hi else t for x, t in tops.items()}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for rows in (2000, 10):
        found = {r.node % 2**64: r.root for r in components(simhash.links(df, shard_rows=rows)).collect()}
        groups = {}
        for x in fps:
            groups.setdefault(found.get(x, x), set()).add(x)
        expect = {}
        for x in fps:
            expect.setdefault(tops[x], set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))
    assert want


def test_components_of_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 50), (41, 40)], "u long, v long")
    got = sorted(map(tuple, components(edges).collect()))
    assert got == [(i, 0) for i in range(31)] + [(40, 40), (41, 40)]
    assert components(edges.limit(0)).count() == 0

import math

import numpy as np

from tests.llm.oracle import rows_match
from tracewright.llm import queries, topk


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "ROW_BLOCK", 7)
    rows = [(i, [float(x) for x in rng.choice([-0.5, 0.0, 0.25, 3.0], 4)]) for i in range(80)]
    rows += [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(80, 120)]
    rows += [(120, None), (121, [1.0, None, 1.0, 1.0]), (122, [math.nan] * 4), (123, [math.inf] * 4), (None, [1.0] * 4), (124, [2.0, 1.0]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as score").repartition(4)
    got = sorted(map(tuple, topk.top_k(df, df.filter("vec_id % 10 = 0"), k=6).collect()))
    ok = {i: np.floor(1024 * np.array(v + [0.0] * (4 - len(v)))).astype(int) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in ok if i % 10 == 0):
        best = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q)[:6]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, df, k=10).collect())) == [(0, 1, 1, 1024 * 2048), (1, 1, 0, 1024 * 2048)]
    assert topk.top_k(df.limit(0), df).count() == 0
    assert topk.top_k(df, df.limit(0)).count() == 0


def test_sql(spark):
    rows_match(spark, queries.op7_top_k, queries.OP7_SQL)

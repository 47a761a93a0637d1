"""Compares a registered query with its SQL on a folder of tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_match(spark, query, sql, sf_dir="/root/testdata/sf0.001"):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = query(spark, sf_dir)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(r) for r in got.select(*names).collect()), key=key)
    b = sorted(want.fetchall(), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or isinstance(u, float) and abs(u - v) <= 1e-9 * max(1, abs(u)), (x, y)

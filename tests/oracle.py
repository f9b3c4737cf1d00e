"""Compare a query with its SQL, as sorted rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def compare(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == names
    want = con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    mine = [tuple(r) for r in got.select(*names).collect()]
    key = lambda r: tuple(map(str, r))
    a, b = (sorted((tuple(map(plain, r)) for r in x), key=key) for x in (mine, want))
    assert a == b, [(x, y) for x, y in zip(a, b) if x != y][:3]

"""Run a query and its SQL over the same tables and compare the rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows_of(pairs):
    names = sorted(pairs[0])
    order = [pairs[0].index(n) for n in names]
    plain = lambda v: float(v) if hasattr(v, "as_tuple") else v
    return names, sorted((tuple(plain(r[i]) for i in order) for r in pairs[1]), key=str)


def compare(df, con, sql):
    rel = con.sql(sql)
    got = rows_of((df.columns, [tuple(r) for r in df.collect()]))
    want = rows_of((rel.columns, rel.fetchall()))
    return got, want

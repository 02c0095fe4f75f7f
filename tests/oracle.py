"""Compare a registered query with its SQL on the same tables."""

import glob
import os


def _plain(v):
    if isinstance(v, float):
        return "null" if v != v else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return repr([_plain(x) for x in v])
    return "null" if v is None else str(v)


def compare(spark, sf_dir, query, sql):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    df = query(spark, sf_dir)
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    mine = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    theirs = sorted(tuple(_plain(r[names.index(c)]) for c in cols) for r in got.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs

"""Rounded vectors against their SQL to the last bit, signs of zeros too."""

import duckdb
import pytest

from inkwell.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize(("name", "keys", "column"), [("e2_l2_normalize", ["vec_id"], "unit"), ("e6_unpack", ["vec_id", "token"], "values")])
def test_rounded_vectors_are_those_of_sql(spark, tmp_path, name, keys, column):
    rows = [(i, [(-1.0) ** j * (1e-8 if (i + j) % 5 == 0 else 0.5 + j / 100 + i) for j in range(64)]) for i in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = {tuple(r[:-1]): repr(r[-1]) for r in con.execute(f'select {", ".join(keys)}, "{column}" from ({ORACLE[name]})').fetchall()}
    assert any("-0.0" in v for v in want.values())
    assert {tuple(r[k] for k in keys): repr(list(r[column])) for r in QUERIES[name](spark, str(tmp_path)).collect()} == want

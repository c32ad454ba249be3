import duckdb
import pandas as pd
import pytest

from kinlink.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries()[name](spark, SF).toPandas(), con.execute(oracle_sql()[name]).df()
    pd.testing.assert_frame_equal(*[df[sorted(df.columns)].sort_values("doc_id").reset_index(drop=True) for df in (got, want)], check_dtype=False)

import duckdb
import pytest

from rayframe.operators import volume
from rayframe.plans import catalogue, scanner


@pytest.mark.parametrize("module", [catalogue, volume, scanner])
def test_same_rows_as_duckdb(spark, module):
    d, c = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("lineitem", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS FROM '{d}/{t}.parquet'")
    assert set(module.QUERIES) == set(module.SQL)
    for name, f in module.QUERIES.items():
        df, rel = f(spark, d), c.sql(module.SQL[name])
        assert sorted(df.columns) == sorted(rel.columns), name
        rows = [tuple(r[rel.columns.index(k)] for k in df.columns) for r in rel.fetchall()]
        assert sorted(map(tuple, df.collect())) == sorted(rows), name

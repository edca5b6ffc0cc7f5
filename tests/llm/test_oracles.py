import duckdb
import pytest

import __spark_entry__ as entry
from modelgate.sources.tables import TABLES
from tests.conftest import SF0001


@pytest.mark.parametrize("name", ["op2_embedding_dedup", "op4_license_scan", "op6_url_filters", "op13_collocations"])
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    df = entry.queries()[name](spark, SF0001)
    want = con.execute(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    at = {d[0]: i for i, d in enumerate(want.description)}
    assert sorted(at) == columns
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[at[c]] for c in columns) for r in want.fetchall()), key=repr)

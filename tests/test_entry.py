import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SKIP = ("op", "pipeline")


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith(SKIP)])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '{SMALL}/{t}.parquet'")
    ours = entry.queries()[name](spark, SMALL).toPandas()
    theirs = con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    assert len(a) == len(b)
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c

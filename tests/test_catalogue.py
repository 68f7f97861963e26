"""Every query with SQL gives the rows that DuckDB gives for that SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(table, names):
    out = []
    for r in table:
        out.append(tuple(f"{x:.5f}" if isinstance(x, float) and not math.isnan(x) else str(x) for _, x in sorted(zip(names, r, strict=True))))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(entry.catalogue.QUERIES)))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    c = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in c.description]
    expected = rows(c.fetchall(), names)
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.collect(), df.columns) == expected


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0

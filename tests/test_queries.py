import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
OWN = sorted(n for n in entry.own.Q)
TABLES = "customer documents events benchmark".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def tidy(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = tidy(df.columns, [tuple(r) for r in df.collect()])
    if name in entry.oracle_sql():
        rel = con.sql(entry.oracle_sql()[name])
        assert sorted(df.columns) == sorted(rel.columns) and got == tidy(rel.columns, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["seq_id", "start", "end", "refined", "name"]


def test_windows_of_a_whole_document_meet(spark):
    p = entry.own.P
    assert p.windows == 1000 and entry.own.NARROW.windows == 10
    far = entry.queries()["ani_matrix"](spark, SF).where("j - i >= 10").count()
    assert far > 0 and entry.queries()["ani_cross_band"](spark, SF).count() > 0

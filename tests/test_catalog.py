"""Every query of the catalogue against its SQL on the smallest tables."""

import duckdb
import pytest

from gridloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(names), sorted(([plain(r[i]) for i in order] for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in catalog.ORACLES:
        cur = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in cur.description]
        assert mine == rows(names, cur.fetchall())
    else:
        assert mine[1] or name == "ridge_consensus"


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert catalog.FLAGSHIP in e.queries()

"""Queries against their SQL on events denser than those of the given tables."""

import duckdb
import numpy as np
import pytest
from test_catalog import SF, rows

from gridloom.plans import catalog


@pytest.fixture
def against_sql(spark, tmp_path):
    """A function that holds a query against its SQL on a table of events given as SQL over ``given``; gives the number of rows."""

    def compare(name: str, events: str) -> int:
        c = duckdb.connect()
        c.execute(f"CREATE VIEW given AS SELECT * FROM '{SF}/events.parquet'")
        c.execute(f"CREATE OR REPLACE TABLE events AS {events}")
        c.execute(f"COPY events TO '{tmp_path}/events.parquet'")
        df = catalog.QUERIES[name](spark, str(tmp_path))
        cur = c.execute(catalog.ORACLES[name])
        mine, names = [tuple(r) for r in df.collect()], [d[0] for d in cur.description]
        assert rows(df.columns, mine) == rows(names, cur.fetchall())
        return len(mine)

    return compare


def test_report_decode_counts_beyond_two_digits(against_sql):
    many = "SELECT g.* REPLACE (event_id * 1200 + k AS event_id) FROM given g, range({}) r(k) WHERE event_id < 20"
    assert against_sql("report_decode", many.format(101)) == against_sql("report_decode", many.format(1200))


def test_period_plan_of_events_at_the_same_moment(against_sql):
    assert against_sql("period_plan", "SELECT g.* REPLACE (event_id * 3 + k AS event_id) FROM given g, range(3) r(k) WHERE event_id < 300 OR k = 0") == 1000


def test_unweighted_quantiles_are_those_of_sql_bit_by_bit(spark):
    from gridloom.operators import fitting

    g = np.random.default_rng(5)
    pairs = [(k, float(x), float(x) / 40) for k in range(20) for x in np.round(g.exponential(40, 3 + 29 * k) if k else [7.1, 7.1, 7.1], k % 4)]
    maps = fitting.quantile_map(spark.createDataFrame(pairs, "k long, f double, o double"), ["k"], "f", "o", 5, least=1)
    c = duckdb.connect()
    c.execute("CREATE TABLE p AS SELECT unnest(?::BIGINT[]) AS k, unnest(?::DOUBLE[]) AS f, unnest(?::DOUBLE[]) AS o", [list(x) for x in zip(*pairs)])
    want = c.execute("SELECT k, quantile_cont(f, [0, 0.25, 0.5, 0.75, 1.0]), quantile_cont(o, [0, 0.25, 0.5, 0.75, 1.0]) FROM p GROUP BY k").fetchall()
    assert sorted((r.k, r.fq, r.oq) for r in maps.collect()) == sorted((k, list(a), list(b)) for k, a, b in want)

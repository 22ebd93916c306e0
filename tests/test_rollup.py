"""Sales views from the roll-up: equal to the views over the lines, for every kind of range and channel."""

import datetime as dt
import os
import random

import pytest

from ledgerlens.operators import rollup as R
from ledgerlens.operators import sales as S
from ledgerlens.plans.rollup import SalesRollup
from ledgerlens.plans.workspace import Workspace

SF = "/root/testdata/sf0.001"
SCHEMA = ("orderid string, timestamp timestamp_ntz, productname string, category string, netsale decimal(18,4), costofgoodssold decimal(18,4), "
          "city string, locationid string, channel string, orderstatus string, date date, week string, month string")
RANGES = [(None, None), ("2024-01-01", "2024-03-31"), ("2024-01-10", "2024-03-05"), ("2024-02-03", "2024-02-20"), ("2024-02-01", "2024-02-29"),
          ("2024-01-31", "2024-02-01"), ("2024-02-15", None), (None, "2024-02-15"), ("2024-03-01", "2024-02-01"), ("2024-02-20", "2024-02-03"),
          ("2030-01-01", "2030-12-31"), ("2024-02-29", "2024-02-29")]


def _lines(spark, n=600, seed=1):
    """Orders of one line, of many days and channels, null order ids, channels, dates, sums and keys."""
    r, out = random.Random(seed), []
    for i in range(n):
        day = None if r.random() < 0.05 else dt.date(2023, 12, 20) + dt.timedelta(days=r.randrange(120))
        ts = day and dt.datetime.combine(day, dt.time(r.randrange(24), 5))
        order = None if r.random() < 0.05 else f"o{r.randrange(n // 3)}"
        out.append((order, ts, r.choice([None, "p1", "p2", "p3"]), r.choice(["a", "b"]), None if r.random() < 0.1 else r.randrange(-500, 9000),
                    r.randrange(400), r.choice([None, "x", "y"]), r.choice(["1", "2"]), r.choice([None, "web", "app"]),
                    r.choice(["Returned", "Completed", "Pending", None]), day))
    raw = spark.createDataFrame([(*x[:4], x[4] if x[4] is None else str(x[4]), str(x[5]), *x[6:]) for x in out],
                                "orderid string, timestamp timestamp_ntz, productname string, category string, netsale string, costofgoodssold string, "
                                "city string, locationid string, channel string, orderstatus string, date date")
    return raw.selectExpr("orderid", "timestamp", "productname", "category", "cast(netsale as decimal(18,4)) netsale",
                          "cast(costofgoodssold as decimal(18,4)) costofgoodssold", "city", "locationid", "channel", "orderstatus", "date",
                          "date_format(date, 'yyyy-DDD') week", "date_format(date, 'yyyy-MM') month")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark):
    lines = _lines(spark).cache()
    cells = R.order_cells(lines)
    return lines, R.day_cells(lines, cells).cache(), R.spanning_orders(cells).cache(), R.month_keys(lines).cache()


@pytest.mark.parametrize("start,end", RANGES)
@pytest.mark.parametrize("channel", ["All", "web"])
def test_views_equal_those_over_the_lines(spark, tables, start, end, channel):
    lines, cells, spanning, keys = tables
    chosen = S.filter_sales(lines, start, end, channel)
    funnel = spark.createDataFrame([("w", 100, 50, 20)], "week string, visits long, carts long, orders long")
    assert spanning.count() > 0
    assert _rows(R.kpis(cells, spanning, start, end, channel)) == _rows(S.sales_kpis(chosen))
    assert _rows(R.funnel(cells, spanning, funnel, start, end, channel)) == _rows(S.sales_funnel(chosen, funnel))
    assert _rows(R.trend(cells, "month", start, end, channel)) == _rows(S.sales_trend(chosen, "month"))
    assert _rows(R.by_channel(cells, start, end, channel)) == _rows(S.sales_by(chosen, "channel"))
    edges = R.split_range(start, end)[1]
    parts = [S.filter_sales(lines, a, b) for a, b in edges]
    edge = parts[0].unionByName(parts[-1]) if len(parts) == 2 else (parts or [None])[0]
    assert _rows(R.by_key(keys, edge, "productname", start, end, channel)) == _rows(S.sales_by(chosen, "productname"))


def test_no_lines(spark):
    lines = spark.createDataFrame([], SCHEMA)
    cells = R.order_cells(lines)
    assert R.day_cells(lines, cells).count() == R.spanning_orders(cells).count() == R.month_keys(lines).count() == 0
    assert _rows(R.kpis(R.day_cells(lines, cells), R.spanning_orders(cells))) == _rows(S.sales_kpis(lines))


def test_ranges_split_into_whole_months_and_edges():
    d = dt.date
    assert R.split_range("2024-01-10", "2024-03-05") == ((202402, 202402), [(d(2024, 1, 10), d(2024, 1, 31)), (d(2024, 3, 1), d(2024, 3, 5))])
    assert R.split_range("2023-12-01", "2024-02-29") == ((202312, 202402), [])
    assert R.split_range("2024-12-31", None) == ((202501, None), [(d(2024, 12, 31), d(2024, 12, 31))])
    assert R.split_range("2024-02-03", "2024-02-20") == ((1, 0), [(d(2024, 2, 3), d(2024, 2, 20))])
    assert R.split_range("2024-03-01", "2024-02-01")[1] == []


@pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")
def test_a_year_reads_lines_of_two_months_at_most(spark):
    from pyspark.sql import functions as F

    rollup = SalesRollup(Workspace.of(spark, SF))
    year = ("1996-03-10", "1997-03-09")
    files = rollup.edge_lines(*year).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("fact_month=")[1][:6] for r in files} == {"199603", "199703"}
    views = rollup.sales_tab(spark.createDataFrame([("w", 9, 5, 2)], "week string, visits long, carts long, orders long"), *year)
    for name in ("kpis", "funnel", "trend", "by_channel"):  # no line is read
        plan = views[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "costofgoodssold" not in plan and "productname" not in plan
    from ledgerlens.plans import tabs

    funnel = spark.createDataFrame([("w", 9, 5, 2)], "week string, visits long, carts long, orders long")
    for name, df in tabs.sales_tab(rollup.workspace.sales(), funnel, *year).items():
        assert _rows(views[name]) == _rows(df), name
    assert SalesRollup(rollup.workspace).path() == rollup.path()

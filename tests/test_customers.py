import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import customers as C

AS_OF = dt.datetime(2025, 7, 1)
SALES = "orderid string, timestamp timestamp_ntz, customerid string, netsale decimal(19,4), quantity int"
CUST = "customerid string, joindate timestamp_ntz, city string, segment string"


def ago(days):
    return AS_OF - dt.timedelta(days=days)


def test_status_rule_boundaries(spark):
    cust = spark.createDataFrame([
        ("new90", ago(90), "X", "Gold"), ("old91", ago(91), "X", "Gold"),
        ("r90", ago(400), "X", "Gold"), ("r91", ago(400), "X", "Gold"),
        ("r180", ago(400), "X", "Gold"), ("r181", ago(400), "X", "Gold"),
        ("none", ago(400), "X", "Gold"), ("nulljoin", None, "X", "Gold"),
    ], CUST)
    sales = spark.createDataFrame([
        ("o1", ago(5), "new90", Decimal("1"), 1), ("o2", ago(5), "old91", Decimal("1"), 1),
        ("o3", ago(90), "r90", Decimal("1"), 1), ("o4", ago(91), "r91", Decimal("1"), 1),
        ("o5", ago(180), "r180", Decimal("1"), 1), ("o6", ago(181), "r181", Decimal("1"), 1),
        ("o7", ago(200), "nulljoin", Decimal("1"), 1),
    ], SALES)
    got = {r.customerid: r.status for r in C.customer_status(cust, sales, AS_OF).collect()}
    assert got == {"new90": "New", "old91": "Active", "r90": "Active", "r91": "Dormant (At-Risk)",
                   "r180": "Dormant (At-Risk)", "r181": "Churn Risk", "none": "Never Purchased",
                   "nulljoin": "Churn Risk"}


def test_rfm_distinct_orders_and_default_as_of(spark):
    sales = spark.createDataFrame([
        ("o1", dt.datetime(2025, 1, 1), "a", Decimal("2"), 1), ("o1", dt.datetime(2025, 1, 1), "a", Decimal("3"), 1),
        ("o2", dt.datetime(2025, 1, 10), "a", None, 1), ("o3", dt.datetime(2025, 1, 20), "b", Decimal("1"), 1),
        ("o4", dt.datetime(2025, 1, 20), None, Decimal("1"), 1),
    ], SALES)
    got = {r.customerid: (r.frequency, r.monetary, r.recency) for r in C.rfm(sales).collect()}
    # default as_of = latest sale + 1 day = 2025-01-21
    assert got == {"a": (2, 5.0, 11), "b": (1, 1.0, 1)}


def test_empty_sales_gives_empty_status(spark):
    cust = spark.createDataFrame([("a", ago(400), "X", "Gold")], CUST)
    sales = spark.createDataFrame([], SALES)
    assert C.customer_status(cust, sales, AS_OF).count() == 0


def test_top_customers_nulls_last_and_lists(spark):
    st = spark.createDataFrame([
        ("a", None, "X", "Gold", None, 0, None, None, "Never Purchased"),
        ("b", ago(10), "X", "Gold", ago(1), 1, 5.0, 1, "New"),
        ("c", ago(400), "X", "Gold", ago(300), 2, 9.0, 300, "Churn Risk"),
    ], "customerid string, joindate timestamp_ntz, city string, segment string, last_purchase_date timestamp_ntz, "
       "frequency bigint, monetary double, recency bigint, status string")
    assert [r.customerid for r in C.top_customers(st, 20).collect()] == ["c", "b", "a"]
    assert [r.customerid for r in C.churn_risk_customers(st).collect()] == ["c"]
    assert [r.customerid for r in C.new_customers(st).collect()] == ["b"]
    counts = C.status_counts(st).first()
    assert (counts.total_customers, counts.active_customers, counts.churn_risk_customers) == (3, 0, 1)
    assert [tuple(r) for r in C.status_distribution(st).collect()] == [
        ("Churn Risk", 1), ("Never Purchased", 1), ("New", 1)]


def test_export_lists_select_and_write(spark, tmp_path):
    from ledgerlens.sources import ingest as I

    st = spark.createDataFrame([
        ("a", "Never Purchased", None), ("b", "New", 5.0), ("c", "Churn Risk", 9.0), ("d", "Churn Risk", 1.0),
    ], "customerid string, status string, monetary double")
    assert [r.customerid for r in C.customer_list(st, "top_value").collect()] == ["c", "b", "d", "a"]
    assert sorted(r.customerid for r in C.customer_list(st, "churn_risk").collect()) == ["c", "d"]
    out = I.export_csv(C.customer_list(st, "new"), str(tmp_path), "new_customers", day="2025-02-03")
    assert out.endswith("new_customers_2025-02-03.csv")
    assert [r.customerid for r in I.read_csv(spark, out).collect()] == ["b"]


@pytest.mark.parametrize("n, ranges", [(0, 3), (1, 4), (7, 3), (2000, 7)])
def test_positions_are_gapless_over_all_ranges(spark, tmp_path, n, ranges):
    from ledgerlens.operators.ordering import with_position

    rows = [(f"c{i:05}", None if i % 11 == 0 else float(i % 5 if i % 2 else 7)) for i in range(n)]  # most values are equal
    df = spark.createDataFrame(rows, "customerid string, monetary double").repartition(5)
    out = with_position(df, F.col("monetary").desc_nulls_last(), F.col("customerid"), ranges=ranges)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r.customerid, r.monetary) for r in sorted(out.collect(), key=lambda r: r.position)] == want
    assert sorted(r.position for r in out.collect()) == list(range(1, n + 1))
    if n > 1000:
        assert out.select(F.spark_partition_id()).distinct().count() > 1

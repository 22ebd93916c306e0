import datetime as dt
from decimal import Decimal

from ledgerlens.operators import delivery as D

SCHEMA = ("deliveryid string, orderid string, orderdate date, promiseddate date, actualdeliverydate date, "
          "status string, deliverypartner string, city string, deliverycost decimal(10,2)")


def d(i, od, pd_, ad, status="Delivered", partner="P1", city="C1", cost="10.00"):
    return (str(i), str(i), od, pd_, ad, status, partner, city, Decimal(cost) if cost else None)


def _frame(spark, data):
    return D.enrich_deliveries(spark.createDataFrame(data, SCHEMA))


def test_on_time_null_actual_is_late_and_equal_is_on_time(spark):
    a = dt.date(2025, 1, 1)
    df = _frame(spark, [d(1, a, dt.date(2025, 1, 5), None, "Shipped"), d(2, a, dt.date(2025, 1, 5), dt.date(2025, 1, 5))])
    got = {r.deliveryid: (r.on_time, r.delivery_time_days) for r in df.collect()}
    assert got == {"1": (False, None), "2": (True, 4)}


def test_kpis_denominator_includes_undelivered(spark):
    a = dt.date(2025, 1, 1)
    df = _frame(spark, [d(1, a, dt.date(2025, 1, 5), None, "Pending", cost=None),
                        d(2, a, dt.date(2025, 1, 5), dt.date(2025, 1, 3), cost="20.00"),
                        d(3, a, dt.date(2025, 1, 5), dt.date(2025, 1, 9), "Failed", cost="10.00"),
                        d(4, a, dt.date(2025, 1, 5), dt.date(2025, 1, 2), status=None)])
    k = D.delivery_kpis(df).first()
    assert k.row_count == 4 and k.on_time_rate == 50.0 and k.failed_rate == 25.0
    assert k.avg_delivery_days == (2 + 8 + 1) / 3 and k.avg_delivery_cost == 40.0 / 3


def test_pipeline_fixed_statuses_zero_filled(spark):
    a = dt.date(2025, 1, 1)
    df = _frame(spark, [d(1, a, a, None, "Pending"), d(2, a, a, a, "Cancelled"), d(3, a, a, a, "Delivered")])
    got = [tuple(r) for r in D.delivery_pipeline(df).collect()]
    assert got == [(1, "Pending", 1), (2, "Shipped", 0), (3, "Delivered", 1), (4, "Failed", 0)]


def test_city_without_delivery_keeps_null_and_partner_order(spark):
    a = dt.date(2025, 1, 1)
    df = _frame(spark, [d(1, a, a, None, "Pending", "P2", "C1"), d(2, a, dt.date(2025, 1, 9), dt.date(2025, 1, 3), partner="P1", city="C2")])
    cities = {r.city: r.avg_delivery_days for r in D.delivery_time_by_city(df).collect()}
    assert cities == {"C1": None, "C2": 2.0}
    assert [tuple(r) for r in D.partner_on_time(df).collect()] == [("P2", 0.0), ("P1", 100.0)]


def test_filter_partner_and_range(spark):
    a, b = dt.date(2025, 1, 1), dt.date(2025, 2, 1)
    df = _frame(spark, [d(1, a, a, a, partner="P1"), d(2, b, b, b, partner="P2"), d(3, None, a, a)])
    assert D.filter_deliveries(df).count() == 2
    assert [r.deliveryid for r in D.filter_deliveries(df, "2025-01-01", "2025-01-31", "P1").collect()] == ["1"]


def test_pipeline_counts_bounded_by_rows_on_driver_tables(spark):
    from ledgerlens.plans.workspace import deliveries_fact

    df = deliveries_fact(spark, "/root/testdata/sf0.001")
    rows = D.delivery_kpis(df).first().row_count
    pipeline = {r.status: r.orders for r in D.delivery_pipeline(df).collect()}
    assert sum(pipeline.values()) <= rows
    assert sum(pipeline.values()) == df.where(df.status.isin(*D.PIPELINE_STATUSES)).count()
    by_city = D.delivery_time_by_city(df).collect()
    assert len(by_city) == df.select("city").distinct().count()


def test_no_deliveries_no_pipeline_rows(spark):
    a = dt.date(2025, 1, 1)
    df = _frame(spark, [d(1, a, a, a)])
    assert D.delivery_pipeline(D.filter_deliveries(df, "2030-01-01", "2030-01-02")).count() == 0
    k = D.delivery_kpis(D.filter_deliveries(df, "2030-01-01", "2030-01-02")).first()
    assert k.row_count == 0 and k.on_time_rate is None

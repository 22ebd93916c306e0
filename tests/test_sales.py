import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import sales as S

SCHEMA = ("orderid string, timestamp timestamp_ntz, productname string, category string, "
          "grossvalue decimal(18,2), discountvalue decimal(18,4), costofgoodssold decimal(18,4), "
          "city string, locationid string, channel string, orderstatus string")


def _sales(spark, data):
    return S.enrich_sales(spark.createDataFrame(data, SCHEMA))


def line(o, day, prod="p", cat="c", gross="10", disc="0", cost="4", city="X", loc="L1", ch="web", st="Completed"):
    def dec(x):
        return None if x is None else Decimal(x)

    return (o, dt.datetime(2025, 1, day, 12), prod, cat, dec(gross), dec(disc), dec(cost), city, loc, ch, st)


def test_enrich_missing_discount_column_counts_as_zero(spark):
    df = spark.createDataFrame([("1", dt.datetime(2025, 1, 1), Decimal("10.00"))],
                               "orderid string, timestamp timestamp_ntz, grossvalue decimal(18,2)")
    out = S.enrich_sales(df).first()
    assert out.netsale == Decimal("10.00") and out.date == dt.date(2025, 1, 1) and out.month == "2025-01"


def test_enrich_null_value_stays_null(spark):
    s = _sales(spark, [line("1", 1, gross=None)])
    assert s.first().netsale is None


def test_filter_end_date_inclusive_and_channel(spark):
    s = _sales(spark, [line("1", 1), line("2", 5), line("3", 6), line("4", 5, ch=None)])
    kept = {r.orderid for r in S.filter_sales(s, "2025-01-01", "2025-01-05").collect()}
    assert kept == {"1", "2", "4"}
    kept_web = {r.orderid for r in S.filter_sales(s, "2025-01-01", "2025-01-05", "web").collect()}
    assert kept_web == {"1", "2"}


def test_kpis_order_returned_and_completed_counts_in_both(spark):
    s = _sales(spark, [line("1", 1, st="Returned"), line("1", 1, st="Completed"), line("2", 2)])
    k = S.sales_kpis(s).first()
    assert k.total_orders == 2 and k.returned_orders == 1
    assert k.return_rate == 50.0
    assert k.total_revenue == 30.0 and k.net_profit == 18.0 and k.aov == 15.0
    assert k.gross_margin == pytest.approx(60.0)


def test_kpis_empty_selection_reports_no_data(spark):
    s = S.filter_sales(_sales(spark, [line("1", 1)]), "2030-01-01", "2030-01-02")
    k = S.sales_kpis(s).first()
    assert k.row_count == 0 and k.total_revenue is None and k.total_orders is None


def test_null_category_is_not_a_group(spark):
    s = _sales(spark, [line("1", 1, cat=None), line("2", 1, cat="a")])
    assert [tuple(r) for r in S.sales_by(s, "category").collect()] == [("a", 10.0)]


def test_top_k_tie_lower_key_wins(spark):
    data = [line(str(i), 1, prod=f"p{i:02d}") for i in range(12)]
    s = _sales(spark, data)
    got = [r.productname for r in S.top_by_netsale(s, "productname", 10).collect()]
    assert got == [f"p{i:02d}" for i in range(10)]


def test_funnel_uses_whole_funnel_and_filtered_fulfilled(spark):
    s = _sales(spark, [line("1", 1), line("2", 2, st="Returned"), line("3", 3)])
    funnel = spark.createDataFrame([(dt.date(2025, 1, 6), 100, 10, 5), (dt.date(2025, 1, 13), 100, 10, 5)],
                                   "week date, visits bigint, carts bigint, orders bigint")
    got = [tuple(r) for r in S.sales_funnel(s, funnel).collect()]
    assert got == [(1, "Visits", 200, 100.0), (2, "Carts", 20, 10.0), (3, "Orders", 10, 5.0),
                   (4, "Fulfilled", 2, 1.0)]
    empty = funnel.where(F.lit(False))
    assert S.sales_funnel(s, empty).count() == 0
    assert S.sales_funnel(S.filter_sales(s, "2030-01-01", "2030-01-31"), funnel).count() == 0


def test_breakdowns_equal_separate_and_sum_to_total(spark):
    data = [line(str(i), 1 + i % 9, prod=f"p{i % 4}", cat=f"c{i % 3}", city=f"x{i % 5}", loc=f"l{i % 2}",
                 ch=["web", "app", None][i % 3], gross=str(10 + i)) for i in range(40)]
    s = _sales(spark, data)
    b = S.sales_breakdowns(s)
    total = S.sales_kpis(s).first().total_revenue
    for key in S.BREAKDOWN_KEYS:
        one = {(str(r[0]), r[1]) for r in S.sales_by(s, key).collect()}
        many = {(r.key, r.netsale) for r in b.where(F.col("breakdown") == key).collect()}
        assert one == many, key
        if key != "channel":
            assert sum(v for _, v in one) == pytest.approx(total)


def test_filter_domain_and_bounds(spark):
    s = _sales(spark, [line("1", 3, ch="web"), line("2", 1, ch="app"), line("3", 2, ch=None)])
    assert [r[0] for r in S.channel_domain(s).collect()] == ["app", "web"]
    b = S.date_bounds(s).first()
    assert (b.min_date, b.max_date) == (dt.date(2025, 1, 1), dt.date(2025, 1, 3))

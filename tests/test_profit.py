from decimal import Decimal

from ledgerlens.operators import profit as P

SCHEMA = ("orderid string, productname string, category string, channel string, orderstatus string, "
          "netsale decimal(19,4), costofgoodssold decimal(18,4)")


def _lines(spark, data):
    return P.profit_lines(spark.createDataFrame(data, SCHEMA))


def test_margin_guard_zero_and_null(spark):
    df = _lines(spark, [("1", "a", "c", "web", "Completed", Decimal(0), Decimal(3)),
                        ("2", "a", "c", "web", "Completed", None, Decimal(3)),
                        ("3", "a", "c", "web", "Completed", Decimal(10), Decimal(4))])
    assert {r.orderid: r.profit_margin for r in df.collect()} == {"1": 0.0, "2": None, "3": 60.0}


def test_kpis_and_returns_loss(spark):
    df = _lines(spark, [("1", "a", "c", "web", "Returned", Decimal(10), Decimal(4)),
                        ("2", "b", "c", "web", "Completed", Decimal(20), Decimal(5))])
    k = P.profit_kpis(df).first()
    assert (k.total_net_profit, k.profit_lost_to_returns) == (21.0, 14.0)
    assert k.avg_profit_margin == round((60.0 + 75.0) / 2, 6)


def test_recommendation_first_losing_channel_in_key_order(spark):
    df = _lines(spark, [("1", "a", "c", "Z", "Completed", Decimal(1), Decimal(10)),
                        ("2", "b", "c", "B", "Completed", Decimal(1), Decimal(2)),
                        ("3", "c", "c", "M", "Completed", Decimal(100), Decimal(1))])
    got = [tuple(r) for r in P.recommendations(df).collect()]
    assert (2, "Channel 'B' is unprofitable. Review marketing strategy.") in got
    assert got[-1] == (3, "'c' has a high margin. Consider promoting it.")
    assert all(r[0] != 1 for r in got)


def test_no_rule_fires(spark):
    df = _lines(spark, [("1", None, "c", "web", "Completed", Decimal(0), Decimal(0))])
    assert [tuple(r) for r in P.recommendations(df).collect()] == [(0, "No critical issues detected.")]


def test_margin_lists_tie_and_skip_null(spark):
    data = [(str(i), f"p{i}", "c", "web", "Completed", Decimal(10), Decimal(i % 2)) for i in range(12)]
    data.append(("x", "nullmargin", "c", "web", "Completed", None, Decimal(1)))
    df = _lines(spark, data)
    top = [r.productname for r in P.top_margin_products(df).collect()]
    assert top[:6] == ["p0", "p10", "p2", "p4", "p6", "p8"] and "nullmargin" not in top
    low = [r.productname for r in P.low_margin_products(df).collect()]
    assert low[:6] == ["p1", "p11", "p3", "p5", "p7", "p9"]


def test_empty_lines_null_measures(spark):
    k = P.profit_kpis(_lines(spark, [])).first()
    assert k.row_count == 0 and k.total_net_profit is None and k.profit_lost_to_returns is None

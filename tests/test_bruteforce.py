"""Operators against a pandas brute force on random small fixtures.

The brute force states each rule the direct, row-by-row way (pandas merge
with null keys matching, per-group Python loops); the Spark operators must
agree on every generated table, including null keys and duplicate rows.
"""

import datetime as dt
from decimal import Decimal

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerlens.operators import customers as C
from ledgerlens.operators import marketing as M
from ledgerlens.operators import sales as S

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

orders = st.sampled_from(["o1", "o2", "o3", "o4", None])
amounts = st.one_of(st.none(), st.integers(min_value=-500, max_value=5000).map(lambda c: Decimal(c) / 100))
statuses = st.sampled_from(["Completed", "Returned", None])
lines = st.lists(st.tuples(orders, amounts, amounts, statuses), min_size=1, max_size=25)


def _dsum(values):
    vals = [v for v in values if v is not None]
    return sum(vals, Decimal(0))


@SETTINGS
@given(rows=lines)
def test_sales_kpis_match_bruteforce(spark, rows):
    df = spark.createDataFrame(
        [(o, dt.datetime(2025, 1, 1), n, c, s) for o, n, c, s in rows],
        "orderid string, timestamp timestamp_ntz, netsale decimal(19,4), costofgoodssold decimal(18,4), "
        "orderstatus string")
    k = S.sales_kpis(df).first()
    revenue = _dsum(n for _, n, _, _ in rows)
    cogs = _dsum(c for _, _, c, _ in rows)
    order_ids = {o for o, *_ in rows if o is not None}
    returned = {o for o, _, _, s in rows if o is not None and s == "Returned"}
    assert k.row_count == len(rows)
    assert k.total_revenue == float(revenue) and k.total_cogs == float(cogs)
    assert k.net_profit == float(revenue - cogs)
    assert k.total_orders == len(order_ids) and k.returned_orders == len(returned)
    want_margin = float(revenue - cogs) / float(revenue) * 100 if revenue > 0 else 0.0
    assert k.gross_margin == pytest.approx(want_margin)
    assert k.return_rate == pytest.approx(len(returned) / len(order_ids) * 100 if order_ids else 0.0)


campaign_rows = st.lists(st.tuples(st.sampled_from(["o1", "o2", "o3", "o9", None]),
                                   st.sampled_from(["c1", "c2", "c3", None])), min_size=1, max_size=12)
sale_rows = st.lists(st.tuples(st.sampled_from(["o1", "o2", "o3", None]),
                               st.one_of(st.none(), st.sampled_from([Decimal(5), Decimal(6), Decimal("7.5")]))),
                     min_size=1, max_size=12)


def _campaigns_bruteforce(sales, attribution, campaigns):
    """Row-by-row: distinct (order, amount) pairs, left match with null == null,
    per-campaign sum and distinct non-null orders, then zero-fill."""
    pairs = list(dict.fromkeys(sales))
    out = {}
    for cid, cost in campaigns:
        net, conv = Decimal(0), set()
        for oid, camp in attribution:
            if camp != cid:
                continue
            if oid is not None:
                conv.add(oid)
            for poid, amount in pairs:
                if poid == oid and amount is not None:  # None == None matches, like the pandas merge
                    net += amount
        roas = 0.0 if cost == 0 else float(net) / float(cost)
        cpa = 0.0 if not conv else float(cost) / len(conv)
        out[cid] = (net, len(conv), roas, cpa)
    return out


@SETTINGS
@given(sales=sale_rows, attribution=campaign_rows)
def test_campaign_performance_matches_bruteforce(spark, sales, attribution):
    campaigns = [("c1", Decimal(100)), ("c2", Decimal(0)), ("c3", Decimal(40))]
    s = spark.createDataFrame(sales, "orderid string, netsale decimal(19,4)")
    a = spark.createDataFrame(attribution, "orderid string, campaignid string")
    c = spark.createDataFrame([(cid, cid.upper(), "web", cost) for cid, cost in campaigns],
                              "campaignid string, campaignname string, channel string, totalcost decimal(18,2)")
    got = {r.campaignid: (r.netsale, r.conversions, r.roas, r.cpa)
           for r in M.campaign_performance(s, c, a).collect()}
    want = _campaigns_bruteforce(sales, attribution, campaigns)
    assert set(got) == set(want)
    for cid in want:
        assert got[cid][0] == want[cid][0] and got[cid][1] == want[cid][1]
        assert got[cid][2] == pytest.approx(want[cid][2]) and got[cid][3] == pytest.approx(want[cid][3])


AS_OF = dt.datetime(2025, 7, 1)
day_offsets = st.integers(min_value=0, max_value=400)
customer_rows = st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d"]), st.one_of(st.none(), day_offsets)),
                         min_size=1, max_size=6)
purchase_rows = st.lists(st.tuples(st.sampled_from(["a", "b", "c", "x", None]), st.sampled_from(["o1", "o2", "o3"]),
                                   st.integers(min_value=-40, max_value=400), st.integers(min_value=0, max_value=9)),
                         min_size=1, max_size=15)


@SETTINGS
@given(custs=customer_rows, buys=purchase_rows)
def test_customer_status_matches_bruteforce(spark, custs, buys):
    cust_df = spark.createDataFrame(
        [(cid, None if d is None else AS_OF - dt.timedelta(days=d), "X", "Gold") for cid, d in custs],
        "customerid string, joindate timestamp_ntz, city string, segment string")
    sales_df = spark.createDataFrame(
        [(cid, oid, AS_OF - dt.timedelta(days=d, hours=h), Decimal(h)) for cid, oid, d, h in buys],
        "customerid string, orderid string, timestamp timestamp_ntz, netsale decimal(19,4)")
    got = sorted((r.customerid, r.status, r.frequency, r.recency) for r in
                 C.customer_status(cust_df, sales_df, AS_OF).collect())

    pdf = pd.DataFrame(buys, columns=["customerid", "orderid", "days", "hours"]).dropna(subset=["customerid"])
    pdf = pdf[pdf.days * 24 + pdf.hours >= 0]  # later sales do not exist yet
    want = []
    for cid, d in custs:
        mine = pdf[pdf.customerid == cid]
        if len(mine):
            last = max(AS_OF - dt.timedelta(days=int(r.days), hours=int(r.hours)) for r in mine.itertuples())
            recency = (AS_OF - last).days  # timedelta.days floors
            freq = mine.orderid.nunique()
        else:
            recency, freq = None, None
        if d is not None and d <= 90:
            status = "New"
        elif recency is None:
            status = "Never Purchased"
        elif recency <= 90:
            status = "Active"
        elif recency <= 180:
            status = "Dormant (At-Risk)"
        else:
            status = "Churn Risk"
        want.append((cid, status, freq, recency))
    if not any(d * 24 + h >= 0 for _, _, d, h in buys):
        want = []  # no sale so far: no view
    assert got == sorted(want, key=lambda t: tuple((x is None, x) for x in t))

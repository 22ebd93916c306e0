"""Raw CSV files in the shapes the reference reads -> rebuild -> operators.

Ids stay text here (the declared CSV types), dates arrive as text and are
typed by the loader; every operator must work on these tables unchanged.
"""

import datetime as dt

import pytest

from ledgerlens.operators import competitors as CP
from ledgerlens.operators import customers as C
from ledgerlens.operators import delivery as D
from ledgerlens.operators import marketing as M
from ledgerlens.operators import profit as P
from ledgerlens.operators import sales as S
from ledgerlens.sources import ingest as I
from ledgerlens.sources import schemas as SC

SALES_CSV = """OrderID,Timestamp,ProductID,ProductName,Category,Quantity,GrossValue,DiscountValue,CostOfGoodsSold,CustomerID,City,LocationID,Channel,OrderStatus
ORD-1,2025-03-02 10:15:00,P1,Vitamin C,Vitamins,2,40.00,4.00,20.00,C1,Riyadh,B1,Online,Completed
ORD-1,2025-03-02 10:15:00,P2,Pain Gel,Pain Relief,1,25.50,0.00,30.00,C1,Riyadh,B1,Online,Returned
ORD-2,2025-05-20 18:03:09,P1,Vitamin C,Vitamins,1,20.00,0.00,10.00,C2,Jeddah,B2,Store,Completed
ORD-3,2025-08-30 09:00:00,P3,Sun Cream,Skincare,3,60.00,6.00,24.00,C3,Jeddah,B2,Online,Completed
"""
DELIVERY_CSV = """DeliveryID,OrderID,OrderDate,PromisedDate,ActualDeliveryDate,Status,DeliveryPartner,City,DeliveryCost
D1,ORD-1,2025-03-02,2025-03-05,2025-03-04,Delivered,FastShip,Riyadh,15.00
D2,ORD-2,2025-05-20,2025-05-23,,Shipped,FastShip,Jeddah,12.50
D3,ORD-3,2025-08-30,2025-09-02,2025-09-03,Delivered,QuickGo,Jeddah,20.00
"""
CUSTOMER_CSV = """CustomerID,JoinDate,City,Segment
C1,2024-01-10,Riyadh,Gold
C2,2025-08-01,Jeddah,Silver
C3,2024-06-01,Jeddah,Bronze
C4,2024-02-02,Dammam,Bronze
"""
FUNNEL_CSV = """Week,Visits,Carts,Orders
2025-02-03,9100,870,240
2025-02-10,8700,910,310
"""
CAMPAIGN_CSV = """CampaignID,CampaignName,Channel,TotalCost,Impressions,Clicks,StartDate,EndDate
K1,Search push,Search,100,5000,250,2025-01-01,2025-12-31
K2,Social,Social,0,8000,200,2025-01-01,2025-12-31
"""
ATTRIBUTION_CSV = """OrderID,CampaignID
ORD-1,K1
ORD-2,K1
ORD-3,K2
"""
COMPETITOR_CSV = """Date,Competitor,ProductID,ProductName,Price,OnPromotion
2025-09-01,RivalA,X1,Vitamin C,18.00,True
2025-09-01,RivalB,X2,Vitamin C,22.00,False
2025-09-01,RivalA,X3,Lip Balm,5.00,False
"""


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    src = tmp_path_factory.mktemp("masters")
    for spec_name, text in [("sales", SALES_CSV), ("deliveries", DELIVERY_CSV), ("customers", CUSTOMER_CSV),
                            ("sales_funnel", FUNNEL_CSV), ("marketing_campaigns", CAMPAIGN_CSV),
                            ("marketing_attribution", ATTRIBUTION_CSV)]:
        (src / SC.REGISTRY[spec_name].master_file).write_text(text)
    (src / "competitor_data.csv").write_text(COMPETITOR_CSV)
    store = I.TableStore(spark, str(tmp_path_factory.mktemp("tables")))
    assert all(I.bootstrap(store, str(src)).values())
    t = I.refresh_all(store)
    t["competitors"] = I.load_file(spark, str(src / "competitor_data.csv"), SC.COMPETITORS)
    t["sales"] = S.enrich_sales(t["sales"])
    return t


def test_sales_tab(tables):
    s = S.filter_sales(tables["sales"], "2025-01-01", "2025-12-31")
    k = S.sales_kpis(s).first()
    assert (k.total_orders, k.returned_orders, k.total_revenue) == (3, 1, 135.5)
    assert [tuple(r) for r in S.sales_funnel(s, tables["sales_funnel"]).collect()][3] == (4, "Fulfilled", 3, 3 / 17800 * 100)
    assert [r.week for r in S.sales_trend(s, "week").collect()] == [
        "2025-02-24/2025-03-02", "2025-05-19/2025-05-25", "2025-08-25/2025-08-31"]
    assert [r.city for r in S.top_by_netsale(s, "city").collect()] == ["Jeddah", "Riyadh"]


def test_delivery_tab(tables):
    d = D.enrich_deliveries(tables["deliveries"])
    k = D.delivery_kpis(D.filter_deliveries(d, partner="FastShip")).first()
    assert (k.row_count, k.on_time_rate, k.avg_delivery_days) == (2, 50.0, 2.0)


def test_customer_tab(tables):
    st = C.customer_status(tables["customers"], tables["sales"], as_of=dt.datetime(2025, 9, 1))
    got = {r.customerid: r.status for r in st.collect()}
    assert got == {"C1": "Churn Risk", "C2": "New", "C3": "Active", "C4": "Never Purchased"}


def test_marketing_and_profit_tabs(tables):
    perf = M.campaign_performance(tables["sales"], tables["marketing_campaigns"], tables["marketing_attribution"])
    got = {r.campaignid: (float(r.netsale), r.conversions, r.roas, r.cpa) for r in perf.collect()}
    assert got == {"K1": (81.5, 2, 0.815, 50.0), "K2": (54.0, 1, 0.0, 0.0)}
    lines = P.profit_lines(tables["sales"])
    k = P.profit_kpis(lines).first()
    assert (k.total_net_profit, k.profit_lost_to_returns) == (51.5, 55.5)
    rules = [r.rule for r in P.recommendations(lines).collect()]
    assert rules == [1, 3]


def test_competitor_tab(tables):
    cmp_ = CP.price_comparison(tables["sales"], tables["competitors"])
    assert {r.productname: r.price_difference for r in cmp_.collect()} == {"Vitamin C": 0.0}
    assert CP.promo_rate(tables["competitors"]).first().promo_rate == pytest.approx(100 / 3)
    regions = {r.region: r.products for r in
               CP.assortment_overlap(tables["sales"], tables["competitors"], "RivalA", "RivalB").collect()}
    assert regions["All Three"] == 1 and regions["Ours Only"] == 2 and regions["RivalA Only"] == 1


def test_tab_api_returns_every_output(tables, spark):
    from ledgerlens.plans import tabs

    d = D.enrich_deliveries(tables["deliveries"])
    preds = spark.createDataFrame([("C1", 0.9), ("C2", 0.1)], "customerid string, churn_probability double")
    outs = {
        **{f"sales.{k}": v for k, v in tabs.sales_tab(tables["sales"], tables["sales_funnel"], grain="month").items()},
        **{f"delivery.{k}": v for k, v in tabs.delivery_tab(d).items()},
        **{f"customer.{k}": v for k, v in tabs.customer_tab(tables["customers"], tables["sales"]).items()},
        **{f"marketing.{k}": v for k, v in tabs.marketing_tab(
            tables["sales"], tables["marketing_campaigns"], tables["marketing_attribution"]).items()},
        **{f"profit.{k}": v for k, v in tabs.profit_tab(tables["sales"]).items()},
        **{f"competitor.{k}": v for k, v in tabs.competitor_tab(
            tables["sales"], tables["competitors"], "RivalA", "RivalB").items()},
        **{f"predictive.{k}": v for k, v in tabs.predictive_tab(preds).items()},
    }
    counts = {k: v.count() for k, v in outs.items()}
    assert len(counts) == 36
    assert counts["sales.kpis"] == 1 and counts["sales.funnel"] == 4 and counts["delivery.pipeline"] == 4
    assert counts["competitor.overlap"] == 7 and counts["predictive.histogram"] == 50
    k = tabs.sales_tab(tables["sales"], tables["sales_funnel"], "2025-05-01", "2025-05-31", "Store")["kpis"].first()
    assert (k.row_count, k.total_orders) == (1, 1)

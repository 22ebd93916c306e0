"""One call per dashboard tab: every output of the tab as a named, lazy DataFrame.

These functions only compose the operators; nothing is evaluated until the
caller acts on a result. The sales, customer and profit tabs share their
aggregates: the first output that is acted on fills them, the others read them
instead of the lines (a lost part is derived again), and ``release()`` frees
them. Inputs are canonical frames (enriched sales, see
``operators.sales.enrich_sales``; enriched deliveries; raw customers, funnel,
campaigns, attribution, competitor prices, score table).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import churn as CH
from ..operators import competitors as CP
from ..operators import customers as C
from ..operators import delivery as D
from ..operators import marketing as M
from ..operators import profit as P
from ..operators import sales as S


class Tab(dict):
    """Named outputs and the aggregates that they share."""

    def __init__(self) -> None:
        super().__init__()
        self.shared: list[DataFrame] = []

    def share(self, df: DataFrame) -> DataFrame:
        self.shared.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def release(self) -> None:
        for df in self.shared:
            df.unpersist()


def sales_tab(sales: DataFrame, funnel: DataFrame, start=None, end=None, channel: str = S.ALL,
              grain: str = "date") -> dict[str, DataFrame]:
    """KPIs, funnel, trend at ``grain``, category and channel shares, top
    products, cities and branches for one period and channel."""
    if grain not in S.GRAINS:
        raise ValueError(f"grain must be one of {S.GRAINS}")
    s = S.filter_sales(sales, start, end, channel)
    tab = Tab()
    totals = tab.share(S.sales_totals(s))
    cells = tab.share(S.sales_cells(s, (grain, "category", "channel", "productname", "city", "locationid")))
    any_sales = totals.where("row_count > 0").select(F.lit(1)).exists()
    top = lambda key: S.highest_netsales(S.sales_by_of(cells, key), key)
    tab |= {
        "kpis": S.kpi_measures(totals),
        "funnel": S.funnel_stages(funnel, totals.select("completed_orders").scalar(), any_sales),
        "trend": S.sales_by_of(cells, grain).orderBy(grain),
        "by_category": S.sales_by_of(cells, "category"),
        "top_products": top("productname"),
        "by_channel": S.sales_by_of(cells, "channel"),
        "top_cities": top("city"),
        "top_branches": top("locationid"),
    }
    return tab


def delivery_tab(deliveries: DataFrame, start=None, end=None, partner: str = D.ALL) -> dict[str, DataFrame]:
    d = D.filter_deliveries(deliveries, start, end, partner)
    return {
        "kpis": D.delivery_kpis(d),
        "pipeline": D.delivery_pipeline(d),
        "time_by_city": D.delivery_time_by_city(d),
        "partner_on_time": D.partner_on_time(d),
    }


def customer_tab(customers: DataFrame, sales: DataFrame, as_of=None, top_n: int = 20) -> dict[str, DataFrame]:
    tab = Tab()
    status = tab.share(C.customer_status(customers, sales, as_of))
    tab |= {
        "status": status,
        "counts": C.status_counts(status),
        "distribution": C.status_distribution(status),
        "top_value": C.top_customers(status, top_n),
        "churn_risk": C.churn_risk_customers(status),
        "new": C.new_customers(status),
    }
    return tab


def marketing_tab(sales: DataFrame, campaigns: DataFrame, attribution: DataFrame,
                  mode: str = M.PAIRS) -> dict[str, DataFrame]:
    perf = M.campaign_performance(sales, campaigns, attribution, mode)
    return {
        "performance": perf,
        "totals": M.marketing_totals(perf),
        "by_campaign": M.campaign_ratios(perf),
        "conversions_by_channel": M.conversions_by_channel(perf),
    }


def profit_tab(sales: DataFrame) -> dict[str, DataFrame]:
    tab = Tab()
    cells = tab.share(P.profit_cells(P.profit_lines(sales), ("channel", "category", "productname")))
    margins = P.margin_by_product_of(cells)
    tab |= {
        "kpis": P.profit_kpis_of(cells),
        "by_channel": P.profit_by_of(cells, "channel"),
        "by_category": P.profit_by_of(cells, "category"),
        "top_margin": P.highest_margins(margins),
        "low_margin": P.lowest_margins(margins),
        "recommendations": P.recommendations_of(cells),
    }
    return tab


def competitor_tab(our_sales: DataFrame, competitors: DataFrame, rival_a: str, rival_b: str) -> dict[str, DataFrame]:
    cmp_ = CP.price_comparison(our_sales, competitors)
    return {
        "comparison": cmp_,
        "position": CP.price_position(cmp_),
        "promo_rate": CP.promo_rate(competitors),
        "promo_by_competitor": CP.promo_by_competitor(competitors),
        "overlap": CP.assortment_overlap(our_sales, competitors, rival_a, rival_b),
    }


def predictive_tab(predictions: DataFrame) -> dict[str, DataFrame]:
    return {
        "bands": CH.risk_bands(predictions),
        "histogram": CH.risk_histogram(predictions),
        "high_risk": CH.high_risk_customers(predictions),
    }
